"""Landed files, payloads, sinks, the brief and the stream."""

import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import brief
from tallyshelf.operators.catalog import numbered
from tallyshelf.sources import landed, payloads, schema, sinks
from tallyshelf.streaming import upsert


def test_tables_from_csv(spark, tmp_path):
    headers = list(schema.SEARCH)
    path = tmp_path / "search.csv"
    path.write_text("﻿" + f'"{headers[1]}",extra,"{headers[2]}","{headers[4]}"\n 1 ,x,"a ""b"", c\nd",　\n2,,,\n', encoding="utf-8")
    rows = landed.read_table(spark, str(path), schema.SEARCH)
    assert rows.columns == list(schema.SEARCH.values())
    assert [(r.sku_id, r.title, r.coupon_price, r.page) for r in rows.orderBy("sku_id").collect()] == [("1", 'a "b", c\nd', "", ""), ("2", "", "", "")]
    assert landed.read_table(spark, str(tmp_path / "none.csv"), schema.MERGED).count() == 0
    assert len(schema.SEARCH) == 22 and len(schema.MERGED) == 26 and len(schema.COMMENTS) == 8 and len(schema.DETAIL) == 7


def test_small_files(spark, tmp_path):
    (tmp_path / "skus.txt").write_text("# no\n 12 \n\n34\n")
    assert [r.line for r in landed.lines(spark, str(tmp_path / "skus.txt")).collect()] == ["12", "34"]
    (tmp_path / "meta.json").write_text('{"page_to": 2}')
    (tmp_path / "broken.json").write_text("{")
    assert landed.run_meta(spark, str(tmp_path / "meta.json")) == {"page_to": 2}
    assert landed.run_meta(spark, str(tmp_path / "broken.json")) is None and landed.run_meta(spark, str(tmp_path / "no.json")) is None
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, body in {"1": '{"data":{"resultCount":true}}', "2": '{"data":{"resultCount":"7 ","listKeyWord":" k "}}', "3": "{", "4": '{"data":{"resultCount":3}}', "5": "[]", "6": '{"data":{"resultCount":-1}}'}.items():
        (raw / f"{name}.json").write_text(body)
    got = {r.file: (r.result_count, r.list_keyword) for r in landed.result_counts(spark, str(raw)).collect()}
    assert got == {"1.json": (None, None), "2.json": (7, "k"), "4.json": (3, None), "5.json": (None, None), "6.json": (None, None)}
    assert landed.result_counts(spark, str(tmp_path / "nowhere")).count() == 0


def test_reviews_by_line(spark, tmp_path):
    review = {"commentId": 5, "tagCommentContent": " a \n b ", "pictureInfoList": [{"largePicURL": "u"}, {"largePicUrl": "u"}, {}]}
    lines = [json.dumps({"sku": " 9 ", "parsed": {"x": [review, {"commentInfo": {**review, "tagCommentContent": "later"}}, {"commentId": 6}, {"commentId": " "}]}}), "", "#", "{"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    got = payloads.reviews(landed.reviews_by_line(spark, str(tmp_path / "c.jsonl"))).collect()
    assert [(r.sku_id, r.comment_id, r.tag_comment_content, r.large_pic_urls) for r in got] == [("9", "5", "a b", ["u"])]


def bodies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file long, body string")


def test_products_of_payloads(spark):
    ware = {"wareId": 123456, "wareName": "A &amp; <i>b</i>", "jdPrice": 12.5, "couponPrice": "10", "finalPrice": {"estimatedPrice": "9"}, "isAd": "1", "sellingPoint": None, "benefitList": [{"title": ["p  q", "P q"]}, {"title": "r s"}]}
    ok = json.dumps({"data": {"wareList": [ware, ware, {"skuId": "12"}, 5]}})
    got = payloads.wares(bodies(spark, ok, f"cb({ok});", "no json", None, "", "{", "[" * 50 + "]" * 50)).orderBy("file").collect()
    assert [(r.file, r.sku_id, r.title, r.price, r.coupon_price, r.selling_point) for r in got] == [(i, "123456", "A & b", "12.5", "10/9", "p q | r s") for i in (0, 1)]
    quality = {r.file: r.q for r in bodies(spark, ok, "", "x", '{"data":{"wareList":[]}}', "[]").select("file", payloads.search_quality("body").alias("q")).collect()}
    assert quality == {0: "ok", 1: "empty_body", 2: "not_json", 3: "no_wares", 4: "no_list"}
    slots = landed.slots(bodies(spark, ok)).orderBy("slot").collect()
    assert [(r.slot, r.sku_id) for r in slots] == [(0, "123456"), (1, "123456"), (2, "12"), (3, "")]
    states = bodies(spark, '{"code":"0"}', '{"code":1}', '{"success":false}', "[]", "{}").select("file", payloads.business_ok(landed.variant("body")).alias("ok")).orderBy("file").collect()
    assert [r.ok for r in states] == [True, False, False, False, True]


def test_tags_of_odd_shapes(spark):
    ware = {"skuId": 1, "tags": "no list", "icons": [1, None, [], "aa  aa", {"name": ["bb", 5, "BB"], "title": 7, "desc": "cc", "msg": "behind"}], "beltList": {"text": " ", "content": "dd"}, "midTagList": {"title": "ee"}, "drawer": [1]}
    ware |= {"sellPoints": ["AA AA", {"title": 12}], "base": {"keywords": ["ff", "cc", {"value": 12}, {"content": 13}]}, "x": [[{"points": ["gg"]}]], "benefitList": {"title": "hh"}, "serviceTags": [f"t{i}" for i in range(40)]}
    deep = "ii"
    for _ in range(15):
        deep = {"labels": [deep]} if isinstance(deep, str) else {"y": deep}
    found = payloads.with_objects(bodies(spark, json.dumps(ware), json.dumps({"skuId": 2, "z": deep}), "{", None), "body", ("skuId",), payloads.NESTS).orderBy("file").collect()
    assert found[0].texts == ["dd", "aa aa", "bb", "cc", *[f"t{i}" for i in range(30)], "hh", "ee", "ff", "13", "gg"]
    assert found[1].texts == [] and [r.file for r in found] == [0, 1]


def test_cursors_of_nothing(spark):
    rows = bodies(spark, "", "[]", None, '{"page": true, "s": 9}', '{"page": 2, "s": 1.5}', '{"pageNo": 0, "pageIndex": "2", "s": "7"}', '{"wareList": 1, "data": {"wareList": [5, {"skuId": "12345"}]}}').selectExpr("*", "1 as page", "3L as cursor")
    assert [r.next_cursor for r in payloads.next_cursors(rows, "page", "cursor").orderBy("file").collect()] == [None] * 5 + [7, None]
    assert {r.step for r in payloads.cursor_steps(rows, "page", "cursor").collect()} == {None}
    got = [tuple(r) for r in rows.orderBy("file").select(*payloads.first_category(landed.variant("body")).values()).collect()]
    assert got == [("", "")] * 7


def test_details_without_payload(spark):
    got = payloads.details(bodies(spark, "x", None, "[]", "{}")).orderBy("file").collect()
    assert [r.parsed for r in got] == [False, False, False, True]
    assert all(v == "" for r in got for k, v in r.asDict().items() if k not in ("file", "parsed"))


def test_replacing_a_job_twice(spark, tmp_path):
    path = str(tmp_path / "facts")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, v string")
    sinks.replace_job(one, path)
    for _ in range(2):
        sinks.replace_job(spark.createDataFrame([(2, "c"), (2, "d")], "job_id long, v string"), path)
    assert sorted((r.job_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (2, "d")]


def test_exports(spark):
    rows = spark.createDataFrame([(1, "a,b", ["u"], " "), (2, None, [], "")], "id long, v string, urls array<string>, blank string")
    text = sinks.csv_text(rows, {"id": "ID", "v": "V", "urls": "U", "none": "N"})
    assert text == '﻿ID,V,U,N\r\n1,"a,b","[""u""]",\r\n2,,[],\r\n'
    assert json.loads(sinks.json_text(rows.drop("urls"))) == [{"id": 1, "v": "a,b"}, {"id": 2, "v": None}]
    assert sinks.sections({"x": text}).startswith("﻿# x\nID")
    with pytest.raises(FileNotFoundError):
        sinks.pack({"a": "b"})
    packed = zipfile.ZipFile(io.BytesIO(sinks.pack({"competitor_analysis.md": "r", "a.json": b"{}"})))
    assert sorted(packed.namelist()) == ["a.json", "competitor_analysis.md"]


def test_row_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = numbered(df.repartition(7), ["x"]).orderBy("x").collect()
    assert [r.row_index for r in got] == list(range(1000))


def run(spark, search=(), merged=(), comments=()):
    def of(rows, names):
        cells = [tuple(str(r.get(c, "")) for c in names) + (i,) for i, r in enumerate(rows)]
        return spark.createDataFrame(cells, ", ".join(f"{c} string" for c in names) + ", row_index long")

    return of(search, schema.SEARCH.values()), of(merged, schema.MERGED.values()), of(comments, schema.COMMENTS.values())


def test_brief_of_nothing(spark):
    found = brief.build(*run(spark))
    json.dumps(found)
    assert found["scope"] == {"merged_sku_count": 0, "comment_flat_rows": 0, "structure_source_rows": 0, "uses_pc_search_list_export": False}
    assert found["matrix_by_group"] == found["consumer_feedback_by_matrix_group"] == [] and found["strategy_hints"] == [brief.HINTS["few_comments"]]
    assert brief.summary(found).startswith("# ")


def test_brief(spark):
    search = [{"sku_id": i, "shop_name": "s1" if i < 6 else f"s{i}", "price": 10 + i, "page": i % 2 + 1, "leaf_category": "饼干"} for i in range(10)]
    merged = [
        {"sku_id": "1", "detail_brand": "B", "detail_price_final": "12", "detail_category_path": "食品 > 饼干 > 粗粮", "title": "t"},
        {"sku_id": "2", "detail_brand": "B", "detail_category_path": "食品 > 面条 > 挂面", "comment_preview": "早餐 控糖"},
        {"sku_id": "3", "detail_brand": "C"},
    ]
    comments = [{"sku_id": "1", "tag_comment_content": t} for t in ("很好吃，早餐", "太甜了", "", "早餐吃，口感很好", "早餐", "早餐")] + [{"sku_id": "99", "tag_comment_content": "还会再买"}]
    found = brief.build(*run(spark, search, merged, comments), keyword="k", batch="b", config={"comment_focus_words": ["早餐", "口感"]})
    assert found["concentration"]["shops_from_list"] == {"cr1": 0.6, "cr3": 0.8, "top_label": "s1", "top_share_pct": "60.0%"}
    assert found["concentration"]["list_brand_field"] is None and found["concentration"]["detail_brand_among_merged"]["cr1"] == round(2 / 3, 6)
    assert found["price_stats_source"] == "pc_search_export_all_rows" and found["price_stats"]["n"] == 10 and found["price_stats_merged_sample"] == {"min": 12.0, "max": 12.0, "mean": 12.0, "n": 1}
    assert found["comment_focus_keywords"] == [{"word": "早餐", "count": 4}, {"word": "口感", "count": 1}]
    assert [g["group"] for g in found["matrix_by_group"]] == ["面条", "饼干", "未归类（无类目路径）"]
    groups = {g["group"]: g for g in found["consumer_feedback_by_matrix_group"]}
    assert list(groups) == ["面条", "饼干", "未归类（无类目路径）", "未归类（评价 SKU 无对应深入样本）"]
    assert groups["面条"]["effective_comment_text_units"] == 1 and groups["面条"]["focus_keyword_hits"] == [{"word": "早餐", "count": 1}]
    assert groups["饼干"]["comment_rows"] == 6 and groups["饼干"]["effective_comment_text_units"] == 5
    assert found["usage_scenarios_denominator"] == 6 and found["list_visibility_proxy"]["page_span"] == [1, 2]
    assert brief.HINTS["concentrated"] in found["strategy_hints"] and any("早餐/代餐" in h for h in found["strategy_hints"])
    json.dumps(found)
    small = brief.compact(found, 200)
    assert small["matrix_by_group_omitted"] and len(small["matrix_overview_for_llm"]) == 3 and small["matrix_overview_for_llm"][0]["distinct_brands_sample"] == ["B"]
    assert "matrix_by_group" in brief.compact(found) and "CR1 60.0%" in brief.summary(found)


def test_tuning():
    got = brief.Tuning.of({"comment_focus_words": [" a ", "", "b" * 60], "comment_scenario_groups": [{"label": "x", "triggers": ["t", " "]}, ["y", []], 5], "external_market_table_rows": [[1, 2, 3, 4], {"indicator": "i"}, {}]})
    assert got.focus_words == ("a", "b" * 48) and got.scenarios == (("x", ("t",)),) and got.market_rows == (("1", "2", "3", "4"), ("i", "", "", ""))
    assert brief.Tuning.of(None) == brief.Tuning() and brief.Tuning.of({"comment_focus_words": "x"}) == brief.Tuning()
    assert brief.Tuning().with_suggested(["n"], None).focus_words == ("n",) and brief.Tuning().with_suggested(["n"], ["o"]).focus_words == ("o", "n")
    with pytest.raises(ValueError):
        brief.validated({"other": 1})
    assert brief.tidy({"a": [float("nan"), 0.1234567]}) == {"a": [None, 0.123457]}
    marked = "head\n---\n\n## 一、研究范围、数据来源与局限\nbody"
    assert brief.with_supplement(marked, "x").index("x") < brief.with_supplement(marked, "x").index("## 一") and brief.with_supplement("", "x") == "x"


def test_catalogue_stream(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def land(*rows):
        cells = [("jd", sku, "", title, brand, "", "", "{}", "j", time, i) for i, (sku, title, brand, time) in enumerate(rows)]
        spark.createDataFrame(cells, upsert.ROWS).coalesce(1).write.mode("append").json(source)
        upsert.catalogue_stream(spark.readStream.schema(upsert.ROWS).json(source), path, checkpoint).awaitTermination(120)

    land(("1", "one", "b", "t1"), ("2", "two", "b", "t1"))
    land(("1", "", "c", "t2"))
    assert {r.sku_id: (r.title, r.detail_brand) for r in upsert.current(spark, path).collect()} == {"1": ("one", "c"), "2": ("two", "b")}
    assert upsert.current(spark, str(tmp_path / "none")).count() == 0


def test_payloads_are_walked_in_bounded_pieces(spark, monkeypatch):
    """However many payloads a batch has, few of them are Python's objects at once, and results leave in batches as small."""
    large = json.dumps([{"skuId": str(i), "name": "n" * 1000} for i in range(400)])
    given = [large] * 20 + [None, "{", "[]", large * 2, large]
    walk = payloads.objects_with(("skuId",)).func
    pieces = list(walk(iter([pa.array(given), pa.array([], pa.string()), pa.array(given[:1])])))
    found = [row for piece in pieces for row in piece.to_pylist()]
    assert [None if x is None else len(x) for x in found] == [400] * 20 + [0, None, 0, None, 400, 400]
    assert max(sum(len(o["object"]) for x in piece.to_pylist() for o in x or []) for piece in pieces) <= payloads.AT_ONCE
    raw = spark.createDataFrame([(i, b) for i, b in enumerate(given)], "file int, body string").coalesce(1)
    rows = lambda: [tuple(r) for r in payloads.with_objects(raw, "body", ("skuId",)).select("file", "position", F.to_json("fields")).collect()]
    whole = rows()
    monkeypatch.setattr(payloads, "AT_ONCE", 10)
    assert rows() == whole and len(whole) == 21 * 400
