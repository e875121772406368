"""A run into the store, and what is browsed and exported there."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tallyshelf.functions import replies
from tallyshelf.operators import brief, browse, ingest, steps
from tallyshelf.sources import answers, cursor, exports, landed, schema, sinks
from tallyshelf.streaming import upsert


def sheet(path, headers, *rows):
    names = list(headers)
    path.write_text("\n".join([",".join(f'"{n}"' for n in names)] + [",".join(f'"{r.get(headers[n], "")}"' for n in names) for r in rows]), encoding="utf-8")
    return str(path)


@pytest.fixture
def run(tmp_path):
    return {
        "search": sheet(tmp_path / "s.csv", schema.SEARCH, {"sku_id": "12", "title": "b"}, {"sku_id": "11", "title": "a"}),
        "detail": sheet(tmp_path / "d.csv", schema.DETAIL, {"sku_id": "11", "detail_brand": "x"}),
        "comments": sheet(tmp_path / "c.csv", schema.COMMENTS),
        "merged": sheet(tmp_path / "m.csv", schema.MERGED, {"sku_id": "12", "title": "b", "pipeline_keyword": "k"}, {"sku_id": ""}, {"sku_id": "12", "title": " "}),
    }


def test_run_is_ingested_in_two_phases(spark, run, tmp_path):
    store = str(tmp_path / "store")
    got = ingest.ingest_run(spark, run | {"merged": str(tmp_path / "none.csv")}, store, "1", "jd", "t1")
    assert got["dataset"] == {"search_rows": 2, "detail_rows": 1, "comments_rows": 0} and "none.csv" in got["merged"]["error"]
    assert [(r.row_index, r.sku_id) for r in sinks.rows_of_job(spark, f"{store}/search", "1").orderBy("row_index").collect()] == [(0, "12"), (1, "11")]
    for created in (1, 0):
        got = ingest.ingest_run(spark, run, store, "1", "jd", "t2")["merged"]
        assert got == {"rows_in_csv": 3, "rows_ingested": 2, "snapshots_upserted": 2, "products_created": created}
    products = upsert.current(spark, f"{store}/products")
    assert [(r.sku_id, r.title, r.last_job, json.loads(r.current_payload)["title"]) for r in products.collect()] == [("12", "b", "1", "")]
    snaps = sinks.stored(spark, f"{store}/snapshots").withColumnRenamed("job_id", "job")
    assert snaps.count() == 1
    assert browse.product(products, snaps, "jd", "12").first().n_snapshots == 1
    assert [r.captured_at for r in browse.history(snaps, "jd", "12").collect()] == ["t2"]
    with pytest.raises(LookupError):
        browse.product(products, snaps, "jd", "13")
    page = browse.product_list(products, snaps, "B", "", 5)
    assert page["total"] == 1 and page["results"].first().n_snapshots == 1
    assert browse.product_list(products, snaps, "", "k")["total"] == 0  # the last row's payload has no keyword


def test_a_run_without_rows_leaves_none_behind(spark, run, tmp_path):
    store = str(tmp_path / "store")
    two = sheet(tmp_path / "c2.csv", schema.COMMENTS, {"sku_id": "12", "comment_id": "1"}, {"sku_id": "12", "comment_id": "2"})
    for job, comments, want in (("7", two, 2), ("007", two, 2), ("a b=/c", two, 2), ("7", run["comments"], 0), ("a b=/c", run["comments"], 0)):
        got = ingest.ingest_run(spark, run | {"comments": comments}, store, job, "jd", "t")
        assert got["dataset"]["comments_rows"] == want == sinks.rows_of_job(spark, f"{store}/comments", job).count()
    rows = sinks.rows_of_job(spark, f"{store}/comments", "007")
    assert [(r.job_id, r.row_index) for r in rows.orderBy("row_index").collect()] == [("007", 0), ("007", 1)]
    ingest.ingest_run(spark, run, store, "007", "jd", "t")
    assert sinks.stored(spark, f"{store}/comments").count() == 0 and set(sinks.stored(spark, f"{store}/comments").columns) == {*schema.COMMENTS.values(), "job_id", "row_index"}
    assert len(upsert.versions(spark, f"{store}/products")) == 1 + upsert.KEPT


def test_a_stopped_ingest_keeps_what_is_finished_and_goes_on(spark, run, tmp_path, monkeypatch):
    store, folder, written = str(tmp_path / "store"), str(tmp_path / "run"), []
    first = ingest.relation_rows

    def relation_rows(spark, path, relation, job):
        written.append(relation)
        if relation == "detail" and written.count("detail") == 1:
            steps.stop(spark, folder)  # between two relations: the one at hand is finished, no other begins
        return first(spark, path, relation, job)

    monkeypatch.setattr(ingest, "relation_rows", relation_rows)
    with pytest.raises(steps.Stopped) as stopped:
        ingest.ingest_run(spark, run, store, "1", "jd", "t", folder)
    assert stopped.value.finished == {"search": 2, "detail": 1} == steps.finished(spark, folder)
    assert sinks.rows_of_job(spark, f"{store}/search", "1").count() == 2 and not landed.exists(spark, f"{store}/comments")
    got = ingest.ingest_run(spark, run, store, "1", "jd", "t", folder)
    assert written == ["search", "detail", "comments", "merged"]
    assert got["dataset"] == {"search_rows": 2, "detail_rows": 1, "comments_rows": 0} and got["merged"]["products_created"] == 1
    assert ingest.ingest_run(spark, run, store, "1", "jd", "t", folder) == got and len(written) == 4


def test_a_running_step_is_cut_off(spark, tmp_path):
    folder, slow = str(tmp_path / "run"), F.udf(lambda x: time.sleep(0.2) or x, "long")

    def long_step():
        threading.Timer(6, steps.stop, (spark, folder)).start()
        return spark.range(4000).select(slow("id").alias("x")).agg(F.sum("x")).first()[0]

    began = time.time()
    with pytest.raises(steps.Stopped) as stopped:
        steps.run(spark, [("a", lambda: "é"), ("b", long_step), ("c", lambda: 1)], folder)
    assert stopped.value.finished == {"a": "é"} and time.time() - began < 60
    assert steps.run(spark, [("a", lambda: 0), ("b", lambda: None), ("c", lambda: [1])], folder) == {"a": "é", "b": None, "c": [1]}
    with pytest.raises(ZeroDivisionError):
        steps.run(spark, [("x", lambda: 1 / 0)], str(tmp_path / "other"))


def test_pages_and_exports(spark):
    rows = spark.createDataFrame([(i, i, f"s{i % 2}", "t" if i == 3 else " ", []) for i in range(5)], "id long, row_index long, sku_id string, title string, pics array<string>")
    headers = {"SKU": "sku_id", "Name": "title", "Pictures": "pics", "Absent": "absent"}
    page = browse.browsed(rows, 2, 2)
    assert page["total"] == 5 and [r.row_index for r in page["results"].collect()] == [2, 3]
    assert [r.row_index for r in browse.browsed(rows, 1, 50, " s1 ")["results"].collect()] == [1, 3]
    assert browse.export_columns(rows, headers) == {"id": "id", "row_index": "row_index", "sku_id": "SKU", "title": "Name"}
    name, text = sinks.export({"search": (rows, headers)}, "search", "csv", {"job_id": 7})
    assert name == "job_7_search.csv" and text.splitlines()[0].removeprefix("﻿") == "id,row_index,SKU,Name" and len(text.splitlines()) == 6
    name, text = sinks.export({"search": (rows, headers), "detail": (rows.where("id < 0"), headers)}, "all", "json", {"job_id": 7, "keyword": "k"})
    got = json.loads(text)
    assert list(got) == ["job_id", "keyword", "search", "detail"] and [r["row_index"] for r in got["search"]] == list(range(5)) and got["detail"] == []
    assert sinks.export({"a": (rows, headers), "b": (rows, headers)}, "all", "csv", {"job_id": 7})[1].count("# ") == 2
    with pytest.raises(ValueError):
        sinks.export({}, "x", "csv", {"job_id": 7})
    assert json.loads(sinks.run_metadata({"page_to": 2}, {"search": rows})) == {"page_to": 2, "search_rows": 5}


def test_last_accepted_explains(spark):
    tries = spark.createDataFrame([("a", 0, "good", "u0", False), ("a", 1, "bad", "u1", False), ("a", 2, None, "u2", True), ("b", 0, "", "v", False), ("b", 1, "bad", "w", False)], "k string, at int, text string, url string, failed boolean")
    got = {r.k: tuple(r)[1:] for r in ingest.last_accepted(tries, "k", "at", "text", "url", "failed", F.col("text") == "good").collect()}
    assert got == {"a": ("good", "u0", 3, 1, 1), "b": (None, None, 2, 0, 1)}


def test_replies(spark):
    texts = ["```\na\n```", "```", "a ```", None, "```json\n```\n``` ", " x "]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, c string").orderBy("i").select(replies.without_fence("c").alias("t")).collect()]
    assert got == ["a", "", "a ```", "", "", "x"]
    values = ['"a "', "null", None, "5", "[]", '[{"type":"image"},{"type":"text","text":"b"}]']
    got = [r.t for r in spark.createDataFrame(list(enumerate(values)), "i int, c string").orderBy("i").select(replies.content_text("c").alias("t")).collect()]
    assert got == ["a", "", "", "5", "", "b"]
    answers = ['{"phrases": "no"}', "x", None, '{"phrases": [" p ", "", 4]}']
    got = [r.t for r in spark.createDataFrame(list(enumerate(answers)), "i int, c string").orderBy("i").select(replies.phrases("c").alias("t")).collect()]
    assert got == [[], [], [], ["p", "4"]]


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "catalogue")

    def batch(keys, brand):
        rows = [("jd", str(k), "", f"t{k}" if brand == "a" else "", brand, "", "", "{}", "j", "t", i) for i, k in enumerate(keys)]
        return spark.createDataFrame([*rows, ("jd", " ", "", "", brand, "", "", "{}", "j", "t", 10**6)], upsert.ROWS)

    def brands(version=None):
        return {r.sku_id: (r.title, r.detail_brand) for r in upsert.current(spark, path, version).collect()}

    want = {str(k): (f"t{k}", "a") for k in range(500)}
    assert len(upsert.apply_batch(batch(range(500), "a"), path, 0, F.col("row_index"))) == upsert.BUCKETS and brands() == want
    for number in range(1, 8):
        keys = range(number, number + 10)
        wrote = upsert.apply_batch(batch(keys, f"b{number}"), path, number, F.col("row_index"), 7)
        assert 1 <= len(wrote) <= 10
        before, held = upsert.manifest(spark, path, number - 1)["held"], upsert.manifest(spark, path, number)["held"]
        assert {b for b in held if held[b] != before[b]} == set(wrote) and len(held) == upsert.BUCKETS
        want |= {str(k): (f"t{k}", f"b{number}") for k in keys}
        assert brands() == want
    again = dict(want)
    upsert.apply_batch(batch(range(7, 17), "b7"), path, 7, F.col("row_index"))  # as after a failure
    assert brands() == again and brands(6) == {k: (t, "b6" if b == "b7" and int(k) < 16 else "a" if b == "b7" else b) for k, (t, b) in again.items()}
    assert upsert.versions(spark, path) == [4, 5, 6, 7]
    upsert.apply_batch(batch([], "c"), path, 8, F.col("row_index"))
    assert brands() == again and upsert.current(spark, str(tmp_path / "none")).count() == 0


def joined(manifest):
    out = []
    for s in manifest["sections"]:
        parts = sorted(p for p in os.listdir(s["path"].removeprefix("file:")) if p.startswith("part-"))
        texts = []
        for p in parts:
            with open(f"{s['path']}/{p}", encoding="utf-8", newline="") as f:
                texts.append(f.read())
        out.append(s["before"] + "".join(texts))
    return out


def test_exports_by_tasks_equal_the_driver_s(spark, tmp_path):
    cells = [None, "", " ", "a,b", 'say "x"', "two\nlines", "é日本", "a\rb", "\\", "{", "2.50"]
    rows = [(i, 3 * i, cells[i % len(cells)], cells[(5 * i) % len(cells)], [[], None, ["u"], ["v", 'w"']][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, row_index long, sku_id string, title string, pics array<string>").repartition(7)
    headers = {"SKU": "sku_id", 'Na"me': "title", "Pictures": "pics", "Absent": "absent"}
    both = {"search": (df, headers), "detail": (df.where("id < 0"), headers)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for k, kind in enumerate(("search", "detail", "all")):
            for form in ("csv", "json"):
                got = exports.export(both, kind, form, {"job_id": 7}, str(tmp_path / f"{k}{form}"))
                assert exports.manifest(spark, str(tmp_path / f"{k}{form}")) == got
                name, text = sinks.export(both, kind, form, {"job_id": 7})
                parts = joined(got)
                assert got["file"] == name and [s["rows"] for s in got["sections"]] == ([400, 0] if kind == "all" else [400] if kind == "search" else [0])
                if form == "csv":
                    assert "".join(parts) == text
                elif kind == "all":
                    assert {s["name"]: json.loads(p) for s, p in zip(got["sections"], parts, strict=True)} == {k: v for k, v in json.loads(text).items() if k != "job_id"}
                else:
                    assert parts == [text + "\n"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([p for p in os.listdir(tmp_path / "0csv" / "00-search") if p.startswith("part-")]) > 1
    alone = spark.createDataFrame([(0, ""), (1, "x")], "row_index long, v string")
    exports.put(exports.csv_lines(alone, {"v": "V"}, "row_index"), str(tmp_path / "one"), "\r\n")
    assert joined({"sections": [{"path": str(tmp_path / "one"), "before": ""}]}) == [sinks.csv_text(alone, {"v": "V"})]


def test_parts_are_read_whatever_line_end_stands_first(spark, tmp_path):
    cells = ["a\nb", "c\r\nd", "", 'e,"\n', "f"] * 20
    rows = spark.createDataFrame([(i, c, "") for i, c in enumerate(cells)], "row_index int, title string, last string")
    lines = exports.csv_lines(rows, {"row_index": "row_index", "title": "名称", "last": "末"}, "row_index")
    lines.orderBy("place").repartitionByRange(9, "place").sortWithinPartitions("place").select("line").write.option("lineSep", "\r\n").text(str(tmp_path / "parts"))
    got = exports.read_csv(spark, str(tmp_path / "parts"), ["row_index", "名称", "末"]).collect()
    assert sorted((int(r[0]), r[1], r[2]) for r in got) == [(i, c, "") for i, c in enumerate(cells)]


def test_a_table_in_chunks_by_key(spark, tmp_path):
    rows = spark.range(0, 3000, 3).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("v"))
    table = cursor.laid_out(rows.repartition(5), "key", str(tmp_path / "t"))
    chunks = cursor.Cursor(table, "key", 130)
    assert len(chunks) == 8
    found = [[tuple(r) for r in c.collect()] for c in chunks]
    assert [len(c) for c in found] == [130] * 7 + [90] and [r for c in found for r in c] == [tuple(r) for r in rows.orderBy("key").collect()]
    plan = chunks.chunk(5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,1950)" in plan and "LessThan(key,2340)" in plan
    assert chunks.chunk(8).count() == 0 and len(cursor.Cursor(table.where("false"), "key")) == 0
    with pytest.raises(ValueError):
        cursor.Cursor(rows.selectExpr("nullif(key, 3) as key"), "key")


def test_matrix_as_a_table(spark, tmp_path):
    rows = [(i, str(i), f"t{i}", ["B", "", " C "][i % 3], ["x", "y", "未归类（无类目路径）"][min(i % 7, 2)]) for i in range(700)]
    products = spark.createDataFrame(rows, "row_index long, sku_id string, title string, detail_brand string, group string").withColumn("category", F.col("group"))
    for c in ("price", "coupon_price", "detail_price_final", "shop_name", "detail_shop_name", "selling_point", "comment_fuzzy"):
        products = products.withColumn(c, F.lit(""))
    path = str(tmp_path / "matrix")
    whole, parted = brief._matrix_of(products, None), brief._matrix_of(products, path)
    assert parted["matrix_by_group"] == [] and brief.overview(parted) == brief.overview(whole)
    for g in whole["matrix_by_group"]:
        found = [r.asDict() for r in brief.matrix_of_group(spark, path, g["group"]).drop("bucket", "row_index", "group").collect()]
        assert found == g["skus"]


def test_answers_land_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = [(f"pc_{i:04d}.json", ['{"a": [1, "é"]}', "<html>", None, "[]"][i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "file string, body string").repartition(4)
    answers.land(df, path)
    assert sorted(os.listdir(path)) == [n for n, _ in rows]
    want = {n: '{\n  "a": [\n    1,\n    "é"\n  ]\n}' if b and b.startswith("{") else b or "" for n, b in rows}
    found = answers.landed(spark, path, 7)
    assert {r.file: r.body for r in found.collect()} == want and found.rdd.getNumPartitions() == 9
    broken = spark.createDataFrame([("x1.json", "1"), ("a/b.json", "2"), ("x2.json", "3")], "file string, body string").repartition(3)
    twice = spark.createDataFrame([("x1.json", "1"), ("x1.json", "2")], "file string, body string").repartition(2)
    for bad in (broken, twice):
        with pytest.raises(Exception, match="file"):
            answers.land(bad, path)
        assert sorted(os.listdir(path)) == [n for n, _ in rows]
    answers.land(df.limit(3).selectExpr("file", "'new' as body"), path)
    assert sum(r.body == "new" for r in answers.landed(spark, path).collect()) == 3
    answers.land(df.limit(2), f"file://{path}", overwrite=True)
    assert len(os.listdir(path)) == 2 and answers.landed(spark, str(tmp_path / "none")).count() == 0


def test_a_run_is_numbered_as_it_stands(spark, tmp_path, monkeypatch):
    """A relation's rows are in order when they are read: they are neither sorted nor shuffled."""
    from tallyshelf.operators import ingest
    from tallyshelf.sources.schema import RELATIONS

    header = next(h for h, c in RELATIONS["search"].items() if c == "sku_id")
    path = str(tmp_path / "search.csv")
    (tmp_path / "search.csv").write_text("\n".join([header, *[f"s{i * 7919 % 1000}" for i in range(1000)]]) + "\n")
    frame = type(spark.range(1))
    for banned in ("repartitionByRange", "orderBy"):
        monkeypatch.setattr(frame, banned, lambda *a: (_ for _ in ()).throw(AssertionError("sorted")))
    rows = ingest.relation_rows(spark, path, "search", "007")
    assert sorted((r.row_index, r.sku_id, r.job_id) for r in rows.collect()) == [(i, f"s{i * 7919 % 1000}", "007") for i in range(1000)]
