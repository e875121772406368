"""Cells: blanks, nulls, wide characters, ties and bounds."""

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from tallyshelf.functions import category, ingredients, links, price, text
from tallyshelf.operators import catalog, dedupe, lexicon, merge, rank, stats
from tallyshelf.operators.chunks import chunked, spread
from tallyshelf.operators.taxonomy import list_category


@pytest.fixture()
def value(spark):
    def of(column, cell):
        return spark.createDataFrame([(cell,)], "c string").select(column(F.col("c")).alias("x")).first().x

    return of


@pytest.mark.parametrize(
    "column, cell, want",
    [
        (text.strip, "　 a b\x85\x1c ", "a b"),
        (text.strip, None, ""),
        (text.squeeze, "a \n 　b", "a b"),
        (lambda c: text.first_filled(F.lit(None), F.lit("  "), c), " x ", "x"),
        (lambda c: text.table_cell(c, 3), "a|b\r\ncd", "a/b…"),
        (lambda c: text.table_cell(c, 0), "abcdef", "abcdef"),
        (lambda c: text.occurrences(c, "aa"), "aaaa", 2),
        (lambda c: text.occurrences(c, "aa"), None, 0),
        (text.plain, "<b>a&amp;lt;</b>&nbsp;b", "a&lt; b"),
        (text.is_rank_text, "top " + "x" * 50, False),
        (text.is_rank_text, "第12名", True),
        (text.safe_segment, " . ", "run"),
        (text.batch_label, "20240102_030405_粥", "20240102 030405"),
        (text.keyword_of, "20240102_030405_粥", "粥"),
        (price.price_in, "¥1,299.50起", 1299.5),
        (price.price_in, "20万+", 20.0),
        (price.price_in, "１２．５", 12.5),
        (price.price_in, "0", None),
        (price.price_in, "1000000", None),
        (price.price_in, "9.9-19.9", 9.9),
        (price.price_in, None, None),
        (lambda c: price.observed_price(c, F.lit("7")), "0", 7.0),
        (lambda c: price.merged_coupon(c, F.lit("5")), "3", "3/5"),
        (lambda c: price.merged_coupon(c, F.lit("5")), "35", "35"),
        (lambda c: price.merged_coupon(c, F.lit(""), F.lit("8")), None, "8"),
        (category.group_key, "a > b > c > d", "c"),
        (category.group_key, "a＞ b >c", "b"),
        (category.group_key, "a>b", "b"),
        (category.group_key, " a ", "a"),
        (category.group_key, " > ＞ ", category.NO_PATH),
        (category.group_key, None, category.NO_PATH),
        (category.top_segment, "a ＞ b", "a ＞ b"),
        (category.top_segment, "a > b", "a"),
        (lambda c: category.category_cell(F.lit(""), F.lit(" "), c), "类目:12 | 简称：粥 | x", "粥"),
        (lambda c: category.category_cell(F.lit(""), F.lit(" "), c), "简称：粥", ""),
        (lambda c: category.chart_slug(c, F.lit(3)), "饼干/ x!", "i03_饼干x"),
        (lambda c: category.chart_slug(c, F.lit(3)), " /", "i03_group"),
        (links.page_address, " //a.x/b ", "https://a.x/b"),
        (links.page_address, "/b", "https://so.m.jd.com/b"),
        (links.asset_address, "'data:image/png'", ""),
        (links.asset_address, '"//a.x/b"', "https://a.x/b"),
        (links.asset_address, "/jfs/t", "https://img30.360buyimg.com/sku/jfs/t"),
        (links.list_picture, "/n5/x", "https://img13.360buyimg.com/n5/x"),
        (ingredients.one_line, "a\r\n\n b ", "a；b"),
        (ingredients.from_attributes, "x:1; 配料: a、b；c", "a、b"),
        (ingredients.is_address_list, "x " * 10 + "http://a;", True),
        (ingredients.is_acceptable, "暂无", False),
        (ingredients.is_acceptable, "配料表：水、糖，含量≥5%", True),
        (ingredients.is_recipe, "葱花各1勺", True),
        (ingredients.sanitised, "a、b、c”'", "a、b、c"),
        (ingredients.sanitised, None, ""),
        (ingredients.sanitised, "水、" + "糖、盐、" * 40, ""),
        (ingredients.sanitised, "水、油、米、" + "糖、盐、" * 40, "水、油"),
    ],
)
def test_cells(value, column, cell, want):
    assert value(column, cell) == want


def test_long_ingredients_end_at_a_mark(value):
    got = value(ingredients.sanitised, "、".join(f"原料{i}" for i in range(2000)))
    assert got.endswith("、…（已截断）") and len(got) < 3300


def test_a_tail_is_found_in_one_pass(spark):
    rng, cells = random.Random(1), ["水、" * 40, "、".join("abcd" * 10)]
    cells += ["、".join(rng.choices("abcdefgh", k=rng.randint(0, 30)) + rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(20, 40))) for _ in range(60)]

    def want(cell):
        parts = [x for x in cell.split("、") if x]
        return "、".join(parts[: next((i for i in range(len(parts) - 27) if len(set(parts[i:])) <= 3), len(parts))])

    long = "、".join(f"{i}" for i in range(3000)) + "、x、y" * 3000
    began = time.time()
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([*cells, long])], "i int, c string")
    got = dict(rows.select("i", ingredients.sanitised("c", most=1 << 20)).collect())
    assert [got[i] for i in range(len(cells))] == list(map(want, cells))
    assert got[len(cells)] == "、".join(f"{i}" for i in range(2999)) and time.time() - began < 60


def test_distinct_texts_keep_the_first(spark):
    got = spark.range(1).select(text.distinct_texts(F.array(*map(F.lit, ["b  B", "B b", "x", "Yy", "yY"]))).alias("x")).first().x
    assert got == ["b B", "Yy"]


def labels(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "at long, name string")


def test_ties_go_to_the_label_met_first(spark):
    df = labels(spark, ["b", "a", None, "", "a", "b", "c"])
    assert [(r.rk, r.label, r.n) for r in rank.top_labels(df, F.col("name"), F.col("at"), 2).orderBy("rk").collect()] == [(1, "b", 2), (2, "a", 2)]
    one = rank.concentration(df, F.col("name"), F.col("at")).first()
    assert (one.cr1, one.cr3, one.top_label, one.n_rows) == (0.4, 1.0, "b", 5)
    none = rank.concentration(df.where("false"), F.col("name"), F.col("at")).first()
    assert none.cr1 is None and none.n_rows is None


def test_other_slices(spark):
    counts = lambda names: rank.label_counts(labels(spark, names), F.col("name"), F.col("at"))
    got = lambda names, k: [(r.label, r.n) for r in rank.top_with_other(counts(names), k).orderBy("rk").collect()]
    assert got(list("aaabbcd"), 3) == [("a", 3), ("b", 2), ("其他", 2)]
    assert got(list("aab"), 3) == [("a", 2), ("b", 1)] and got([], 3) == []


@pytest.mark.parametrize("xs", [[], [3.0], [1.0, 2.0], [1.0, 2.0, 3.0], [1, 2, 3, 4, 10], [5.0] * 7, [1, 1, 2, 9, 9, 9, 4, 6]])
def test_hinges(spark, xs):
    xs = [float(x) for x in xs]
    rows = stats.price_stats(spark.createDataFrame([(x,) for x in [*xs, None]], "price double")).collect()
    if not xs:
        assert rows == []
        return
    r, s, half = rows[0], sorted(xs), len(xs) // 2
    assert (r.n, r.min, r.max) == (len(xs), min(xs), max(xs)) and r.mean == pytest.approx(statistics.mean(xs), abs=1e-6)
    assert r.stdev == (pytest.approx(statistics.stdev(xs), abs=1e-6) if len(xs) > 1 else None)
    assert r.median == (statistics.median(xs) if len(xs) > 1 else None)
    assert r.q1 == (statistics.median(s[:half]) if len(xs) > 3 else None) and r.q3 == (statistics.median(s[-half:]) if len(xs) > 3 else None)


def test_hints(spark):
    def codes(*xs):
        return spark.range(1).select(stats.hint_codes(*[F.lit(x).cast("double") for x in xs]).alias("c")).first().c

    assert codes(0.5, 10, 4, 1, 3, 8, 2) == ["concentrated", "spread", "topics", "few_comments", "scenario"]
    assert codes(0.3, 10, 1, 0, 50, 4, 4) == ["none"]
    assert codes(None, None, None, 0, 5, 0, None) == ["none"] and codes(0.2, 0, 1, 0, 9, 9, 1) == ["fragmented"]
    assert stats.least_rows_for_brands(0) == 5 and stats.least_rows_for_brands(1000) == 20


def test_focus_words(spark):
    df = spark.createDataFrame([("血糖控糖",), (None,), ("甜甜 控糖",)], "text string")
    assert [(r.word, r.n) for r in lexicon.focus_hits(df, "text", ("甜", "控糖", "血糖", "血糖", "none")).orderBy("rk").collect()] == [("控糖", 2), ("血糖", 2)]
    assert lexicon.focus_hits(df, "text", ("甜",)).count() == 0
    both = lexicon.focus_hits_or(df.where("text = '甜甜 控糖'"), df, "text", ("血糖",)).collect()
    assert [(r.word, r.n) for r in both] == [("血糖", 1)]


def test_default_lexicons(spark):
    df = spark.createDataFrame([(0, "很好吃"), (1, "太甜了，不好"), (2, "难吃"), (3, ""), (4, None), (5, "很好吃")], "at long, text string")
    one = lexicon.tones(df, "text").first()
    assert (one.positive_only, one.negative_only, one.mixed_positive_and_negative, one.neutral_or_empty) == (2, 1, 1, 2)
    hits = {(r.tone, r.word): r.n for r in lexicon.tone_phrase_hits(df, "text", F.col("at")).collect()}
    assert hits == {("positive", "很好吃"): 2, ("negative", "太甜了"): 1}
    samples = lexicon.tone_samples(df, "text", F.col("at"), n=2).orderBy("tone", "rk").collect()
    assert [(r.tone, r.rk, r["sample"]) for r in samples] == [("mixed", 1, "太甜…"), ("negative", 1, "难吃"), ("positive", 1, "很好…")]
    assert len(lexicon.GOOD_LEXICON) == 36 and len(lexicon.BAD_LEXICON) == 41 and len(lexicon.STAPLES) == 54 and len(lexicon.BAKERY) == 23


def test_scenarios_and_scope(spark):
    df = spark.createDataFrame([(0, "夜宵 零食"), (1, "零食"), (2, "无")], "at long, text string")
    got = lexicon.scenario_counts(df, "text", F.col("at")).orderBy("rk").collect()
    assert [(r.scenario, r.n) for r in got] == [("零食/加餐/解馋", 2), ("夜宵/熬夜", 1)]
    rows = spark.createDataFrame([("全麦面包", ""), ("面条", "吐司"), ("水", None)], "title string, leaf string")
    assert {r.title: r.scope_tag for r in lexicon.in_scope(rows, ["title", "leaf"]).collect()} == {"全麦面包": "4.2", "面条": "4.1+4.2"}
    assert lexicon.in_scope(rows.where("title = '水'"), ["title", "leaf"], keep_all_if_none=True).count() == 1


def test_list_categories(spark):
    rows = [(0, "12", ""), (1, "12", "简称:粥"), (2, "12", "简称:面"), (3, "13", ""), (4, "", "类目:12"), (5, "", "简称:饼"), (6, "", ""), (7, "饼干", "x")]
    got = list_category(spark.createDataFrame(rows, "at long, leaf_category string, attributes string"), F.col("at"))
    assert [r.label for r in got.orderBy("at").collect()] == ["粥", "粥", "粥", category.UNRESOLVED, "粥", "饼", None, "饼干"]


def test_page_caps_let_turned_away_keys_in_later(spark):
    rows = [(0, "1", "a"), (1, "1", "b"), (2, "1", "a"), (3, "1", "c"), (4, "2", "c"), (5, "2", "a"), (6, "2", ""), (7, "2", "d"), (8, "2", "e")]
    df = spark.createDataFrame(rows, "at long, page string, sku string")
    got = dedupe.paged_listing(df, "sku", "page", F.col("at"), ["1", "2"], 2).orderBy("at").collect()
    assert [(r.at, r.sku) for r in got] == [(0, "a"), (1, "b"), (4, "c"), (7, "d")]
    assert dedupe.paged_listing(df, "sku", "page", F.col("at"), []).count() == 0


def test_last_and_first_rows(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, " ", 3), (3, None, 4)], "at long, sku string, key int")
    assert [r.key for r in dedupe.first_rows(df, F.col("sku"), F.col("at")).collect()] == [1]
    assert [r.key for r in dedupe.last_rows(df, F.col("sku"), F.col("at")).collect()] == [2]
    assert sorted(r.key for r in dedupe.first_or_blank(df, F.col("sku"), F.col("at")).collect()) == [1, 3, 4]


def test_rollup_and_groups(spark):
    rows = [("a", i, "" if i == 1 else f"t{i}") for i in range(10)] + [("b", 0, None)]
    got = {r.sku: (r.comment_count, r.comment_preview) for r in merge.comment_rollup(spark.createDataFrame(rows, "sku string, i long, text string"), "sku", "text", F.col("i")).collect()}
    assert got == {"a": ("10", "t0 | t2 | t3 | t4 | t5 | t6 | t7"), "b": ("1", "")}
    said = spark.createDataFrame([("g",), ("g",)], "group string")
    alone = merge.feedback_groups(said.where("false"), said).collect()
    assert [(r.group, r.n_comments) for r in alone] == [(category.NO_MERGED, 2)]
    assert merge.feedback_groups(said.where("false"), said.where("false")).count() == 0


def products(spark, rows):
    cols = "platform string, sku_id string, ware_id string, title string, detail_brand string, detail_price_final string, detail_category_path string, current_payload string, last_job string, last_captured_at string, at long"
    return spark.createDataFrame([("jd", sku, ware, title, brand, "1", "c", "{}", "j", "t", i) for i, (sku, ware, title, brand) in enumerate(rows)], cols)


def test_upsert_keeps_titles_and_erases_brands(spark):
    none = catalog.batch_products(products(spark, [("x", "", "", "")]).where("false"), F.col("at"))
    old = catalog.upserted(none, products(spark, [("1", "w", "old", "b"), ("", "w", "t", "b"), ("2", "w2", "two", "b")]), F.col("at"))
    assert {r.created for r in old.collect()} == {True} and old.count() == 2
    new = products(spark, [("1", "", "first", "x"), ("1", "", " ", ""), ("3", "", "", "")])
    got = {r.sku_id: (r.ware_id, r.title, r.detail_brand, r.created) for r in catalog.upserted(old.drop("created"), new, F.col("at")).collect()}
    assert got == {"1": ("w", "first", "", False), "2": ("w2", "two", "b", False), "3": ("", "", "", True)}
    again = catalog.upserted(catalog.upserted(old.drop("created"), new, F.col("at")).drop("created"), new, F.col("at"))
    assert {r.sku_id: (r.ware_id, r.title, r.detail_brand) for r in again.collect()} == {k: v[:3] for k, v in got.items()}


def test_browsing_bounds(spark):
    df = spark.range(500)
    assert [r.id for r in catalog.page_of(df, ["id"], 0, 1000).collect()] == list(range(200))
    assert [r.id for r in catalog.page_of(df, ["id"], 3, 0).collect()] == [2]
    assert catalog.page_of(df, ["id"], 99, 50).count() == 0
    assert catalog.containing(df, ["id"], " ").count() == 500
    rows = spark.createDataFrame([(" ", None, "x")], "a string, b string, c string")
    assert catalog.kept_columns(rows) == ["c"] and catalog.kept_columns(rows.where("false")) == []


def test_chunks(spark):
    rows = [("g", i, "x" * n) for i, n in enumerate([3, 4, 20, 0, 1, 1, 1])]
    got = chunked(spark.createDataFrame(rows, "g string, i long, text string"), "text", "g", "i", 9).orderBy("chunk").collect()
    assert [(r.chunk, r.texts, r.characters) for r in got] == [(0, 2, 9), (1, 1, 21), (2, 3, 6)]
    many = spark.range(30).select(F.lit("g").alias("g"), F.col("id").cast("int").alias("chunk"))
    assert sorted(r.chunk for r in spread(many, "g").collect()) == sorted({min(int(i * 30 / 12), 29) for i in range(12)})
