"""Readings, records and specifications at their edges; the registered queries hold them against SQL."""

from pyspark.sql import functions as F

from tallyshelf.functions import specs
from tallyshelf.operators import readings, records
from tallyshelf.sources import sinks


def test_specs(spark):
    cells = [None, "", " 7 ", "2-5", "5 - 2", "1,, 3 ,", "a-b", "3-", "-3", "1-2-3", "x"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    found = [r.p for r in rows.orderBy("i").select(specs.pages_of_spec("c").alias("p")).collect()]
    assert found == [["1"], ["1"], ["7"], ["2", "3", "4", "5"], ["2", "3", "4", "5"], ["1", "3"], None, None, None, None, ["x"]]
    cells = [None, "", "30-60", " 60 - 30.5", "-3-5", "5", "a-1", "1e1-2", "1-2d", "1-2-3"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    found = [r.r and tuple(r.r) for r in rows.orderBy("i").select(specs.range_of_spec("c").alias("r")).collect()]
    assert found == [None, None, (30.0, 60.0), (30.5, 60.0), None, None, None, (2.0, 10.0), None, None]


def test_shares_are_rounded_like_format(spark):
    cases = [(n, t) for t in (1, 3, 7, 8, 16, 32, 64) for n in range(t + 1)]
    rows = spark.createDataFrame(cases, "n long, t long").select("n", "t", specs.share_text(F.col("n"), F.col("t")).alias("a"), specs.share_text(F.col("n"), F.col("t"), 0).alias("b"))
    for r in rows.collect():
        assert (r.a, r.b) == (f"{100 * r.n / r.t:.1f}", f"{100 * r.n / r.t:.0f}")


def test_nothing_to_read(spark):
    schema = "cr1 double, cr3 double, top_label string, n_rows long, n_all long"
    rows = spark.createDataFrame([(None, None, None, None, 4), (0.5, 1.0, " ", 2, 4), (0.5, None, "a", 2, 4)], schema)
    found = rows.select(F.size(readings.brand_lines()).alias("b"), F.size(readings.shop_lines()).alias("s")).collect()
    assert [tuple(r) for r in found] == [(0, 0), (0, 6), (5, 6)]
    none = spark.createDataFrame([], "g string, rk int, label string, n long")
    assert readings.category_lines(none, "g").collect() == []
    counts, units = none.withColumnRenamed("label", "scenario"), spark.createDataFrame([("x", 0)], "g string, n_texts long")
    assert readings.scenario_lines(counts, units, "g").collect() == []
    assert readings.scenario_lines(counts.drop("g"), units.drop("g")).collect() == []
    one = spark.createDataFrame([(1, "早餐", 3)], "rk int, scenario string, n long")
    (row,) = readings.scenario_lines(one, spark.createDataFrame([(8,)], "n_texts long")).collect()
    assert row.lines == ["用户自述的用途/场景（基于预设词组，**非语义分类**）：「早餐」约 **3** 条（占有效文本 **38%**）。"]


def test_table_rows_go_by_text(spark):
    rows = spark.createDataFrame([("g", 0, "9", "a|b"), ("g", 1, "10", None), ("g", 2, "10", "long text"), (None, 3, None, "x")], "group string, row_index long, sku_id string, title string")
    found = readings.matrix_lines(rows, {"sku_id": 9, "title": 4}).collect()
    assert {(r.group, r.place, r.line) for r in found} == {("g", 0, "| 10 |  |"), ("g", 1, "| 10 | long… |"), ("g", 2, "| 9 | a/b |"), (None, 0, "|  | x |")}


def test_records_show_no_secret(spark):
    jobs = spark.createDataFrame(
        [(1, "success", "pin=1", "r", "s3cret"), (2, "success", None, " ", ""), (3, None, "", "r", ""), (4, "cancelled", " ", "none", ""), (5, "running", "x", "r", "")],
        "id long, status string, cookie_text string, run_dir string, other string",
    )
    files = spark.createDataFrame([("r", "comments_flat.csv"), ("r", "comments_flat.csv"), ("r", "else.txt"), (None, "comments_flat.csv"), ("q", None)], "run_dir string, file string")
    found = records.job_records(jobs, files)
    assert found.columns == ["id", "status", "run_dir", "inline_cookie_used", "analysis_artifacts"]
    got = {r.id: (r.inline_cookie_used, r.analysis_artifacts and [k for k, v in r.analysis_artifacts.asDict().items() if v]) for r in found.collect()}
    assert got == {1: (True, ["comments"]), 2: (False, None), 3: (False, None), 4: (False, []), 5: (True, None)}
    assert records.job_records(jobs.limit(0), files.limit(0)).collect() == []


def test_statistics_without_rows(spark):
    rows = spark.createDataFrame([(1,)], "n long")
    assert sinks.run_metadata({}, {"a": rows}, {"s": rows, "t": rows.limit(0)}) == '{\n  "s": {\n    "n": 1\n  },\n  "t": null,\n  "a_rows": 1\n}'
