"""The brief: a small nested document from the statistics of one run, its summary and its compact form.

Each section is a DataFrame with a bounded number of rows and reaches the driver by itself; only the matrix
has a row for each product of the run's merged table, which a run bounds. Where it may be larger, it is written as a
table and the brief has an overview of its groups.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyshelf.functions.category import category_cell, chart_slug, group_key, is_unclassified, top_segment
from tallyshelf.functions.text import filled, first_filled, strip
from tallyshelf.operators import lexicon, merge, stats
from tallyshelf.operators.rank import concentration, top_labels
from tallyshelf.operators.taxonomy import list_category

# The texts of the hints.
HINTS = {
    "concentrated": "样本内品牌集中度较高（第一大品牌份额偏高），头部玩家占据显著曝光；新原料/解决方案宜明确差异化价值主张（**需线下渠道与招商信息交叉验证**）。",
    "fragmented": "样本内品牌较分散，品类或关键词下竞争格局未固化，存在定位与叙事空间（**需扩大样本页数与关键词矩阵验证**）。",
    "spread": "价格离散度较高，同时存在偏低价与偏高价陈列，可分别对标「性价比带」与「品质/功能带」竞品（**终端到手价受促销影响，非成本结构**）。",
    "topics": "评价文本中「{topics}」等主题出现较多，可作为消费者沟通与产品卖点的假设输入（**非严格主题模型，建议人工抽样复核**）。",
    "few_comments": "有效评价样本偏少，消费者洞察部分仅作方向参考，正式结论建议加大 SKU 数或评论分页。",
    "scenario": "用途/场景中「{scenario}」在约 {share:.0f}% 的有效评价自述中出现，可作为沟通场景与卖点的优先假设（**词组规则，建议抽样核对原句**）。",
    "none": "当前样本下自动规则未触发强信号；请结合业务目标人工解读对比矩阵与原始 CSV。",
}
NOTES = (
    "与在线分析报告各章统计口径一致；主题词与场景为预设词表，非 NLP 主题模型。",
    "价格来自页面展示字段抽取，含促销与规格差异。",
    "comment_sentiment_lexicon 为关键词粗判，非深度学习情感模型。",
)
META_KEYS = ("page_start", "page_to", "max_skus_config", "pc_search_export_rows", "merged_rows", "scenario_filter_enabled", "merged_csv_mode")
PRICE_CELLS = ("detail_price_final", "price", "coupon_price")
#: Products of a group that its overview looks at, and brands that it names.
OVERVIEW_ROWS, OVERVIEW_BRANDS = 100, 15
CAPS = ((120, 24), (80, 20), (40, 16), (30, 12), (18, 10), (10, 8), (5, 6), (0, 6))


def _texts(raw: Any, most: int, longest: int) -> list[str]:
    cells = (str(x).strip()[:longest] for x in (raw if isinstance(raw, list | tuple) else [])[:most])
    return [x for x in cells if x]


@dataclass(frozen=True)
class Tuning:
    """STR32, UDF1, JOB2: what a user may set for a report; defaults where nothing usable is given."""

    focus_words: tuple[str, ...] = lexicon.FOCUS_WORDS
    scenarios: lexicon.Groups = lexicon.SCENARIOS
    market_rows: tuple[tuple[str, str, str, str], ...] = field(default=())

    @staticmethod
    def of(config: dict[str, Any] | None) -> Tuning:
        config = config or {}
        words = tuple(_texts(config.get("comment_focus_words"), 120, 48))
        groups = []
        for item in (config.get("comment_scenario_groups") or [])[:40] if isinstance(config.get("comment_scenario_groups"), list) else []:
            pair = (item.get("label"), item.get("triggers")) if isinstance(item, dict) else tuple(item)[:2] if isinstance(item, list | tuple) and len(item) > 1 else (None, None)
            label, triggers = str(pair[0] or "").strip()[:80], tuple(_texts(pair[1], 48, 48))
            groups += [(label, triggers)] if label and triggers else []
        market = []
        for item in (config.get("external_market_table_rows") or [])[:24] if isinstance(config.get("external_market_table_rows"), list) else []:
            if isinstance(item, dict):
                row = tuple(str(item.get(a) or item.get(b) or "").strip()[:500] for a, b in (("indicator", "a"), ("value_and_scope", "b"), ("source", "c"), ("year", "d")))
                market += [row] if any(row) else []
            elif isinstance(item, list | tuple) and len(item) >= 4:
                market.append(tuple(str(x)[:500] for x in item[:4]))
        return Tuning(words or lexicon.FOCUS_WORDS, tuple(groups) or lexicon.SCENARIOS, tuple(market))

    def with_suggested(self, suggested: list[str], own: list[str] | None) -> Tuning:
        """STR33: suggestions behind the user's own words; without own words they stand alone."""
        words = list(own or [])
        words += [w for w in suggested if w not in words]
        return Tuning(tuple(words[:80]) or self.focus_words, self.scenarios, self.market_rows)


ALLOWED = ("llm_comment_focus_words", "comment_focus_words", "comment_scenario_groups", "external_market_table_rows")


def validated(config: dict[str, Any], allowed: tuple[str, ...] = ALLOWED, longest: int = 120_000) -> dict[str, Any]:
    """JOB2: the configuration if it has allowed keys only and is not over long."""
    if unknown := sorted(set(config) - set(allowed)):
        raise ValueError(f"unknown keys: {unknown}")
    if len(json.dumps(config, ensure_ascii=False)) > longest:
        raise ValueError("the configuration is too long")
    return config


def tidy(x: Any) -> Any:
    """STA5: numbers that JSON has no form for become null, others have six decimals at most."""
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else None
    if isinstance(x, dict):
        return {k: tidy(v) for k, v in x.items()}
    return [tidy(v) for v in x] if isinstance(x, list) else x


def rows_of(df: DataFrame, *order: str) -> list[dict[str, Any]]:
    return [r.asDict(True) for r in df.orderBy(*order).collect()]


def _one(df: DataFrame) -> dict[str, Any]:
    found = df.limit(1).collect()
    return found[0].asDict(True) if found else {}


def _stats(df: DataFrame) -> dict[str, Any]:
    return {k: v for k, v in _one(stats.price_stats(df)).items() if v is not None}


def build(
    listing: DataFrame,
    products: DataFrame,
    comments: DataFrame,
    keyword: str = "",
    batch: str = "",
    run_dir: str = "",
    meta: dict[str, Any] | None = None,
    config: dict[str, Any] | None = None,
    result_counts: DataFrame | None = None,
    brand_column: str | None = None,
    matrix_path: str | None = None,
) -> dict[str, Any]:
    """JSN28: the brief of one run from its search list, merged table and comments, all with row_index.

    With matrix_path the products of the matrix are written there, as a table, and the brief has an overview: no product
    reaches the driver. Without it the brief holds them all.
    brand_column names the list's brand column where it has one; without it no brand shares of the list are given.
    """
    tuning, at = Tuning.of(config), F.col("row_index")
    n_list, n_products, n_comments = listing.count(), products.count(), comments.count()
    uses_list = n_list > 0
    rows = listing if uses_list else products
    shop = first_filled("shop_name") if uses_list else first_filled("detail_shop_name", "shop_name")
    brand = (first_filled(brand_column) if brand_column else F.lit("")) if uses_list else first_filled("detail_brand")
    category = category_cell("detail_category_path", "leaf_category", "attributes")
    products = products.withColumns({"category": category, "group": group_key(category)})

    def shares(df: DataFrame, label) -> dict[str, Any]:
        got = _one(concentration(df, label, at))
        pct = f"{100 * got['cr1']:.1f}%" if got.get("cr1") is not None else ""
        return {"cr1": got.get("cr1"), "cr3": got.get("cr3"), "top_label": got.get("top_label") or "", "top_share_pct": pct, "n": got.get("n_rows") or 0}

    shops, brands, deep = shares(rows, shop), shares(rows, brand), shares(products, first_filled("detail_brand"))
    labelled = list_category(rows, at) if uses_list else rows.withColumn("label", F.when(category != "", top_segment(category)))
    mix = lambda df, label, k: [{"label": r["label"], "count": r["n"]} for r in rows_of(top_labels(df, label, at, k), "rk")]
    of_list = _stats(stats.observations(listing, "price", "coupon_price")) if uses_list else {}
    of_products = _stats(stats.observations(products, *PRICE_CELLS))
    prices = of_list if of_list.get("n") else of_products

    texts = lexicon.text_units(
        comments.select("sku_id", F.col("tag_comment_content").alias("text"), "row_index"), products.select("sku_id", F.col("comment_preview").alias("text"), "row_index"), "text"
    )
    hits = rows_of(
        lexicon.focus_hits_or(comments.select(filled("tag_comment_content").alias("text")), products.select(filled("comment_preview").alias("text")), "text", tuning.focus_words), "rk"
    )
    n_texts = texts.count()
    scenarios = rows_of(lexicon.scenario_counts(texts, "text", at, tuning.scenarios), "rk")
    cr1 = shops["cr1"] if uses_list and shops["cr1"] is not None else deep["cr1"]
    num = lambda x: F.lit(x).cast("double")
    codes = stats.hint_codes(
        num(cr1), num(prices.get("mean")), num(prices.get("stdev")), num(len(hits)), num(n_comments), num(n_texts), num(scenarios[0]["n"] if scenarios else None)
    )
    codes = comments.sparkSession.range(1).select(codes.alias("c")).first().c
    say = {"topics": "、".join(h["word"] for h in hits[:3])}
    if scenarios:
        say |= {"scenario": scenarios[0]["scenario"], "share": 100 * scenarios[0]["n"] / n_texts}

    tone = _one(lexicon.tones(texts, "text"))
    phrases = rows_of(lexicon.tone_phrase_hits(texts, "text", at), "tone", "rk")
    said = lambda t: [{"word": r["word"], "texts_matched": r["n"]} for r in phrases if r["tone"] == t]

    sample = (lexicon.GOOD_WORDS, lexicon.GOOD_PHRASES), (lexicon.BAD_WORDS, lexicon.BAD_PHRASES)
    raw = {"result_count_consensus": None, "list_keyword": None, "result_count_uniques": [], "raw_json_files_scanned": 0}
    if result_counts is not None:
        raw["raw_json_files_scanned"] = result_counts.count()
        raw["result_count_consensus"] = _one(stats.consensus(result_counts, "result_count", "file")).get("consensus")
        raw["list_keyword"] = result_counts.agg(F.min_by("list_keyword", F.when(F.col("list_keyword").isNotNull(), F.col("file")))).first()[0]
        raw["result_count_uniques"] = sorted(result_counts.agg(F.collect_set("result_count")).first()[0])

    proxy = {}
    if uses_list:
        proxy = _one(stats.visibility(listing, F.col("sku_id"), F.col("shop_name"), F.col("page"), F.col("leaf_category")))
        proxy["page_span"] = [proxy.pop("first_page"), proxy.pop("last_page")]
        proxy["list_price_stats"] = of_list

    return tidy(
        {
            "schema_version": 1,
            "keyword": keyword,
            "batch_label": batch,
            "run_dir": run_dir,
            "scope": {"merged_sku_count": n_products, "comment_flat_rows": n_comments, "structure_source_rows": rows.count(), "uses_pc_search_list_export": uses_list},
            "meta": {k: meta[k] for k in META_KEYS if k in meta} or None if meta else None,
            "pc_search_raw": raw,
            "list_visibility_proxy": proxy,
            "concentration": {
                "shops_from_list": {k: v for k, v in shops.items() if k != "n"},
                "list_brand_field": {k: brands[k] for k in ("cr1", "cr3", "top_label")} if brands["n"] >= stats.least_rows_for_brands(n_list or n_products) else None,
                "detail_brand_among_merged": {k: v for k, v in deep.items() if k != "n"},
            },
            "category_mix_top": mix(labelled, F.col("label"), 12 if uses_list else 8),
            "list_brand_mix_top": mix(rows, brand, 24),
            "list_shop_mix_top": mix(rows, shop, 24),
            "price_stats": prices,
            "price_stats_source": "pc_search_export_all_rows" if of_list.get("n") else "keyword_pipeline_merged",
            "price_stats_merged_sample": of_products,
            "price_stats_list_export": of_list,
            "comment_focus_keywords": [{"word": h["word"], "count": h["n"]} for h in hits[:24]],
            "usage_scenarios": [{"scenario": s["scenario"], "count": s["n"], "share_of_text_units": s["share"]} for s in scenarios[:16]],
            "usage_scenarios_denominator": n_texts,
            **_by_group(products, comments, tuning),
            "strategy_hints": [HINTS[c].format(**say) for c in codes],
            **_matrix_of(products, matrix_path),
            "comment_sentiment_lexicon": {
                "method": "keyword_lexicon",
                **tone,
                "positive_lexicon_sample": [*sample[0][0][:10], *sample[0][1][:5]],
                "negative_lexicon_sample": [*sample[1][0][:10], *sample[1][1][:5]],
                "positive_tone_lexeme_hits": said("positive"),
                "negative_tone_lexeme_hits": said("negative"),
            },
            "notes": list(NOTES),
        }
    )


def matrix_rows(products: DataFrame) -> DataFrame:
    """JSN27: group, row_index and the cells of each product of the matrix; products has group and category."""
    cells = {
        "sku_id": strip("sku_id"),
        "title": strip("title"),
        "brand": strip("detail_brand"),
        "list_price_show": strip("price"),
        "coupon_or_detail_price": strip("coupon_price"),
        "detail_price_final": strip("detail_price_final"),
        "shop": first_filled("shop_name", "detail_shop_name"),
        "category": F.col("category"),
        "selling_point": F.substring(strip("selling_point"), 1, 240),
        "comment_fuzzy": strip("comment_fuzzy"),
    }
    return products.select("group", "row_index", *[c.alias(k) for k, c in cells.items()])


def matrix_overview(rows: DataFrame) -> DataFrame:
    """WIN12: of each group of matrix rows sku_count and distinct_brands_sample, the first brands among its first hundred products."""
    counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("sku_count"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("row_index"))
    first = rows.select("group", "row_index", "brand").withColumn("place", place).where(F.col("place") <= OVERVIEW_ROWS)
    listed = first.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", "brand")))["brand"].alias("brands"))  # OVERVIEW_ROWS at most
    sample = F.slice(F.array_distinct(F.filter("brands", lambda b: b != "")), 1, OVERVIEW_BRANDS)
    return counts.join(listed, "group").select("group", "sku_count", sample.alias("distinct_brands_sample"))


def write_matrix(products: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """JSN27: the matrix as a table of buckets of groups, each file in row order, and its overview.

    A group lies in one bucket, spread over the files of the tasks that wrote it, so a group with a third of all products is written by all of them.
    """
    spark = products.sparkSession
    rows = matrix_rows(products).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
    rows.repartitionByRange("bucket", "group", "row_index").sortWithinPartitions("bucket", "group", "row_index").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return matrix_overview(spark.read.schema(rows.schema).parquet(path))


def matrix_of_group(spark: SparkSession, path: str, group: str, buckets: int = 64) -> DataFrame:
    """The rows of one group of a written matrix in order; other buckets are not read."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(group)), F.lit(buckets)).cast("int")).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("group") == group)).orderBy("row_index")


def _matrix(products: DataFrame) -> list[dict[str, Any]]:
    """JSN27, AGG23: the products of each group in row order, as one array a group."""
    rows = matrix_rows(products)
    cells = [c for c in rows.columns if c not in ("group", "row_index")]
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("sku_count"), F.array_sort(F.collect_list(F.struct("row_index", *cells))).alias("skus"))
    found = groups.orderBy(is_unclassified("group"), F.desc("sku_count"), "group").collect()
    return [{"group": g.group, "sku_count": g.sku_count, "skus": [{k: r[k] for k in cells} for r in g.skus]} for g in found]


def _matrix_of(products: DataFrame, path: str | None) -> dict[str, Any]:
    """The matrix in the brief, or, with a path, the groups' overview and where the products are."""
    if path is None:
        return {"matrix_by_group": _matrix(products)}
    groups = write_matrix(products, path).orderBy(is_unclassified("group"), F.desc("sku_count"), "group")
    return {"matrix_by_group": [], "matrix_path": path, "matrix_overview": [r.asDict(True) for r in groups.collect()]}


def _by_group(products: DataFrame, comments: DataFrame, tuning: Tuning) -> dict[str, Any]:
    """The feedback by group: counts of comments and texts, words and scenarios, with the fallback to previews decided by group."""
    at = F.col("row_index")
    of_sku = merge.groups_of_skus(products, "sku_id", F.col("group"), at)
    said = merge.attributed(comments.select("sku_id", F.col("tag_comment_content").alias("text"), "row_index"), of_sku, "sku_id")
    if products.isEmpty():
        said = said.withColumn("group", F.lit(merge.NO_MERGED))
    groups = merge.feedback_groups(products, said).withColumn("slug", chart_slug("group", "place"))
    previews = products.select("group", F.col("comment_preview").alias("text"), "row_index")
    texts = lexicon.text_units(said.select("group", "text", "row_index"), previews, "text", "group")
    units = {r.group: r.n for r in texts.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    words, uses = {}, {}
    fallback = texts.select("group", "text")
    for r in rows_of(lexicon.focus_hits_by_or(said.select("group", "text"), fallback, "text", "group", tuning.focus_words), "group", "rk"):
        words.setdefault(r["group"], []).append({"word": r["word"], "count": r["n"]})
    for r in rows_of(lexicon.scenario_counts(texts, "text", at, tuning.scenarios, "group"), "group", "rk"):
        uses.setdefault(r["group"], []).append({"scenario": r["scenario"], "count": r["n"], "share_of_text_units": r["share"]})
    feedback, usage = [], []
    for g in rows_of(groups, "place"):
        name = {"group": g["group"], "matrix_group_index": g["place"], "chart_slug": g["slug"]}
        found, n = uses.get(g["group"], []), units.get(g["group"], 0)
        feedback.append(
            name
            | {"comment_rows": g["n_comments"], "effective_comment_text_units": n, "focus_keyword_hits": words.get(g["group"], [])[:24], "scenarios_top": found[:6]}
        )
        if found:
            usage.append(name | {"effective_text_units": n, "scenarios": found})
    return {"usage_scenarios_by_matrix_group": usage, "consumer_feedback_by_matrix_group": feedback}


def overview(brief: dict[str, Any]) -> list[dict[str, Any]]:
    """WIN12: each group's size and the first brands among its first hundred products."""
    out = list(brief.get("matrix_overview") or [])
    for g in brief.get("matrix_by_group") or []:
        brands = dict.fromkeys(b for s in g["skus"][:OVERVIEW_ROWS] if (b := s["brand"].strip()))
        out.append({"group": g["group"], "sku_count": g["sku_count"], "distinct_brands_sample": list(brands)[:OVERVIEW_BRANDS]})
    return out


def compact(brief: dict[str, Any], max_chars: int = 350_000) -> dict[str, Any]:
    """WIN11: a copy that fits, as far as caps and leaving sections out in turn can make it, with the overview of the whole matrix."""
    small, whole = copy.deepcopy(brief), overview(brief)
    small["run_dir"] = "(已省略)"
    fits = lambda: len(json.dumps(small, ensure_ascii=False)) <= max_chars
    steps: list[Callable[[], None]] = []

    def capped(skus: int, groups: int) -> None:
        if "matrix_by_group" in small:
            small["matrix_by_group"] = [{**g, "skus": g["skus"][:skus]} for g in small["matrix_by_group"][:groups]]
        if "consumer_feedback_by_matrix_group" in small:
            small["consumer_feedback_by_matrix_group"] = small["consumer_feedback_by_matrix_group"][:groups]

    def omitted(key: str) -> None:
        small.pop(key, None)
        small[f"{key}_omitted"] = True

    def proxy_omitted() -> None:
        if small.get("list_visibility_proxy"):
            small["list_visibility_proxy"] = {"_omitted": True, "keys": list(small["list_visibility_proxy"])[:20]}

    steps += [lambda c=c: capped(*c) for c in CAPS]
    steps += [lambda: omitted("matrix_by_group"), lambda: omitted("consumer_feedback_by_matrix_group"), proxy_omitted]
    for step in steps:
        step()
        if fits():
            break
    return small | {"matrix_overview_for_llm": whole}


def percent(x: Any) -> str:
    return "—" if x is None else f"{100 * float(x):.1f}%"


def number(x: Any) -> str:
    return "—" if x is None else str(int(x)) if float(x) == int(x) else f"{x:.2f}"


def summary(brief: dict[str, Any]) -> str:
    """DOC4: the brief as a short Markdown text; sections without numbers are left out."""
    scope, shares, prices = brief["scope"], brief["concentration"], brief["price_stats"]
    parts: list[tuple[str, list[str]]] = [
        ("基本信息", [f"监测词：{brief['keyword'] or '—'}", f"批次：{brief['batch_label'] or '—'}"]),
        ("样本范围", [f"深入 SKU 数：{scope['merged_sku_count']}", f"评价条数：{scope['comment_flat_rows']}", f"列表行数：{scope['structure_source_rows']}"]),
    ]
    for title, key in (("店铺集中度", "shops_from_list"), ("品牌（深入样本）", "detail_brand_among_merged")):
        s = shares[key]
        parts.append((title, [f"CR1 {percent(s['cr1'])}（{s['top_label'] or '—'}）", f"CR3 {percent(s['cr3'])}"] if s["cr1"] is not None else []))
    if prices.get("n"):
        parts.append(("价格", [f"n {prices['n']}，{brief['price_stats_source']}", f"{number(prices['min'])} ～ {number(prices['max'])}，中位数 {number(prices.get('median', prices['mean']))}"]))
    parts.append(("类目结构", [f"{x['label']}：{x['count']}" for x in brief["category_mix_top"][:8]]))
    parts.append(("评价关注词", [f"{x['word']}：{x['count']}" for x in brief["comment_focus_keywords"][:10]]))
    parts.append(("用途/场景", [f"{x['scenario']}：{x['count']}（{percent(x['share_of_text_units'])}）" for x in brief["usage_scenarios"][:8]]))
    parts.append(("策略提示", brief["strategy_hints"]))
    return "# 竞品要点摘录\n\n" + "\n".join(f"## {title}\n\n" + "".join(f"- {x}\n" for x in lines) for title, lines in parts if lines)


def with_supplement(rules: str, supplement: str, marker: str = "\n---\n\n## 一、研究范围、数据来源与局限") -> str:
    """DOC6: the rules' report with the supplement before its first chapter, or at its start if it has none."""
    rules, supplement = rules.strip(), supplement.strip()
    if not rules or not supplement:
        return rules or supplement
    block = f"---\n\n## 大模型速读与策略要点（补充）\n\n{supplement}\n"
    return rules.replace(marker, f"\n{block}{marker}", 1) if marker in rules else f"{block}\n---\n\n{rules}"

