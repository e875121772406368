"""Queries on comments: words, scenarios, tones, attribution, previews and the wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.category import group_key
from tallyshelf.operators import lexicon, merge
from tallyshelf.operators.chunks import chunked, spread
from tallyshelf.plans.inputs import LISTING, PATH, at, line_rows, listing, named, products, texts
from tallyshelf.plans.registry import register
from tallyshelf.sources.tables import table

FOCUS = ("the", "and", "tion", "eau", "nicht", "pour", "que", "a", "los", "the")
SCENES = (("articles", ("the ", "der ", "les ", "los ")), ("links", ("http", "www")), ("waiting", ("pour", "für", "para", "for ")), ("never", ("zzqq",)))
GOOD, BAD = ("tion", "pour", "nicht", "con "), ("eau", "sch", "password", "que ")
GOOD_SHOWN, BAD_SHOWN = ("tion", "nicht", "pour"), ("eaux", "eau", "sch", "que ")


def count_of(word: str) -> str:
    return f"((length(text) - length(replace(text, '{word}', ''))) // {len(word)})"


def focus_sql(source: str, group: str = "") -> str:
    """SQL of AGG11 for rows of source."""
    distinct = [w for w in dict.fromkeys(FOCUS) if len(w) > 1]
    first = {w: FOCUS.index(w) for w in distinct}
    g = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    part = f"PARTITION BY {group} " if group else ""
    rows = " UNION ALL ".join(f"SELECT {g}{first[w]} AS place, '{w}' AS word, CAST({FOCUS.count(w)} * sum({count_of(w)}) AS BIGINT) AS n FROM {source}{by}" for w in distinct)
    return f"SELECT {g}CAST(row_number() OVER ({part}ORDER BY n DESC, place) AS INTEGER) AS rk, word, n FROM ({rows}) AS w WHERE n > 0"


@register(focus_sql("documents"))
def focus_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11: occurrences of words; one of a single letter never counts, one listed twice counts twice."""
    return lexicon.focus_hits(texts(spark, sf_dir), "text", FOCUS)


@register(focus_sql("documents", "lang"))
def focus_hits_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: by group; English texts are only in the fallback, so their group needs it, and the others do not."""
    rows = texts(spark, sf_dir)
    return lexicon.focus_hits_by_or(rows.where("lang <> 'en'"), rows, "text", "lang", FOCUS)


@register(focus_sql("conversations"))
def focus_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: no hit in the short texts at hand, so the fallback's hits count."""
    short = texts(spark, sf_dir).select(F.col("lang").alias("text")).where("text <> 'fr'")
    return lexicon.focus_hits_or(short.select(F.upper("text").alias("text")), table(spark, sf_dir, "conversations").select("text"), "text", FOCUS)


def held(word: str) -> str:
    return f"position('{word}' IN text) > 0"


def any_of(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(map(held, words)) + ")"


def scenario_sql(group: str = "") -> str:
    g, by, part = (f"{group}, ", f" GROUP BY {group}", f"PARTITION BY {group} ") if group else ("", "", "")
    rows = " UNION ALL ".join(
        f"SELECT {g}{i} AS place, '{label}' AS scenario, count(*) FILTER (WHERE {any_of(t)}) AS n, count(*) AS total, min(CASE WHEN {any_of(t)} THEN doc_id END) AS first FROM documents{by}"
        for i, (label, t) in enumerate(SCENES)
    )
    rk = f"CAST(row_number() OVER ({part}ORDER BY n DESC, first, place) AS INTEGER) AS rk"
    return f"SELECT {g}{rk}, scenario, n, round(n / CAST(total AS DOUBLE), 6) AS share FROM ({rows}) AS s WHERE n > 0"


@register(scenario_sql())
def scenario_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10, AGG25, JON9: texts by scenario; one text may count for several."""
    return lexicon.scenario_counts(texts(spark, sf_dir), "text", F.col("doc_id"), SCENES)


@register(scenario_sql("lang"))
def scenario_share_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.scenario_counts(texts(spark, sf_dir), "text", F.col("doc_id"), SCENES, "lang")


@register(f"""
WITH t AS (SELECT lang, {any_of(GOOD)} AS g, {any_of(BAD)} AS b FROM documents)
SELECT lang, count(*) AS text_units, count(*) FILTER (WHERE g AND NOT b) AS positive_only, count(*) FILTER (WHERE b AND NOT g) AS negative_only,
  count(*) FILTER (WHERE g AND b) AS mixed_positive_and_negative, count(*) FILTER (WHERE NOT g AND NOT b) AS neutral_or_empty FROM t GROUP BY lang
""")
def sentiment_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16."""
    return lexicon.tones(texts(spark, sf_dir), "text", GOOD, BAD, "lang")


def phrases_sql(words: tuple[str, ...], scope: tuple[str, ...], tone: str) -> str:
    listed = sorted(words, key=lambda w: -len(w))
    rows = " UNION ALL ".join(f"SELECT '{w}' AS word, {i} AS place, count(*) AS n, min(doc_id) AS first FROM documents WHERE {any_of(scope)} AND {held(w)}" for i, w in enumerate(listed))
    return f"SELECT CAST(row_number() OVER (ORDER BY n DESC, first, place) AS INTEGER) AS rk, word, n, '{tone}' AS tone FROM ({rows}) AS p WHERE n > 0"


@register(phrases_sql(GOOD_SHOWN, GOOD, "positive") + " UNION ALL " + phrases_sql(BAD_SHOWN, BAD, "negative"))
def lexeme_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17, SET11."""
    return lexicon.tone_phrase_hits(texts(spark, sf_dir), "text", F.col("doc_id"), GOOD, BAD, GOOD_SHOWN, BAD_SHOWN)


@register(f"""
WITH s AS (SELECT doc_id, trim(text, E' \\t\\n\\r') AS text FROM documents), t AS (SELECT doc_id, text, CASE WHEN {any_of(GOOD)} AND {any_of(BAD)} THEN 'mixed' WHEN {any_of(GOOD)} THEN 'positive' WHEN {any_of(BAD)} THEN 'negative' END AS tone FROM s WHERE text <> ''),
  f AS (SELECT tone, text, min(doc_id) AS first FROM t WHERE tone IS NOT NULL GROUP BY tone, text),
  r AS (SELECT tone, text, row_number() OVER (PARTITION BY tone ORDER BY first) AS rk FROM f)
SELECT tone, CAST(rk AS INTEGER) AS rk, CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END AS sample FROM r WHERE rk <= CASE WHEN tone = 'mixed' THEN 8 ELSE 14 END
""")
def sentiment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18."""
    return lexicon.tone_samples(texts(spark, sf_dir), "text", F.col("doc_id"), GOOD, BAD)


SCOPE = {"first": ("red", "blue"), "second": ("Brand#1", "ring")}
TAGGED = """tagged AS (SELECT p_partkey, p_name, p_brand, (position('red' IN t) > 0 OR position('blue' IN t) > 0) AS a, (position('Brand#1' IN t) > 0 OR position('ring' IN t) > 0) AS b
  FROM (SELECT *, p_name || chr(10) || p_brand AS t FROM part) AS p), tags AS (SELECT *, CASE WHEN a AND b THEN '4.1+4.2' WHEN a THEN '4.1' WHEN b THEN '4.2' ELSE '' END AS scope_tag FROM tagged)"""


@register(f"WITH {TAGGED} SELECT p_partkey, scope_tag FROM tags WHERE scope_tag <> ''")
def keyword_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1-FLT3."""
    return lexicon.in_scope(table(spark, sf_dir, "part"), ["p_name", "p_brand"], **SCOPE).select("p_partkey", "scope_tag")


@register(f"WITH {TAGGED} SELECT scope_tag, count(*) AS n FROM tags WHERE scope_tag <> '' GROUP BY scope_tag")
def scope_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG24."""
    return lexicon.in_scope(table(spark, sf_dir, "part"), ["p_name", "p_brand"], **SCOPE).groupBy("scope_tag").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {TAGGED} SELECT count(*) AS input_rows, count(*) FILTER (WHERE scope_tag <> '') AS kept_rows, count(*) FILTER (WHERE scope_tag = '') AS dropped_rows FROM tags")
def scope_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1: what the filter takes in, keeps and drops."""
    return lexicon.scope_stats(table(spark, sf_dir, "part"), ["p_name", "p_brand"], **SCOPE)


@register("""
WITH c AS (SELECT lang, text FROM documents WHERE lang <> 'en' AND trim(text, E' \\t\\n\\r') <> ''), p AS (SELECT lang, text FROM documents WHERE trim(text, E' \\t\\n\\r') <> ''),
  u AS (SELECT lang FROM c UNION ALL SELECT lang FROM p WHERE lang NOT IN (SELECT lang FROM c))
SELECT lang, count(*) AS n FROM u GROUP BY lang
""")
def text_units_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14, AGG15: a group without texts of its own counts the previews instead."""
    rows = texts(spark, sf_dir)
    units = lexicon.text_units(rows.where("lang <> 'en'").select("lang", "text"), rows.select("lang", "text"), "text", "lang")
    return units.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


OF_SKU = f"""of_sku AS (SELECT p_partkey AS sku, CASE p_size % 5 WHEN 0 THEN '未归类（无类目路径）' ELSE p_type END AS grp, {PATH} AS category FROM part),
  said AS (SELECT doc_id, coalesce(grp, '未归类（评价 SKU 无对应深入样本）') AS grp FROM documents LEFT JOIN of_sku ON doc_id = sku)"""


def said(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = products(spark, sf_dir).withColumn("group", group_key("category"))
    of_sku = merge.groups_of_skus(parts.withColumn("sku", F.col("p_partkey").cast("string")), "sku", F.col("group"), F.col("p_partkey"))
    comments = texts(spark, sf_dir).withColumn("sku", F.col("doc_id").cast("string"))
    return parts, merge.attributed(comments, of_sku, "sku")


@register(f'WITH {OF_SKU} SELECT doc_id, grp AS "group" FROM said')
def comment_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON3: each comment with its product's group, or the group for those whose product is not in the sample."""
    return said(spark, sf_dir)[1].select("doc_id", "group")


@register(f"""
WITH {OF_SKU}, p AS (SELECT grp, count(*) AS n_products FROM of_sku GROUP BY grp), c AS (SELECT grp, count(*) AS n_comments FROM said GROUP BY grp),
  b AS (SELECT coalesce(p.grp, c.grp) AS grp, n_products, coalesce(n_comments, 0) AS n_comments FROM p FULL JOIN c ON p.grp = c.grp),
  o AS (SELECT *, CASE WHEN n_products IS NULL THEN 1 ELSE 0 END AS extra, CASE WHEN n_products IS NOT NULL AND starts_with(grp, '未归类') THEN 1 ELSE 0 END AS late FROM b)
SELECT CAST(row_number() OVER (ORDER BY extra, late, -coalesce(n_products, n_comments), grp) - 1 AS INTEGER) AS place, grp AS "group", coalesce(n_products, 0) AS n_products, n_comments FROM o
""")
def attribution_group_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON4, JON5: groups of products, then other groups of comments."""
    return merge.feedback_groups(*said(spark, sf_dir))


ROLLUP = """pieces AS (SELECT conv_id, turn, left(trim(text, E' \\t\\n\\r'), 400) AS piece FROM conversations),
  shown AS (SELECT conv_id, string_agg(piece, ' | ' ORDER BY turn) AS joined FROM pieces WHERE turn < 8 AND piece <> '' GROUP BY conv_id),
  rollup_ AS (SELECT c.conv_id, CAST(count(*) AS VARCHAR) AS comment_count, left(coalesce(max(joined), ''), 4000) AS comment_preview FROM conversations AS c LEFT JOIN shown ON c.conv_id = shown.conv_id GROUP BY c.conv_id)"""


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.comment_rollup(table(spark, sf_dir, "conversations"), "conv_id", "text", F.col("turn"))


@register(f"WITH {ROLLUP} SELECT * FROM rollup_")
def comment_rollup_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19."""
    return rollup(spark, sf_dir)


@register(f"""
WITH {LISTING}, {ROLLUP}, f AS (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rk FROM listing)
SELECT CAST(p_partkey AS VARCHAR) AS sku_id, coalesce(shop_name, '') AS shop_name, coalesce(page, '') AS page, p_brand AS detail_brand,
  coalesce(comment_count, '0') AS comment_count, coalesce(comment_preview, '') AS comment_preview
FROM part LEFT JOIN f ON f.sku_id = CAST(p_partkey AS VARCHAR) AND rk = 1 LEFT JOIN rollup_ ON conv_id = p_partkey
""")
def merge_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON1, JON2: first listing row, details and comments of each product, blanks where a side has nothing."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sku_id"), F.col("p_brand").alias("detail_brand"))
    said = rollup(spark, sf_dir).withColumn("sku_id", F.col("conv_id").cast("string")).drop("conv_id")
    lines = line_rows(spark, sf_dir).drop("price", "flag")
    wide = merge.merged(parts, lines, parts, said, at(), lambda first: named(first, spark, sf_dir).select("sku_id", "shop_name", "page"))
    return wide.select("sku_id", "shop_name", "page", "detail_brand", "comment_count", "comment_preview")


@register("""
WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(trim(text, E' \\t\\n\\r')) + 1 AS n FROM conversations WHERE trim(text, E' \\t\\n\\r') <> ''),
  r AS (SELECT conv_id, i, 0 AS chunk, n AS characters FROM s WHERE i = 1
    UNION ALL SELECT s.conv_id, s.i, chunk + CASE WHEN characters + n > 2000 THEN 1 ELSE 0 END, CASE WHEN characters + n > 2000 THEN n ELSE characters + n END
    FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS texts, CAST(max(characters) AS BIGINT) AS characters FROM r GROUP BY conv_id, chunk
""")
def comment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10: conversations in chunks of 2,000 characters."""
    return chunked(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn", 2000)


#: One chunk after the other: each starts where the running total first exceeds what stood before the last one's start by 400.
STATUS_CHUNKS = """RECURSIVE s AS (SELECT o_orderstatus AS status, row_number() OVER w AS i, length(o_orderpriority) + 1 AS n, sum(length(o_orderpriority) + 1) OVER w AS p
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)),
  nx AS (SELECT a.status, a.i, a.p - a.n AS before, b.i AS following, b.p - b.n AS upto FROM s AS a ASOF LEFT JOIN s AS b ON a.status = b.status AND a.p - a.n + 400 < b.p),
  ends AS (SELECT status, max(i) AS last, max(p) AS total FROM s GROUP BY status),
  r AS (SELECT status, 0 AS chunk, i, before, following, upto FROM nx WHERE i = 1
    UNION ALL SELECT nx.status, chunk + 1, nx.i, nx.before, nx.following, nx.upto FROM r JOIN nx ON nx.status = r.status AND nx.i = r.following),
  chunks AS (SELECT status, CAST(chunk AS BIGINT) AS chunk, CAST(coalesce(following, last + 1) - i AS BIGINT) AS texts, CAST(coalesce(upto, total) - before AS BIGINT) AS characters FROM r JOIN ends USING (status))"""


def status_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_orderkey", 400, 400).withColumnRenamed("o_orderstatus", "status")


@register(f"WITH {STATUS_CHUNKS} SELECT * FROM chunks")
def chunks_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10: the priorities of orders in chunks of 400 characters, three groups of many runs each."""
    return status_chunks(spark, sf_dir)


@register(f"WITH {STATUS_CHUNKS}, c AS (SELECT *, count(*) OVER (PARTITION BY status) AS m FROM chunks) SELECT status, chunk, texts, characters FROM c WHERE m <= 12 OR chunk IN (SELECT (i * c.m) // 12 FROM range(12) AS x(i))")
def chunks_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9: of each status twelve chunks at even distances."""
    return spread(status_chunks(spark, sf_dir), "status")
