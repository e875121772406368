"""Exact deduplication by 128-bit content hash, with bytes compared inside groups.

Texts are equal when identical after lower-casing A-Z. Rows group by the first 128 bits of the
SHA-256 of that form, and inside a hash's group by the bytes: a hash with more than one text is divided by
the texts themselves. The groups hold numbers only, so texts are neither sorted nor carried along, and
rows aggregate before the shuffle: a text with a third of all rows sends one row a task.

Defined cases: a null text is the empty one; empty texts are equal to each other; of equal texts the
largest doc_id stays, null only if the group has no other; rows that repeat with the same doc_id and
text all name that doc_id as the one that stays, and exactly one of them is marked kept by
``deduplicated``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import ascii_lower, keep


def normal(text: str = "text") -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def content_key(sha: Column) -> Column:
    """The first 128 bits of a SHA-256 in hexadecimal digits."""
    return F.unhex(F.substring(sha, 1, 32))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, the normalised text, its SHA-256 and the 128-bit key."""
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    out = docs.select("doc_id", normal().alias("norm")).withColumn("text_sha256", sha)
    return out.withColumn("key", content_key(F.col("text_sha256")))


def groups(docs: DataFrame, pick: str = "max") -> DataFrame:
    """One row per distinct text: key, keep_id, group_size and, where hashes collide, the text (else null)."""
    best = F.max("doc_id") if pick == "max" else F.min("doc_id")
    size = F.count(F.lit(1)).alias("group_size")
    rows = hashed(docs)
    by_text = rows.groupBy("key", "norm").agg(best.alias("keep_id"), size)
    found = keep(by_text.select("key", "keep_id", "group_size"), "content-groups")
    collided = found.groupBy("key").count().where("count > 1").select("key")
    whole = found.select("key", F.lit(None).cast("string").alias("norm"), "keep_id", "group_size")
    if collided.isEmpty():
        return whole
    parts = rows.join(collided, "key", "left_semi").groupBy("key", "norm").agg(best.alias("keep_id"), size)
    return whole.join(collided, "key", "left_anti").unionByName(parts)


def membership(docs: DataFrame, pick: str = "max") -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256."""
    found = groups(docs, pick).withColumnRenamed("norm", "of_text")
    rows, split = hashed(docs), not found.where("of_text is not null").isEmpty()
    if split:
        same = (rows["key"] == found["key"]) & (found["of_text"].isNull() | (found["of_text"] == rows["norm"]))
        both = rows.join(found, same).drop(found["key"])
    else:
        both = rows.drop("norm").join(found.drop("of_text"), "key")
    return both.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, pick: str = "max") -> DataFrame:
    """The rows that stay, with all columns of docs; one of several rows that share doc_id and text.

    The whole row travels with its key through one aggregation, which combines before the shuffle.
    """
    cols = docs.columns
    order = F.col("doc_id") if pick == "max" else -F.col("doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    keyed = docs.select(row.alias("row"), order.alias("ord"), normal().alias("norm"))
    keyed = keyed.withColumn("key", content_key(F.sha2(F.col("norm").cast("binary"), 256)))
    best = F.max_by("row", F.struct(F.col("ord").isNotNull(), "ord")).alias("row")
    split = groups(docs, pick).where("norm is not null").select("key")
    if split.isEmpty():
        out = keyed.groupBy("key").agg(best)
    else:
        marked = keyed.join(split.distinct().withColumn("c", F.lit(True)), "key", "left")
        out = marked.groupBy("key", F.when(F.col("c"), F.col("norm")).alias("part")).agg(best)
    return out.select("row.*")
