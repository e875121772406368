"""What a user of the store looks at: the relations of jobs page by page with their columns, products, and their history."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.text import strip
from tallyshelf.operators.catalog import KEY, clamped, containing, has_content, kept_columns, newest, page_of, with_member, with_snapshot_counts

FIXED = ("id", "row_index")
#: Columns that the product search looks into.
SEARCHED = ("sku_id", "title", "detail_brand")


def described(rows: DataFrame, headers: dict[str, str], *by: str) -> DataFrame:
    """BRW2, AGG26: per job n_rows and columns, the key and label of each column that is not blank throughout, in the order of headers.

    One aggregation over all jobs and columns; columns that rows lacks are left out.
    """
    held = [(label, c) for label, c in headers.items() if c in rows.columns]
    flags = [F.bool_or(has_content(rows, c)).alias(f"c{i}") for i, (_, c) in enumerate(held)]
    pairs = [F.when(F.col(f"c{i}"), F.struct(F.lit(c).alias("key"), F.lit(label).alias("label"))) for i, (label, c) in enumerate(held)]
    listed = F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<struct<key:string,label:string>>")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *flags).select(*by, "n_rows", listed.alias("columns"))


def summary(relations: dict[str, tuple[DataFrame, dict[str, str]]], *by: str) -> DataFrame:
    """CAT5: described() of several relations, each with its headers, under its name; a job that has no rows of a relation has no row for it."""
    parts = [described(rows, headers, *by).select(*by, F.lit(name).alias("relation"), "n_rows", "columns") for name, (rows, headers) in relations.items()]
    return reduce(DataFrame.unionByName, parts)


def export_columns(rows: DataFrame, headers: dict[str, str]) -> dict[str, str]:
    """BRW3, BRW4: internal name to header of the columns that an export has: the fixed ones, then the filled ones in the order of headers."""
    labels = {c: label for label, c in headers.items()}
    own = rows.select(*[c for c in (*FIXED, *labels) if c in rows.columns])
    return {c: labels.get(c, c) for c in kept_columns(own, FIXED)}


def sparse_row(rows: DataFrame, headers: dict[str, str]) -> Column:
    """PRJ6: a row as a map from header to cell, without blank cells and columns that rows lacks."""
    cells = [x for label, c in headers.items() if c in rows.columns for x in (F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.map_filter(F.create_map(*cells), lambda _, v: strip(v) != "")


def as_sheet(rows: DataFrame, headers: dict[str, str]) -> DataFrame:
    """PRJ9: the fixed columns, then those of headers under their labels."""
    own = [F.col(c).alias(label) for label, c in headers.items() if c in rows.columns]
    return rows.select(*[c for c in FIXED if c in rows.columns], *own)


def browsed(rows: DataFrame, page: int | None = 1, size: int | None = 50, sku_id: str = "") -> dict[str, Any]:
    """CAT5, WIN5, FLT4: one page of a relation in order of row_index, with the number of all rows; of one product if sku_id is not blank."""
    wanted = sku_id.strip()
    chosen = rows.where(F.col("sku_id") == wanted) if wanted else rows
    return {
        "total": chosen.count(),
        "page": max(1, page or 1),
        "page_size": clamped(size, 1, 200, 50),
        "results": page_of(chosen, ["row_index"], page, size),
    }


def product_list(products: DataFrame, snaps: DataFrame, query: str = "", keyword: str = "", limit: int | None = 50, offset: int | None = 0) -> dict[str, Any]:
    """CAT4: products that contain the query and whose payload has the keyword, the last changed first, with their numbers of snapshots.

    Only the snapshots of the page's products, 200 at most, are counted.
    """
    chosen = containing(products, list(SEARCHED), query)
    chosen = with_member(chosen, "current_payload", "pipeline_keyword", keyword.strip()) if keyword.strip() else chosen
    shown = newest(chosen, "last_captured_at", "sku_id", limit, offset)
    of_shown = snaps.join(F.broadcast(shown.select(*KEY)), list(KEY), "left_semi")
    return {
        "total": chosen.count(),
        "limit": clamped(limit, 1, 200, 50),
        "offset": max(0, offset or 0),
        "results": with_snapshot_counts(shown, of_shown).orderBy(F.desc("last_captured_at"), "sku_id"),
    }


def of_product(rows: DataFrame, platform: str, sku_id: str) -> DataFrame:
    return rows.where((F.col("platform") == platform) & (F.col("sku_id") == sku_id))


def product(products: DataFrame, snaps: DataFrame, platform: str, sku_id: str) -> DataFrame:
    """CAT4: one product with the number of its snapshots; LookupError if there is none."""
    found = of_product(products, platform, sku_id)
    if found.isEmpty():
        raise LookupError(f"{platform} {sku_id}")
    return with_snapshot_counts(found, of_product(snaps, platform, sku_id))


def history(snaps: DataFrame, platform: str, sku_id: str) -> DataFrame:
    """CAT4, WIN8: a product's snapshots without their payloads, the newest first, of equal times by job."""
    return of_product(snaps, platform, sku_id).drop("payload").orderBy(F.desc("captured_at"), "job")


def snapshot(snaps: DataFrame, platform: str, sku_id: str, job: str) -> DataFrame:
    """CAT4: one snapshot with its payload; LookupError if there is none."""
    found = of_product(snaps, platform, sku_id).where(F.col("job") == job)
    if found.isEmpty():
        raise LookupError(f"{platform} {sku_id} {job}")
    return found
