"""What is shown of a job: its settings and state, never its secrets, and which of its files are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.text import strip

# The shown columns of a job, and the files of a run by name.
SHOWN = (
    "id", "platform", "keyword", "max_skus", "page_start", "page_to", "pipeline_run_dir", "cookie_file_path", "pvid", "request_delay", "list_pages",
    "scenario_filter_enabled", "report_config", "status", "cancellation_requested", "run_dir", "error_message", "created_at", "updated_at",
)
ARTIFACTS = {
    "merged": "keyword_pipeline_merged.csv",
    "pc_search": "pc_search_export.csv",
    "comments": "comments_flat.csv",
    "detail_ware": "detail_ware_export.csv",
    "report": "competitor_analysis.md",
}
FINISHED = ("success", "cancelled")


def job_records(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """PRJ12: the shown columns of each job, inline_cookie_used, and analysis_artifacts, a struct of flags.

    files has a row (run_dir, file) for each file of a run; it may name a file more than once. The flags are null unless the job is
    finished and has a folder. Shown columns that jobs lacks are left out; others, the cookie's text among them, never pass.
    Only jobs with flags take part in the join, so the many without a folder meet in no task.
    """
    shown = [c for c in SHOWN if c in jobs.columns]
    rows = jobs.select(*shown, (strip("cookie_text") != "").alias("inline_cookie_used"), strip("run_dir").alias("_dir"))
    has = (F.col("_dir") != "") & F.coalesce(F.col("status").isin(*FINISHED), F.lit(False))
    known = files.where(F.col("file").isin(*ARTIFACTS.values())).groupBy(strip("run_dir").alias("_dir"))
    flags = known.agg(*[F.max(F.col("file") == name).alias(f"_{key}") for key, name in ARTIFACTS.items()])
    of = F.struct(*[F.coalesce(F.col(f"_{key}"), F.lit(False)).alias(key) for key in ARTIFACTS])
    own = rows.where(has).join(flags, "_dir", "left").select(*shown, "inline_cookie_used", of.alias("analysis_artifacts"))
    return own.unionByName(rows.where(~has).select(*shown, "inline_cookie_used"), allowMissingColumns=True)
