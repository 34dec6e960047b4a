"""Corpus statistics and limits over files (path, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MB = 1024 * 1024
UNITS = ("B", "KB", "MB", "GB", "TB")


def human_size(size: Column) -> tuple[Column, Column]:
    """(amount with 2 decimals, unit) of a number of bytes."""
    amount, unit = F.round(size / F.lit(1024.0**4), 2), F.lit(UNITS[-1])
    for k in reversed(range(len(UNITS) - 1)):
        small = size < F.lit(1024.0 ** (k + 1))
        amount, unit = F.when(small, F.round(size / F.lit(1024.0**k), 2)).otherwise(amount), F.when(small, UNITS[k]).otherwise(unit)
    return amount, unit


def corpus_stats(df: DataFrame, max_file_bytes: int) -> DataFrame:
    """One row: files, bytes, MB, amount and unit, oversized files."""
    total = df.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count_if(F.col("size") > max_file_bytes).alias("oversized_files"))
    amount, unit = human_size(F.col("total_bytes"))
    return total.select("total_files", "total_bytes", F.round(F.col("total_bytes") / MB, 6).alias("total_mb"), amount.alias("amount"), unit.alias("unit"), "oversized_files")


def oversized(df: DataFrame, max_file_bytes: int) -> DataFrame:
    return df.where(F.col("size") > max_file_bytes).select("path", "size")


def oversized_report(df: DataFrame, max_file_bytes: int, n: int = 5) -> DataFrame:
    """(rank, path, size) of the ``n`` largest oversized files and, if there are more, a row that says how many."""
    over = oversized(df, max_file_bytes)
    first = largest(over, n).select(F.row_number().over(Window.orderBy(F.desc("size"), "path")).cast("long").alias("rank"), "path", "size")  # n rows
    more = over.agg(F.count("*").alias("c")).where(F.col("c") > n)
    return first.unionByName(more.select(F.lit(n + 1).cast("long").alias("rank"), F.concat(F.lit("... and "), (F.col("c") - n).cast("string"), F.lit(" more")).alias("path"), F.lit(None).cast("long").alias("size")))


def largest(df: DataFrame, n: int = 5) -> DataFrame:
    return df.select("path", "size").orderBy(F.desc_nulls_last("size"), "path").limit(n)


def limit_check(stats: DataFrame, max_files: int, max_total_mb: float, warn_share: float = 0.8) -> DataFrame:
    """Rows (check_name, actual, limit_value, severity): error above a limit, warning above its 80 %."""
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), a.cast("double").alias("actual"), F.lit(float(m)).alias("limit_value")) for n, a, m in (("files", F.col("total_files"), max_files), ("total_mb", F.col("total_mb"), max_total_mb), ("oversized", F.col("oversized_files"), 0))])).alias("x")).select("x.*")
    warn = (F.col("check_name") == "oversized") & (F.col("actual") > 0)
    severity = F.when(warn, "warning").when(F.col("check_name") == "oversized", "ok").when(F.col("actual") > F.col("limit_value"), "error").when(F.col("actual") > warn_share * F.col("limit_value"), "warning").otherwise("ok")
    return rows.withColumn("severity", severity)


def require_limits(checks: DataFrame) -> None:
    """Raise if a limit is broken."""
    bad = checks.where("severity = 'error'").collect()
    if bad:
        raise ValueError("; ".join(f"{r.check_name}: {r.actual:g} is over {r.limit_value:g}" for r in bad))
