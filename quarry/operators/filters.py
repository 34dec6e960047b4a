"""Path and content filters over files (path, parts, suffix, size, text or content).

Patterns are tens of driver-side rules; each filter is one expression over the path, without a join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.languages import BINARY_SUFFIXES, EXCLUDED_NAMES
from quarry.functions.patterns import glob_regex, ignore_rule

PROBE = 1024


def default_excludes(df: DataFrame, names: Iterable[str] = EXCLUDED_NAMES) -> DataFrame:
    """Drop files one of whose path parts equals one of ``names``."""
    return df.where(~F.coalesce(F.arrays_overlap("parts", F.array(*map(F.lit, names))), F.lit(False)))


def _prefixes() -> Column:
    """Each ancestor folder of a path and the path itself."""
    return F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(F.array_join(F.slice("parts", 1, i), "/").alias("p"), (i < F.size("parts")).alias("folder")))


def ignore_rules(df: DataFrame, lines: Iterable[str]) -> DataFrame:
    """Drop files that an ignore file's lines exclude. The last rule that matches a path wins; a file below
    an excluded folder can't come back."""
    rules = [r for r in map(ignore_rule, lines) if r]
    if not rules:
        return df

    def excluded(x: Column) -> Column:
        out = F.lit(False)
        for r in rules:
            hit = x["p"].rlike(r.regex) & (x["folder"] if r.dir_only else F.lit(True))
            out = F.when(hit, F.lit(not r.negate)).otherwise(out)
        return out

    return df.where(~F.coalesce(F.exists(_prefixes(), excluded), F.lit(False)))


def exclude_globs(df: DataFrame, globs: Iterable[str]) -> DataFrame:
    """Drop files that a glob matches, themselves or by a folder above them."""
    pattern = "|".join(map(glob_regex, globs))
    return df.where(~F.coalesce(F.exists(_prefixes(), lambda x: x["p"].rlike(pattern)), F.lit(False))) if pattern else df


def include_globs(df: DataFrame, globs: Iterable[str]) -> DataFrame:
    """Keep files that a glob matches; no globs keep all."""
    pattern = "|".join(map(glob_regex, globs))
    return df.where(F.col("path").rlike(pattern)) if pattern else df


def binary_suffixes(df: DataFrame, suffixes: Iterable[str] = BINARY_SUFFIXES) -> DataFrame:
    return df.where(~F.coalesce(F.col("suffix").isin(*suffixes), F.lit(False)))


def nul_probe(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Drop binary files: a NUL among the first 1,024 bytes, or content that couldn't be read."""
    head = F.substring(F.col(content_col).cast("binary"), 1, PROBE)
    return df.where(F.col(content_col).isNotNull() & ~F.hex(head).rlike("^(?:..)*?00"))


def drop_oversized(df: DataFrame, max_bytes: int) -> DataFrame:
    """Drop files of more than ``max_bytes``; a file of unknown size stays."""
    return df.where(F.coalesce(F.col("size") <= max_bytes, F.lit(True)))
