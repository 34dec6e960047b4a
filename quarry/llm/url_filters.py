"""URL filters [native]: a Bloom filter cascade for exact membership, and longest-rule verdicts.

The cascade knows the corpus's complete key universe. Level 1 encodes the listed keys; level 2 the
unlisted keys that level 1 wrongly contains; level 3 the listed keys that level 2 wrongly contains; and so
on until a level has no false positive. A key of the universe is listed exactly when the first level that
lacks it is an even one. Each level is an array of 64-bit words that a scalar subquery hands to the scan:
no join touches the urls, and all of it is built-in functions.

Keys are dealt to parts by hash, a cascade each, so that no level has more than ``part_mb``. The urls are judged part by
part, each in a pass that holds the levels of one part and marks the keys of that part; a list of any length takes the
same way, with as many passes as it has parts.

Null url, no ``://``: host and path are empty, no rule fits, the verdict is allow. Repeated rows are judged
each on their own; extra columns are ignored; an empty table gives an empty result. Listed hosts may be null, repeated,
or not occur in the urls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): the rules of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The query's block list is the table of the hosts that have one of these labels.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and path up to ``?`` or ``#``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


class Cascade:
    """Levels of Bloom filters over ``universe`` (key, listed), built by grouping on words of bits; a cascade for each part of the keys."""

    def __init__(self, universe: DataFrame, bits_per_key: int = 10, hashes: int = 4, part_mb: float = 16):
        self.spark, self.hashes = universe.sparkSession, hashes
        keys = stored(universe.groupBy("key").agg(F.max("listed").alias("listed")))
        self.parts = max(1, -(-keys.where("listed").count() * bits_per_key // int(part_mb * (1 << 23))))
        self.cascades: list[list[tuple[int, DataFrame]]] = []  # of each part the levels: bits and words
        for part in range(self.parts):
            levels: list[tuple[int, DataFrame]] = []
            own = keys.where(self.part_of(F.col("key")) == part)
            inside, outside = own.where("listed").select("key"), own.where("NOT listed").select("key")
            while n := inside.count():
                bits = -(-n * bits_per_key // 64) * 64
                levels.append((bits, self._encode(inside, len(levels), bits)))
                seen = outside.withColumn("_level", levels[-1][1].scalar())
                wrong = stored(seen.where(self._in_level(F.col("key"), F.col("_level"), len(levels) - 1, bits)).select("key"))
                inside, outside = wrong, inside
            self.cascades.append(levels)

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(self.parts))

    def _positions(self, key: Column, level: int, bits: int) -> list[Column]:
        first, step = (F.pmod(h, F.lit(bits)) for h in (F.xxhash64(key, F.lit(level)), F.xxhash64(F.lit(level), key)))
        return [F.pmod(first + step * i, F.lit(bits)) for i in range(self.hashes)]

    def _encode(self, keys: DataFrame, level: int, bits: int) -> DataFrame:
        """One row: the level's words, in order."""
        set_bits = keys.select(F.explode(F.array(*self._positions(F.col("key"), level, bits))).alias("p"))
        words = set_bits.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits"))
        zeros = self.spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        full = words.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = full.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("a"))
        return stored(row.select(F.col("a.bits").alias("words")), f"{shared_dir(self.spark)}-level{level}")

    def _in_level(self, key: Column, words: Column, level: int, bits: int) -> Column:
        out = F.lit(True)
        for p in self._positions(key, level, bits):
            out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out

    def _contains(self, part: int, levels: list[tuple[int, DataFrame]], names: list[str]) -> Callable[[Column], Column]:
        def contains(key: Column) -> Column:
            out = F.lit(len(levels) % 2 == 1)
            for i in reversed(range(len(levels))):
                out = F.when(~self._in_level(key, F.col(names[i]), i, levels[i][0]), F.lit(i % 2 == 1)).otherwise(out)
            return out if self.parts == 1 else (self.part_of(key) == part) & out

        return contains

    def mark(self, df: DataFrame, marks: Callable[[Callable[[Column], Column]], dict[str, Column]]) -> DataFrame:
        """``df`` with the columns that ``marks(contains)`` gives, once for each part: ``contains(key)`` tells whether a key
        of the universe is listed, for keys of the part at hand, and is false for others. Columns marked before can be used."""
        for part, levels in enumerate(self.cascades):
            names = [f"_level{i}" for i in range(len(levels))]
            held = df.withColumns({n: words.scalar() for n, (_, words) in zip(names, levels)})
            df = held.withColumns(marks(self._contains(part, levels, names))).drop(*names)
            if part + 1 < self.parts:  # a pass each, so that a task holds one part's levels
                df = stored(df)
        return df


def judge(df: DataFrame, rules=RULES, listed_hosts: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", part_mb: float = 16) -> DataFrame:
    """Verdict on every url: that of the longest fitting rule, else block for one of ``listed_hosts`` (key), else allow.

    A url's candidate keys are each suffix of its host with each prefix of its path of a length that some
    rule has; the rules and the listed hosts are the cascade's listed keys. Of fitting rules of one length
    a block wins. Rules are tens; hosts may be of any number.
    """
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keyed = pages.withColumn("keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))))
    rule_keys = [h + p for _, h, p in rules]
    universe = keyed.select(F.explode("keys").alias("key")).distinct().select("key", F.col("key").isin(*rule_keys).alias("listed"))
    universe = universe.unionByName(pages.where("host <> ''").select(F.col("host").alias("key")).distinct().select("key", F.lit(False).alias("listed")))
    if listed_hosts is not None:
        universe = universe.unionByName(listed_hosts.where("key <> ''").select("key", F.lit(True).alias("listed")))
    none = {"fit": F.array().cast("array<string>"), "bad_host": F.lit(False)}
    judged = Cascade(universe, part_mb=part_mb).mark(keyed.withColumns(none), lambda contains: {"fit": F.concat("fit", F.filter("keys", contains)), "bad_host": F.col("bad_host") | (contains(F.col("host")) & (F.col("host") != ""))})
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] == "allow", r[1]))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("bad_host"), "block").otherwise("allow")
    for what, h, p in reversed(order):
        is_it = F.array_contains("fit", h + p)
        rule, verdict = F.when(is_it, h + p).otherwise(rule), F.when(is_it, what).otherwise(verdict)
    return judged.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def hosts_with(df: DataFrame, listed_labels=LISTED_LABELS, url_col: str = "url") -> DataFrame:
    """(key): the hosts of ``df`` that have one of the labels."""
    hosts = df.select(host_and_path(F.col(url_col))[0].alias("key")).distinct()
    return hosts.where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, listed_labels))))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed_hosts=hosts_with(pages))


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
