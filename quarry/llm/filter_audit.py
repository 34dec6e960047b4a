"""Filter interaction audit: what each filter of a chain removes, in every order, and its Shapley value.

Each document fails some of the filters; documents of one part (a source) that fail the same ones are one cell.
A coalition of filters removes the documents of all cells that fail at least one of its members, so a part is
described by what its 32 coalitions remove (of all, of good and of toxic documents). What a step of an order removes is
the difference of two coalitions. The Shapley values are the solution of a constrained least-squares problem: the additive
game nearest to the coalition table under the Shapley kernel whose values sum to what all filters together remove. Its
normal equations are the same for every part but for their right side, so they are solved once in rationals, for each
unit table; a part's values are that solution applied to its table, in whole numbers.

A row is a document. Copies (filter E) are told by SHA-256 of the text: a document fails if a smaller id has its text.
Only ids, digests and cells are shuffled, counted before that; a digest's rows are no more than its parts and labels
have combinations, however many copies it has.

Null text counts as empty. A row without an id has no label, is no copy and makes none. Rows with equal id and text are
documents of their own, and the least id's rows are all no copies. Of repeated labels of an id, any that says so makes
the document good or toxic. A null part is the empty string. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPREAD = 1024  # rows without an id are dealt over so many keys


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at the text alone."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ", -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def shapley_solution(n: int) -> list[list[int]]:
    """For each of ``n`` players the whole numbers that, times the values of the coalitions (by mask), sum to n! times its Shapley value.

    Minimised is the sum over coalitions S other than none and all of w(S) * (v(S) - sum of x over S) ** 2, with
    w(S) = (n - 1) / (C(n, |S|) * |S| * (n - |S|)), under sum of x = v(all); v(none) is 0."""
    everyone = (1 << n) - 1
    inside = lambda s, i: s >> i & 1
    weight = {s: Fraction(n - 1, math.comb(n, k) * k * (n - k)) for s in range(1, everyone) if (k := s.bit_count())}
    rows = []
    for i in range(n):
        left = [sum((w for s, w in weight.items() if inside(s, i) and inside(s, j)), Fraction(0)) for j in range(n)]
        rows.append([*left, Fraction(1), *[weight.get(s, Fraction(0)) * inside(s, i) for s in range(everyone + 1)]])
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(int(s == everyone)) for s in range(everyone + 1)])
    for c in range(n + 1):  # Gauss and Jordan over all right sides at once
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and (f := rows[r][c]):
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[c])]
    scaled = [[x * math.factorial(n) for x in row[n + 1 :]] for row in rows[:n]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the solution isn't one of whole numbers")
    return [[int(x) for x in row] for row in scaled]


def _mask(failures: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, fails in failures.items():
        out = out.bitwiseOR(F.when(fails, 1 << FILTERS.index(name)).otherwise(0))
    return out


def failure_cells(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail (bits in FILTERS' order)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), _mask(text_failures(text)).alias("mask"))
    counted = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("copies"))
    is_set = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_set("quality").alias("good"), is_set("toxic").alias("toxic"))
    # a null id meets no label; its rows are spread by digest
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(0).cast("int")
    labelled = counted.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0)).hint("merge"), ["id", "spread"], "left")
    labelled = labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "copies"))).alias("least")
    no_id = F.sum(F.when(F.col("id").isNull(), F.col("copies")).otherwise(0)).alias("no_id")
    of_text = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("copies").alias("n"), least, no_id)
    first = F.min("least.id").over(Window.partitionBy("digest"))
    kept = F.col("no_id") + F.when(F.col("least.id") == first, F.col("least.copies")).otherwise(0)
    told = of_text.select("part", "mask", "good", "toxic", "n", kept.alias("kept"))
    copy_bit = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("mask"), F.col("kept").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    cells = told.select("part", "good", "toxic", F.explode(split).alias("cell")).select("part", "good", "toxic", "cell.*").where("n > 0")
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), when("good"), when("toxic"))


def coalition_table(cells: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, total, n, good, toxic) with arrays of what each coalition of filters (by its mask) removes of a part."""
    each = cells.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    removed = [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    rows = each.groupBy("part", "coalition").agg(F.sum("n").alias("total"), *removed)
    table = rows.groupBy("part").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic"))).alias("t"))
    return table.select("part", "total", *[F.col("t")[c].alias(c) for c in ("n", "good", "toxic")])


def audit(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step: see the columns of ``op11_filter_interactions``."""
    n = len(names)
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(names)])
    rows = coalition_table(cells, n).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    own = F.expr(f"shiftleft(1, locate(substr(filter_order, step, 1), '{names}') - 1)")
    upto = lambda k: F.expr(f"aggregate(sequence(0, {k}), 0, (m, i) -> m | if(i = 0, 0, shiftleft(1, locate(substr(filter_order, i, 1), '{names}') - 1)))")
    rows = rows.withColumns({"own": own, "before": upto("step - 1"), "after": upto("step")})
    of = lambda table, mask: F.get(F.col(table), mask if isinstance(mask, Column) else F.col(mask))
    gone = of("n", "after") - of("n", "before")
    everyone = F.lit((1 << n) - 1)
    values = F.array(*[F.aggregate(F.zip_with("n", F.array(*[F.lit(x).cast("long") for x in row]), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b) for row in shapley_solution(n)])
    rows = rows.withColumn("values", values)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - of("n", "after")).alias("kept"),
        gone.alias("removed"),
        (of("n", "own") - gone).alias("redundant"),
        (of("n", everyone) - of("n", everyone.bitwiseXOR(F.col("own")))).alias("unique_fails"),
        (of("good", "after") - of("good", "before")).alias("good_lost"),
        (of("toxic", "after") - of("toxic", "before")).alias("toxic_lost"),
        F.element_at("values", F.expr(f"locate(substr(filter_order, step, 1), '{names}')")).alias("shapley"),
    )


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(failure_cells(docs, labels))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 200)::INTEGER + 2 * (100 * list_unique(words) < 50 * len(words))::INTEGER
         + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INTEGER
         + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INTEGER AS mask
  FROM t LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
  WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step - 1]) AS before
  FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM orders)),
s AS (SELECT filter_order, step, own::INTEGER AS own, coalesce(before, 0)::INTEGER AS before FROM steps),
r AS (
  SELECT part, filter_order, step, own, sum(n) FILTER ((mask & (before | own)) = 0) AS kept, sum(n) FILTER ((mask & before) = 0 AND (mask & own) <> 0) AS removed,
         sum(n) FILTER ((mask & before) <> 0 AND (mask & own) <> 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
         sum(good) FILTER ((mask & before) = 0 AND (mask & own) <> 0) AS good_lost, sum(toxic) FILTER ((mask & before) = 0 AND (mask & own) <> 0) AS toxic_lost
  FROM cells, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
