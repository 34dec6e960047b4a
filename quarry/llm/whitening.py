"""Embedding whitening by bit-sliced scatter.

Entries are fixed-point numbers x = floor(64 * c) + 1000000. The fit list is each distinct vector once. A task takes
it in blocks: each dimension is shifted by its least entry of the block and laid out as bit planes, one bit a row,
packed into 64-bit words. The number of rows in which two planes both have a bit is the popcount of their AND; weighted
by the planes' powers of two and summed it is the exact cross product of two dimensions. Blocks, tasks and Spark's sums
are whole numbers throughout (cross products leave a task as two limbs, whose decimals can't overflow). The driver gets
one number for each pair of dimensions, centres it as an integer (n * sum of products - product of sums), and only then
divides and calls ``eigh``.

Rows whose vector is null, empty or has a null or non-finite entry are dropped. Vectors of different sizes are an error.
Entries beyond 2**62 / 64 count as that. Components are numbered by falling eigenvalue; those without variance (at most
``TINY`` of the largest) are left out, so one distinct vector, or none, gives an empty result. The sign of a component
makes its largest entry positive. Repeated rows enter the fit once and are whitened each, alike to the last bit; null and
repeated ids are kept; extra columns are ignored. A deviation that a long can't hold is null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
BLOCK_ROWS = 1 << 15
LIMB = 60
TINY = 1e-13
_LONG = 1 << 63


def fixed_point(vector: Column) -> Column:
    """The vector's whole numbers, or null if the row is to be dropped."""
    bound = float(1 << 62)
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    number = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-bound)), F.lit(bound))).cast("long") + SHIFT
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, number))


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """(rows, dimensions) of a column of arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dim = dim or (len(column[0]) if len(column) else 1)
    if len(flat) != len(column) * dim or not np.all(np.diff(column.offsets.to_numpy()) == dim):
        raise ValueError("vectors differ in size")
    return flat.reshape(len(column), dim)


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of unsigned (rows, dimensions): 64-bit words (planes, words), and each plane's dimension and bit. Empty planes are left out."""
    padded = np.zeros((-(-len(shifted) // 64) * 64, shifted.shape[1]), np.uint64)
    padded[: len(shifted)] = shifted
    words, dims, bits = [], [], []
    for bit in range(int(shifted.max()).bit_length() if shifted.size else 0):
        plane = np.packbits((padded >> np.uint64(bit) & np.uint64(1)).astype(bool), axis=0).T
        some = np.flatnonzero(plane.any(1))
        words.append(np.ascontiguousarray(plane[some]).view(np.uint64))
        dims.append(some)
        bits.append(np.full(len(some), bit))
    if not words:
        return np.zeros((0, len(padded) // 64), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(dims), np.concatenate(bits)


def block_scatter(x: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, upper cross products) of a block of whole numbers, exact."""
    n, dim = x.shape
    least = x.min(0)
    shifted = x.astype(np.uint64) - least.astype(np.uint64)  # modulo 2**64: right for any two longs
    words, dims, bits = bit_planes(shifted)
    weights = [1 << int(b) for b in bits]
    totals, products = [0] * dim, [[0] * dim for _ in range(dim)]
    narrow = 2 * (int(bits.max()) if len(bits) else 0) + n.bit_length() + dim.bit_length() < 63
    powers = np.left_shift(np.int64(1), bits) if narrow else None
    for p in range(len(words)):
        both = np.bitwise_count(words[p:] & words[p]).sum(1, dtype=np.int64)
        a = int(dims[p])
        totals[a] += weights[p] * int(both[0])
        if narrow:  # sums by dimension fit a long
            sums = np.zeros(dim, np.int64)
            np.add.at(sums, dims[p:], both * powers[p:])
            sums[a] += int((both[1:] * powers[p + 1 :])[dims[p + 1 :] == a].sum())  # a pair of planes of one dimension counts in both orders
            terms = [(int(d), int(sums[d])) for d in np.flatnonzero(sums)]
        else:
            terms = [(int(d), int(c) * w * (2 if d == a and q else 1)) for q, (d, c, w) in enumerate(zip(dims[p:], both, weights[p:])) if c]
        for d, value in terms:
            products[min(a, d)][max(a, d)] += weights[p] * value
    m = [int(v) for v in least]
    sums = [t + n * v for t, v in zip(totals, m)]
    for a in range(dim):
        for b in range(a, dim):
            products[a][b] += m[a] * totals[b] + m[b] * totals[a] + n * m[a] * m[b]
    return n, sums, products


def scatter(fit_list: DataFrame, vector_col: str = "x") -> tuple[int, list[int], list[list[int]]]:
    """(n, S, cross products) of all rows: partial sums by task, added by Spark. One row for each pair of dimensions reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = defaultdict(int)
        held: list[np.ndarray] = []

        def add() -> None:
            x = np.concatenate(held)
            held.clear()
            n, sums, products = block_scatter(x - SHIFT)
            total[-1, -1] += n
            for a, s in enumerate(sums):
                total[a, -1] += s
                for b in range(a, len(sums)):
                    total[a, b] += products[a][b]

        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                held.append(_matrix(b.column(0).slice(lo, BLOCK_ROWS)))
                if len({x.shape[1] for x in held}) > 1:
                    raise ValueError("vectors differ in size")
                if sum(map(len, held)) >= BLOCK_ROWS:
                    add()
        if held:
            add()
        keys, limbs = list(total), [divmod(v, 1 << LIMB) for v in total.values()]
        numbers = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(h) for h, _ in limbs], numbers), pa.array([Decimal(low) for _, low in limbs], numbers)], names=["a", "b", "high", "low"])

    parts = fit_list.select(vector_col).mapInArrow(run, "a int, b int, high decimal(38,0), low decimal(38,0)")
    found = {(r.a, r.b): (int(r.high) << LIMB) + int(r.low) for r in parts.groupBy("a", "b").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    dim = 1 + max((a for a, _ in found), default=-1)
    if any((a, b) not in found for a in range(dim) for b in range(a, dim)):
        raise ValueError("vectors differ in size")
    return found.get((-1, -1), 0), [found[a, -1] for a in range(dim)], [[found[min(a, b), max(a, b)] for b in range(dim)] for a in range(dim)]


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors of the fit list with sums S = n * ``quotient`` + ``rest`` (of x); eigenvectors by column."""

    n: int
    quotient: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); summed in the order of the dimensions, so that equal rows get equal numbers."""
        centred = (x - self.quotient).astype(np.float64) - self.rest / self.n
        out = np.zeros((len(x), len(self.values)))
        for j in range(x.shape[1]):
            out += centred[:, j, None] * self.vectors[j]
        return out / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 over the dimensions, exact: n^2 * sum d^2 - 2 n * sum d r + sum r^2 with d = x - quotient."""
        d, n, dim = x - self.quotient, self.n, x.shape[1]
        far, rest = max(int(d.max()), -int(d.min()), 1) if d.size else 1, [int(r) for r in self.rest]
        if far * max(far, *rest, 1) * dim >= _LONG:
            squares = [sum(int(v) ** 2 for v in row) for row in d]
            mixed = [sum(int(v) * r for v, r in zip(row, rest)) for row in d]
        else:
            squares, mixed = (d * d).sum(1).tolist(), (d * self.rest).sum(1).tolist()
        constant = sum(r * r for r in rest)
        exact = (n * n * a - 2 * n * b + constant for a, b in zip(squares, mixed))
        return [v if v < _LONG else None for v in exact]


def fit(n: int, sums: list[int], products: list[list[int]], most: int = 16) -> Whitening:
    """Components of the covariance, from exact sums of x - SHIFT."""
    dim = len(sums)
    centred = [[n * products[a][b] - sums[a] * sums[b] for b in range(dim)] for a in range(dim)]
    cov = np.array([[c / (n * n) for c in row] for row in centred]) if n else np.zeros((0, 0))
    trace = sum(centred[a][a] for a in range(dim)) / (n * n) if n else 0.0
    values, vectors = np.linalg.eigh(cov) if dim else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(TINY * values.max(initial=0), 0)] if trace > 0 else order[:0]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0) if len(order) else vectors
    whole, rest = zip(*(divmod(s, n) for s in sums)) if dim else ((), ())
    return Whitening(n, np.array(whole, np.int64) + SHIFT, np.array(rest, np.int64), values[order], vectors, trace)


def identity_error(fit_list: DataFrame, model: Whitening, vector_col: str = "x") -> float:
    """Largest entry, in absolute value, of the whitened fit list's covariance minus the identity: measured over all of it."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                w = model.whitened(_matrix(b.column(0).slice(lo, BLOCK_ROWS), len(model.quotient)))
                products += w.T @ w
                sums += w.sum(0)
        both = np.column_stack([products, sums])
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(both.ravel())], names=["i", "j", "v"])

    total = np.zeros((k, k + 1))
    for i, j, v in fit_list.select(vector_col).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        total[i, j] = v
    mean = total[:, k] / model.n
    return float(np.abs(total[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component up to ``most``."""
    rows = df.select(F.col(id_col).alias("vec_id"), fixed_point(F.col(vector_col)).alias("x")).where(F.col("x").isNotNull())
    fit_list = stored(rows.select("x").distinct())
    model = fit(*scatter(fit_list), most)
    error = identity_error(fit_list, model) if len(model.values) else 0.0
    explained = model.values / model.trace if len(model.values) else model.values
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows if k else 0, BLOCK_ROWS // 4):
                part = b.slice(lo, BLOCK_ROWS // 4)
                x = _matrix(part.column(1), len(model.quotient))
                own = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [part.column(0).take(own), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(own), model.n)), pa.array(model.deviation(x), pa.int64()).take(own)]
                columns += [pa.array(v) for v in (model.whitened(x).ravel(), np.tile(explained, len(x)), np.full(len(own), error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {df.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
