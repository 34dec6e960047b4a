"""Document fingerprints: improbable-feature digests.

Every window of WINDOW bytes has an entropy; how rare its entropy is in the whole corpus ranks it. A window that is
rarer than its REACH neighbours on either side (of equals the leftmost is) is a feature; neighbourhoods end with the
text, so that texts of any size have features of one kind, about one in ten bytes. Windows of hardly any entropy are
runs of a few bytes and never features; a text without a feature, or shorter than a window, is one feature as a whole.
Features enter Bloom filters of FILTER_BITS bits, a new one after FILTER_FEATURES features; the chain of filters is the
fingerprint. Two chains are alike by the mean, over the filters of the shorter one, of the best overlap of bits beyond
what chance gives, normalised to 0..1.

Null text counts as empty; an empty text has an empty fingerprint, like (1) only to another empty one. Equal texts have
equal fingerprints, repeated rows too; extra columns are ignored; an empty table gives an empty result. The next
document is by descending id; of equal ids the first by text comes first, and rows without an id come last, by text.
Ids are whole numbers. Long texts are digested BLOCK bytes at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import hash_spans, partitions, text_slices

WINDOW, REACH = 8, 7  # a window's neighbours: nearer than its width, so that none is beyond the end of its text
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
LEVELS = 1001
COMPARED = 256
WEAK = 100  # windows of lower entropy (of 1000) are runs of few bytes, and never features
BLOCK = 1 << 20
_UNIT = 1 << 20

_f = np.array([0, *(c * np.log2(c) for c in range(1, WINDOW + 1))])
_STEP = np.append(0, np.diff(np.round(_f * _UNIT).astype(np.int64)))
_FULL = int(np.round(_f * _UNIT)[WINDOW])


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """Entropy of each window of a buffer, 0 to 1000. Sums are of integers, so a window's level depends on
    its bytes alone."""
    n = len(buf) - WINDOW + 1
    parts = [_block_levels(buf[lo : lo + BLOCK + WINDOW - 1]) for lo in range(0, n, BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int16)


def _block_levels(buf: np.ndarray) -> np.ndarray:
    n = len(buf) - WINDOW + 1
    ahead, behind = np.ones(len(buf), np.uint8), np.ones(len(buf), np.uint8)
    for d in range(1, WINDOW):
        same = (buf[:-d] == buf[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    sums = np.empty(n, np.int64)
    sums[0] = _STEP[behind[:WINDOW]].sum()
    np.cumsum(_STEP[behind[WINDOW:]] - _STEP[ahead[: n - 1]], out=sums[1:])
    sums[1:] += sums[0]
    return ((_FULL - sums) * 1000 // _FULL).astype(np.int16)


def _windows(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` starts have ``width`` bytes left in their text."""
    ok = np.ones(max(n, 0), bool)
    ends = offsets[1:]
    late = np.maximum(offsets[:-1], ends - width + 1)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.minimum(late, n), 1)
    np.add.at(change, np.minimum(ends, n), -1)
    ok &= np.cumsum(change[:n]) == 0
    return ok


def entropy_histogram(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Windows of each entropy level over all texts of the corpus; LEVELS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            for _, _, buf, offsets in text_slices(b.column(0)):
                levels = entropy_levels(buf)
                total += np.bincount(levels[_windows(offsets, WINDOW, len(levels))], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS), pa.int32()), pa.array(total)], names=["level", "n"])

    out = np.zeros(LEVELS, np.int64)
    for level, n in df.select(text_col).mapInArrow(run, "level int, n bigint").groupBy("level").agg(F.sum("n")).collect():
        out[level] = n
    return out


def rarity_ranks(histogram: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first; of equals the lower entropy. Weak levels have rank LEVELS."""
    ranks = np.empty(LEVELS, np.int16)
    ranks[np.argsort(histogram, kind="stable")] = np.arange(LEVELS)
    ranks[:WEAK] = LEVELS
    return ranks


def rare_features(buf: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of a slice of texts, in order, and how many each text has."""
    sizes = np.diff(offsets)
    rank = ranks[entropy_levels(buf)]
    n = len(rank)
    rank[~_windows(offsets, WINDOW, n)] = LEVELS
    around = np.full(n + 2 * REACH, LEVELS, np.int16)
    around[REACH : REACH + n] = rank
    least = around  # of the windows from each place on
    for step in _doublings(REACH):
        least = np.minimum(least[:-step], least[step:])
    before, after = least[:n], least[REACH + 1 : REACH + 1 + n]
    chosen = np.flatnonzero((rank < before) & (rank <= after) & (rank < LEVELS))
    owners = np.searchsorted(offsets, chosen, "right") - 1
    counts = np.bincount(owners, minlength=len(sizes))
    lost = np.flatnonzero((counts == 0) & (sizes > 0))
    starts, ends, owners = np.concatenate([chosen, offsets[:-1][lost]]), np.concatenate([chosen + WINDOW, offsets[1:][lost]]), np.concatenate([owners, lost])
    order = np.argsort(owners, kind="stable")
    counts[lost] = 1
    return hash_spans(buf, starts[order], ends[order]), counts


def _doublings(width: int) -> list[int]:
    """Steps after which a running minimum covers ``width`` places."""
    out, covered = [], 1
    while covered < width:
        out.append(min(covered, width - covered))
        covered += out[-1]
    return out


def _filters(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    filters = -(-counts // FILTER_FEATURES)
    first = np.cumsum(filters) - filters
    nth = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(first, counts) + nth // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for i in range(HASHES):
        bits[at, ((h >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + k] for a, k in zip(first.tolist(), filters.tolist())]


def chains(texts: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    """The Bloom filters of each text, packed: arrays (filters, FILTER_BITS / 8)."""
    return [chain for _, _, buf, offsets in text_slices(texts) for chain in _filters(*rare_features(buf, offsets, ranks))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; see the module."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    score, weight = np.zeros(len(a)), np.bitwise_count(a).sum(1, dtype=np.float64)
    n_b = np.bitwise_count(b).sum(1, dtype=np.float64)
    for i in range(0, len(a), COMPARED):  # of long texts so many filters at once
        x, nx = np.unpackbits(a[i : i + COMPARED], axis=1).astype(np.float32), weight[i : i + COMPARED, None]
        for j in range(0, len(b), COMPARED):
            ny = n_b[None, j : j + COMPARED]
            both, chance = x @ np.unpackbits(b[j : j + COMPARED], axis=1).astype(np.float32).T, nx * ny / FILTER_BITS
            best = np.clip((both - chance) / np.maximum(np.minimum(nx, ny) - chance, 1e-6), 0, 1).max(1)
            score[i : i + COMPARED] = np.maximum(score[i : i + COMPARED], best)
    return float((score * weight).sum() / weight.sum())


def encoded(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def fingerprint(df: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(encoded, chains(b.column(1), ranks)), pa.string())], names=[id_col, "fingerprint"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, guest, doc_id, text) such that, bucket by bucket in descending id, each row's next
    document is the next row. A bucket's last next is the first row of the following bucket, sent as a
    guest; after the very last comes the first. Only ids of buckets' first rows reach the driver; a task finds a row's
    bucket among their borders by bisection."""
    spark = df.sparkSession
    n = 3 * partitions(spark)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    cuts = np.array(sorted({int(c) for c in rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}), np.int64)

    def buckets(ids: pa.Array) -> np.ndarray:
        own = len(cuts) - np.searchsorted(cuts, pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), "right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, own)

    @F.arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        return pa.array(buckets(ids).astype(np.int32))

    firsts = sorted(rows.select("doc_id").groupBy(bucket_of("doc_id").alias("bucket")).agg(F.max("doc_id").alias("first")).collect())
    number, first = np.array([r.bucket for r in firsts], np.int64), [r.first for r in firsts]
    heads = np.array([-1 if x is None else x for x in first], np.int64)
    no_id = np.array([x is None for x in first], bool)
    before = np.roll(number, 1)

    @F.arrow_udf("array<struct<bucket: int, guest: boolean>>")
    def places(ids: pa.Array) -> pa.Array:
        own = buckets(ids)
        at = np.minimum(np.searchsorted(number, own), max(len(number) - 1, 0))
        value, null = pc.fill_null(ids.cast(pa.int64()), -1).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        goes = (null == no_id[at]) & (value == heads[at]) if len(number) else np.zeros(len(own), bool)
        size = 1 + goes
        start = np.cumsum(size) - size
        to, guest = np.zeros(int(size.sum()), np.int32), np.zeros(int(size.sum()), bool)
        to[start] = own
        to[start[goes] + 1], guest[start[goes] + 1] = before[at[goes]], True
        rows = pa.StructArray.from_arrays([pa.array(to), pa.array(guest)], names=["bucket", "guest"])
        return pa.ListArray.from_arrays(pa.array(np.append(start, len(to)).astype(np.int32)), rows)

    dealt = rows.select(F.explode(places("doc_id")).alias("to"), "doc_id", "text").select("to.bucket", "to.guest", "doc_id", "text")
    return dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")


def edited_text(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def compare_with_edited(df: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they and the next one are."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = held + list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()))
                held = rows[-1:]
                # a pair is (own row, following row of its bucket); the following may be the guest
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
                if not pairs:
                    continue
                used = [x for x, _ in pairs]
                edited = [edited_text(x[3], y[3]) for x, y in pairs]
                own = chains(pa.array([x[3] for x in used] + [y[3] for _, y in pairs[-1:]], pa.large_string()), ranks)
                chain = {id(x): c for x, c in zip(used, own)}
                chain[id(pairs[-1][1])] = own[-1]
                missing = [y for _, y in pairs if id(y) not in chain]
                chain |= {id(y): c for y, c in zip(missing, chains(pa.array([y[3] for y in missing], pa.large_string()), ranks))}
                of_edited = chains(pa.array(edited, pa.large_string()), ranks)
                out = [(x[2], len(x[3]), hashlib.sha256(e.encode()).hexdigest(), encoded(chain[id(x)]), encoded(c), likeness(chain[id(x)], c), likeness(chain[id(x)], chain[id(y)])) for (x, y), e, c in zip(pairs, edited, of_edited)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return with_next(df).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compare_with_edited(docs, rarity_ranks(entropy_histogram(docs)))
