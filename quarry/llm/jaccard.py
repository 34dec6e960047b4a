"""N-gram Jaccard join: exact links between texts whose sets of word shingles are alike.

1. Equal texts are one node, with a number of its own; rows and their ids only rejoin at the end.
2. Shingles that many texts share are found by counts in every batch, added up over the corpus. They sort
   last in the one order that all sets use, so that prefixes are made of rare shingles.
3. Sets with a Jaccard index of at least t share a shingle among the first |x| - ceil(t|x|) + 1 of each.
   Prefix entries (key, id, size) are dealt to tiles by key, packed a block per batch and tile. Those of hot
   keys also have their place in the set's order, which bounds the overlap of sets that first meet there, and
   which of the hot shingles just before the key the set has, so that a pair meets under few of its keys.
   In a tile only sets of one key whose sizes are within t of each other meet (size bands). The bits by which
   the hashed bitmaps of two candidates differ bound their overlap from above before any set is touched.
4. Candidates meet in three rounds. The first pairs each set with the smallest of its key and size band,
   which ties a family of near copies together without its pairs; the second with a centre by chance, where
   components differ; the last takes all remaining pairs of different components, whose entries carry folded
   bitmaps, so that sets that cannot link never become a pair. Candidates are checked by
   intersecting their sorted shingle arrays. So no link between components is missed, while links inside one
   need not be listed.

A shingle is 5 words in a row as a 64-bit hash; a text of fewer words is one shingle; a text without words, or
null, has the empty set and links with nothing. Words are runs of bytes other than white space (0x20, 0x09 to
0x0D) after A-Z are lower-cased. Hashes are mixed word by word (see common.hash_spans): two sets of n and m shingles
share one by mistake with odds of n * m / 2**64. Every row is returned. Rows that repeat an id are documents of
their own: their texts decide what they link with. A row without an id links as others do; a component all of
whose ids are null has a null component_id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, fresh, hash_spans, mix, partitions, spans, stored, text_slices, tidy, word_counts
from quarry.llm.components import connected

SHINGLE = 5
PERCENT = 75
LEAST_BITS = 256
ENTRY_BITS = 1024  # of the bitmaps that entries of the last round carry
HOT_SHARE = 0.0001  # of all texts: a shingle in more of them sorts last
MOST_HOT = 1_000_000  # of those, the commonest; any one order of all shingles gives the same links
TILE_ENTRIES = 250_000
COLD = -1  # place of entries of keys that aren't hot
BEFORE = 64  # hot shingles before a key that an entry tells of
PAIRS_PER_GROUP = 1500
BROADCAST_ROWS = 500_000

_WORD = np.ones(256, np.uint8)
_WORD[[32, 9, 10, 11, 12, 13]] = 0


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    c = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(width)], np.uint64)
    for _, _, buf, offsets in text_slices(texts):
        low = ascii_lower(buf)
        starts, ends = spans(_WORD[low], offsets)
        h = hash_spans(low, starts, ends)
        counts = word_counts(starts, offsets)
        n = len(h)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for i in range(width):
            rolled += h[i : i + len(rolled)] * c[i]
        rolled = mix(rolled + np.uint64(width))
        at = 0
        for k in counts.tolist():
            if k >= width:
                yield np.unique(rolled[at : at + k - width + 1])
            elif k:
                yield mix((h[at : at + k] * c[:k]).sum(keepdims=True) + np.uint64(k))
            else:
                yield np.zeros(0, np.uint64)
            at += k


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """An overlap that any link of a set of n shingles has at least."""
    return -(-percent * n // 100)


def size_band(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Sets of one band are all within the size ratio of each other."""
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes takes each value, as 64-bit words: a power of two of bits, at least two for
    a shingle, so the signature is as sharp for long texts. Shared shingles cancel out, so two bitmaps differ
    in no more bits than the sets in shingles. Half as many bits is one half XOR the other."""
    width = max(LEAST_BITS, 1 << (2 * max(len(s), 1) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(32)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded_bitmap(bits: np.ndarray) -> np.ndarray:
    """At most ENTRY_BITS bits of a bitmap, so that entries of the last round can carry them."""
    words = ENTRY_BITS // 64
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def digest_of(text_col: str) -> Column:
    return F.md5(F.col(text_col).cast("binary"))


def distinct_texts(df: DataFrame, text_col: str) -> DataFrame:
    """(rep, text, digest): each distinct text, which copies become before the shuffle, and its number."""
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), digest_of(text_col).alias("digest"))
    return stored(texts.groupBy("digest").agg(F.first("text").alias("text")).select(F.monotonically_increasing_id().alias("rep"), "text", "digest"))


def signatures(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(rep, digest, size, bits, low: folded bits) of each text's set, and (s, n): shingles that a batch has often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = list(shingle_sets(b.column(1), width))
            if not held:
                continue
            full = [bitmap(s) for s in held]
            bits = pa.array(full, pa.list_(pa.int64()))
            low = pa.array([folded_bitmap(x) for x in full], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in held], pa.int64())
            none = pa.nulls(len(held), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), sizes, bits, low, none, none], names=names)
            flat = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1]))
            n = np.diff(np.append(first, len(flat)))
            keep = n >= max(2, HOT_SHARE * len(held) / 2)
            k = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64())), pa.array(flat[first][keep].view(np.int64)), pa.array(n[keep])], names=names)
        tidy()

    names = ["rep", "digest", "size", "bits", "low", "s", "n"]
    table = stored(texts.select("rep", "text", "digest").mapInArrow(run, "rep bigint, digest string, size bigint, bits array<bigint>, low array<bigint>, s bigint, n bigint"))
    return table.where("rep IS NOT NULL").select("rep", "digest", "size", "bits", "low"), table.where("s IS NOT NULL").select("s", "n")


def hot_shingles(counts: DataFrame, n_texts: int) -> np.ndarray:
    """Shingles in more than HOT_SHARE of all texts, commonest last: MOST_HOT at most."""
    rows = counts.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > max(4, HOT_SHARE * n_texts)).orderBy(F.desc("n"), "s").limit(MOST_HOT).toPandas().sort_values(["n", "s"])
    return rows["s"].to_numpy(np.int64).view(np.uint64)


def hot_before(doc: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For entries of hot shingles, by document and rank: bit d is set if the document also has rank - 1 - d."""
    out = np.zeros(len(ranks), np.uint64)
    for d in range(1, min(BEFORE, len(ranks) - 1) + 1):  # a document's ranks ascend, so at most d places back
        gap = ranks[d:] - ranks[:-d]
        near = np.flatnonzero((doc[d:] == doc[:-d]) & (gap <= BEFORE))
        if not len(near):
            break
        out[near + d] |= np.uint64(1) << (gap[near] - 1).astype(np.uint64)
    return out


def prefix_blocks(texts: DataFrame, hot: np.ndarray, tiles: int, width: int, percent: int) -> DataFrame:
    """Prefix entries of the sets, packed in a row per batch and tile: keys, and for each the place of its
    set among ids and sizes; for hot keys also the key's place in the set's order and ``hot_before``. All
    entries of a hot key stay in a tile of their batch (tile >= ``tiles``); only the first of them goes on to
    the key's own tile, where it meets the firsts of other batches."""
    by_value = np.argsort(hot)
    shared = texts.sparkSession.sparkContext.broadcast((hot[by_value], by_value))  # MOST_HOT at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rank = shared.value
        salt = TaskContext.get().partitionId()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            keys, is_hot, sizes, own_ids, ranks = [], [], [], [], []
            for i, s in enumerate(shingle_sets(b.column(1), width)):
                if not len(s):
                    continue
                n = len(s) - least_overlap(len(s), percent) + 1
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    common = values[at] == s
                    first = s[~common][:n]
                    by_rank = np.argsort(rank[at[common]])
                    late = s[common][by_rank][: n - len(first)]
                    ranks.append(rank[at[common]][by_rank][: len(late)])
                else:
                    first, late = s[:n], s[:0]
                keys.append(np.concatenate([first, late]))
                is_hot.append(np.arange(n) >= len(first))
                own_ids.append(ids[i])
                sizes.append(len(s))
            if not keys:
                continue
            doc = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            flat, common = np.concatenate(keys), np.concatenate(is_hot)
            place = np.concatenate([np.arange(len(k)) for k in keys])
            before, again = np.zeros(len(flat), np.uint64), np.zeros(len(flat), bool)
            own_ids, sizes = np.array(own_ids, np.int64), np.array(sizes, np.int32)
            tile = ((flat >> np.uint64(32)) % np.uint64(tiles)).astype(np.int64)
            if common.any():
                before[common] = hot_before(doc[common], np.concatenate(ranks))
                at = np.flatnonzero(common)
                at = at[np.lexsort([own_ids[doc[at]], sizes[doc[at]], flat[at]])]
                firsts = at[np.append(True, flat[at][1:] != flat[at][:-1])]
                own_tile = tile[firsts]
                tile[common] = tiles + salt % tiles
                tile, again = np.append(tile, own_tile), np.append(again, np.ones(len(firsts), bool))
                flat, doc, place, before = (np.append(x, x[firsts]) for x in (flat, doc, place, before))
                salt += 1
            order = np.argsort(tile, kind="stable")
            flat, doc, tile, place, before, again = (x[order] for x in (flat, doc, tile, place, before, again))
            edges = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])).tolist()
            rows = []
            for a, z in zip(edges, [*edges[1:], len(flat)]):
                own, back = np.unique(doc[a:z], return_inverse=True)
                back = np.where(again[a:z], ~back, back)  # such an entry only forms pairs here
                told = (place[a:z].astype("<i4").tobytes(), before[a:z].astype("<u8").tobytes()) if tile[a] >= tiles else (None, None)
                rows.append((int(tile[a]), flat[a:z].astype("<u8").tobytes(), back.astype("<i4").tobytes(), own_ids[own].astype("<i8").tobytes(), sizes[own].astype("<i4").tobytes(), *told))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["tile", "keys", "owners", "ids", "sizes", "place", "before"])
        tidy()

    return texts.select("rep", "text").mapInArrow(run, "tile int, keys binary, owners binary, ids binary, sizes binary, place binary, before binary")


def tile_rows(blocks: DataFrame, tiles: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of the sets of a key. Of up to three sets all within the size ratio, of more those with
    the smallest of each size band. (key, id, n, place, before): entries of keys that have further pairs."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, ids, sizes, place, before, again = [], [], [], [], [], []
        for batch in table.to_batches():
            for k, o, i, n, p, h in zip(batch["keys"], batch["owners"], batch["ids"], batch["sizes"], batch["place"], batch["before"]):
                own = np.frombuffer(o.as_buffer(), "<i4")
                again.append(own < 0)
                own = np.where(own < 0, ~own, own)
                keys.append(np.frombuffer(k.as_buffer(), "<u8"))
                ids.append(np.frombuffer(i.as_buffer(), "<i8")[own])
                sizes.append(np.frombuffer(n.as_buffer(), "<i4")[own].astype(np.int64))
                place.append(np.frombuffer(p.as_buffer(), "<i4") if p.is_valid else np.full(len(own), COLD, "<i4"))
                before.append(np.frombuffer(h.as_buffer(), "<u8") if h.is_valid else np.zeros(len(own), "<u8"))
        keys, ids, sizes, place, before, again = (np.concatenate(x) for x in (keys, ids, sizes, place, before, again))
        many = len(keys) > 0
        order = np.argsort(keys, kind="stable")
        keys, ids, sizes, place, before, again = (x[order] for x in (keys, ids, sizes, place, before, again))
        same = np.append(keys[1:] == keys[:-1], False) if many else np.zeros(0, bool)
        salted = key[0].as_py() >= tiles
        shared = same | np.append(False, same[:-1]) if many and not salted else np.ones(len(keys), bool)
        order = np.flatnonzero(shared)
        order = order[np.lexsort([ids[order], sizes[order], keys[order]])]
        keys, ids, sizes, place, before, again = (x[order] for x in (keys, ids, sizes, place, before, again))
        starts = np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
        group = np.diff(np.append(starts, len(keys)))
        wide = np.repeat(group > 3, group)
        band = size_band(sizes, percent)
        opens = np.append(np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (band[1:] != band[:-1]))
        centre = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        pairs = [np.stack([ids[centre[wide]], ids[wide]])]
        for d in (1, 2):
            ok = ~wide[d:] & ~wide[:-d] & (keys[d:] == keys[:-d]) & (100 * sizes[:-d] >= percent * sizes[d:])
            pairs.append(np.stack([ids[:-d][ok], ids[d:][ok]]))
        pairs = np.concatenate(pairs, axis=1)
        pairs = np.unique(np.sort(pairs[:, pairs[0] != pairs[1]], axis=0), axis=1)
        wide = wide & ~again | salted
        tidy()
        n, m = pairs.shape[1], int(wide.sum())
        return pa.table(
            {
                "key": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(keys[wide].view(np.int64))]),
                "a": pa.array(np.concatenate([pairs[0], ids[wide]])),
                "b": pa.concat_arrays([pa.array(pairs[1]), pa.nulls(m, pa.int64())]),
                "n": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(sizes[wide])]),
                "place": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(place[wide], pa.int32())]),
                "before": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(before[wide].view(np.int64))]),
            }
        )

    dealt = blocks.repartition(tiles, "tile").groupBy("tile").applyInArrow(run, "key bigint, a bigint, b bigint, n bigint, place int, before bigint")
    table = stored(dealt)
    return table.where("b IS NOT NULL").select("a", "b").distinct(), table.where("key IS NOT NULL").select("key", F.col("a").alias("id"), "n", "place", "before").distinct()


def _bits_allow(percent: int) -> Column:
    """Whether bitmaps bits_a and bits_b allow a link of sets of n_a and n_b shingles."""

    def folded(x: str, y: str) -> Column:  # to the width of y: sizes within the band differ by one doubling at most
        n = F.size(y)
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    differ = F.aggregate(F.zip_with(folded("bits_a", "bits_b"), folded("bits_b", "bits_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    # with |A - B| + |B - A| = D, a link needs (n - D) / (n + D) >= t for n = |A| + |B|
    return differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)


def verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that link: first by the bound of their bitmaps, then by their sorted shingle arrays."""
    spark = pairs.sparkSession
    left = sigs.select(F.col("rep").alias("a"), F.col("size").alias("n_a"), F.col("bits").alias("bits_a"))
    right = sigs.select(F.col("rep").alias("b"), F.col("size").alias("n_b"), F.col("bits").alias("bits_b"))
    near = stored(pairs.join(left.hint("shuffle_hash"), "a").join(right.hint("shuffle_hash"), "b").where(_bits_allow(percent)).select("a", "b").distinct())
    n = near.count()
    groups = max(partitions(spark), -(-n // PAIRS_PER_GROUP))
    # b is the larger id; a star's centre is spread over the groups of its many partners
    near = near.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(groups)).cast("int"))
    wanted = stored(near.select("g", F.col("a").alias("rep")).unionByName(near.select("g", F.col("b").alias("rep"))).groupBy("rep").agg(F.collect_set("g").alias("gs")))
    # few texts as a rule have candidates: their list is broadcast if it is small, else shuffled
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS and n <= BROADCAST_ROWS else wanted.hint("shuffle_hash")

    def check(pair_table: pa.Table, text_table: pa.Table) -> pa.Table:
        own = dict(zip(text_table["rep"].to_pylist(), shingle_sets(text_table["text"], width)))
        kept = []
        for a, b in zip(pair_table["a"].to_pylist(), pair_table["b"].to_pylist()):
            both = len(np.intersect1d(own[a], own[b], assume_unique=True))
            if both and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                kept.append((a, b))
        del own
        tidy()
        return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})

    placed = texts.select("rep", "text").join(wanted, "rep").select(F.explode("gs").alias("g"), "rep", "text")
    return stored(near.groupBy("g").cogroup(placed.groupBy("g")).applyInArrow(check, "a bigint, b bigint").distinct())


ENTRY = ("key", "id", "n", "place", "before")


def _side(entries: DataFrame, side: str, *by: Column | str) -> DataFrame:
    own = [x for x in ("n", "place", "before", "c", "bits", "prev") if x in entries.columns]
    return entries.select(*by, F.col("id").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in own])


def _possible(percent: int) -> Column:
    """Whether entries a and b of one key can be where linked sets first meet in the order of their shingles:
    all shared shingles then are at the key or later, in both."""
    least = percent * (F.col("n_a") + F.col("n_b"))
    left_a, left_b = F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")
    return (F.least(left_a, left_b) * (100 + percent) >= least) & (F.col("c_a") != F.col("c_b"))


def _mixed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries (key, id, n, place, before, c: component) of keys that have sets of several components."""
    placed = stored(entries.join(found.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left").select(*ENTRY, F.coalesce("component", "id").alias("c")))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return stored(placed.join(mixed.hint("shuffle_hash"), "key", "left_semi"))


def _unseen(candidates: DataFrame, before: DataFrame) -> DataFrame:
    ordered = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ordered.join(before.hint("shuffle_hash"), ["a", "b"], "left_anti")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    return connected(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)) if links.take(1) else found


def text_classes(df: DataFrame, text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(digest, size, component) of each distinct text: its set's size, and the number of one text of its component."""
    texts = distinct_texts(df, text_col)
    sigs, counts = signatures(texts, width)
    n_texts, n_entries = sigs.agg(F.count("*"), F.sum(F.floor(F.col("size") * (100 - percent) / 100) + 1)).first()
    hot = hot_shingles(counts, n_texts)
    tiles = max(2 * partitions(df.sparkSession), (n_entries or 0) // TILE_ENTRIES)
    pairs, entries = tile_rows(prefix_blocks(texts, hot, tiles, width, percent), tiles, percent)
    found = connected(verified(pairs, sigs, texts, width, percent))
    # second round: under each key and size band a centre by chance, against sets of other components
    left = _mixed(entries, found)
    by = ["key", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).alias("band")]
    centres = _side(left, "a", *by).groupBy("key", "band").agg(F.min(F.struct(F.xxhash64("a", "key").alias("h"), "a", "n_a", "place_a", "c_a")).alias("x")).select("key", "band", "x.*").drop("h")
    more = _side(left, "b", *by).join(centres.hint("merge"), ["key", "band"]).where(_possible(percent))
    found = _joined(found, verified(_unseen(more, pairs), sigs, texts, width, percent))
    # last round: all that is left under a key between components, where two sets first meet as far as entries tell
    left = _mixed(left.select(*ENTRY), found).join(sigs.select(F.col("rep").alias("id"), F.col("low").alias("bits")).hint("shuffle_hash"), "id")
    # all other keys of two sets are alike as candidates, so any order of them serves to skip what an earlier key has
    earlier = Window.partitionBy("id", "n", "bits", F.col("place") == COLD).orderBy("key")
    lags = F.array_compact(F.array(*[F.lag("key", k).over(earlier) for k in (1, 2, 3)]))
    left = left.withColumn("prev", F.when(F.col("place") == COLD, lags).otherwise(F.array().cast("array<bigint>")))
    first = (F.col("before_a").bitwiseAND(F.col("before_b")) == 0) & ~F.arrays_overlap("prev_a", "prev_b")
    rest = _side(left, "a", "key").join(_side(left, "b", "key").hint("merge"), "key").where((F.col("a") < F.col("b")) & first & _possible(percent) & _bits_allow(percent))
    found = _joined(found, verified(_unseen(rest, pairs), sigs, texts, width, percent))
    own = sigs.select("digest", "size", "rep").join(found.select(F.col("node").alias("rep"), "component").hint("shuffle_hash"), "rep", "left")
    return stored(own.select("digest", "size", F.coalesce("component", "rep").alias("component")))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id."""
    rows = df.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"))
    classes = text_classes(df, text_col, width, percent).where("size > 0")
    least = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    of_text = classes.join(least.hint("shuffle_hash"), "digest")
    of_component = of_text.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(of_text.join(of_component.hint("shuffle_hash"), "component").select("digest", "size", "component_id"))
    joined = rows.join(named.hint("merge"), "digest", "left")
    return joined.select("doc_id", F.coalesce("size", F.lit(0).cast("long")).alias("n_shingles"), F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each component, the one with the least id (null last, then by the text's digest),
    and one of each set of rows with equal id and text. Texts without words all stay."""
    row, digest = fresh(df, "row"), fresh(df, "digest")
    keyed = df.withColumn(digest, digest_of(text_col))
    keyed = keyed.withColumn(row, F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(digest, F.lit("null")))))
    rows = keyed.select(F.col(id_col).alias("id"), F.col(digest).alias("digest"), F.col(row).alias("row"))
    classes = text_classes(df, text_col, width, percent).where("size > 0")
    heads = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "row")).alias("head"))
    first = heads.join(classes.hint("shuffle_hash"), "digest").groupBy("component").agg(F.min("head").alias("head")).select(F.col("head.row").alias("row"))
    others = rows.join(classes.select("digest").hint("merge"), "digest", "left_semi").select("row").distinct().join(first.hint("shuffle_hash"), "row", "left_anti")
    others = stored(others.withColumnRenamed("row", row))
    return keyed.dropDuplicates([row]).join(others.hint("shuffle_hash"), row, "left_anti").select(*df.columns)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM w WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + 4], ' ')) AS h, array_to_string(w[s:s + 4], ' ') AS x FROM pos),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sets a JOIN sets b ON a.h = b.h AND a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT pairs.a, pairs.b FROM pairs JOIN sizes x ON x.doc_id = pairs.a JOIN sizes y ON y.doc_id = pairs.b WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id
FROM w LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) USING (doc_id)
"""
