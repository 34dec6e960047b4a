"""Benchmark decontamination: a distributed positional inverted index.

Every token of every training text is a posting. Texts are indexed in segments of some SEGMENT_BYTES, as they
come from the scan and without a shuffle: a row per segment and term with the gaps between the term's
positions in the segment, and a row (null term) with where each text begins. Positions run on over a
segment's texts with one place left free between texts.

A search takes the test items in blocks of BLOCK_WORDS words; a longer item meets the index in parts that share
no window. The terms' frequencies over the whole index come first; then only postings of terms that a possible window needs are dealt out by segment, and in each segment a
window starts from its rarest term's list and keeps the starts that the next rarer lists, shifted by their
offsets, hold too. ``phrase_matches`` gives exact windows, ``proximity_matches`` items whose rarest term has
all other terms within a distance.

A word is a run of bytes in 0-9, a-z and 0x80-0xFF after A-Z are lower-cased, which is what the contract's
pattern says of characters. Terms are 64-bit hashes of words, mixed and not linear (see common.hash_spans): with d
distinct words some d * d / 2**65 pairs of words would be taken for each other. Null or empty text has no words;
a test item without words has no window. Items with the same id are one item with the windows of all; a null id
counts as the empty string. Repeated documents are judged each on their own, also without an id; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, hash_spans, partitions, shared_dir, spans, stored, text_slices, tidy, word_counts

SEGMENT_BYTES = 12 << 20
BLOCK_WORDS = 250_000
WINDOW = 13

_WORD = np.zeros(256, np.uint8)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = 1


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a slice of texts, and how many each text has."""
    low = ascii_lower(buf)
    starts, ends = spans(_WORD[low], offsets)
    return hash_spans(low, starts, ends).view(np.int64), word_counts(starts, offsets)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the index: (postings, documents). postings: segment, term, n, gaps (little-endian int32);
    documents: segment, ordinal, doc_id, n_words."""
    kind = df.schema[id_col].dataType.simpleString()

    def segment_batch(segment: int, ids: list, terms: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n_words = np.concatenate(counts)
        owner = np.repeat(np.arange(len(n_words)), n_words)
        flat = np.concatenate(terms)
        place = np.arange(len(flat)) + owner
        begins = np.cumsum(n_words) - n_words + np.arange(len(n_words))
        order = np.argsort(flat, kind="stable")
        flat, place = flat[order], place[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1]]))
        gaps = np.diff(place, prepend=0)
        gaps[first] = place[first]
        size = np.diff(np.append(first, len(flat)))
        data = gaps.astype("<i4").tobytes()
        lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first * 4, len(data)).astype(np.int32)), pa.py_buffer(data)])
        own = np.array(len(n_words), np.int64)
        docs = pa.concat_arrays(ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), segment)), pa.array(flat[first]), pa.array(size), lists, pa.nulls(len(first), pa.int32()), pa.nulls(len(first), docs.type), pa.nulls(len(first), pa.int64())], names=columns)
        yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.nulls(1, pa.int64()), pa.array([0]), pa.array([begins.astype("<i8").tobytes()], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, docs.type), pa.nulls(1, pa.int64())], names=columns)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(own, segment)), pa.nulls(int(own), pa.int64()), pa.nulls(int(own), pa.int64()), pa.nulls(int(own), pa.binary()), pa.array(np.arange(own), pa.int32()), docs, pa.array(n_words)], names=columns)

    columns = ["segment", "term", "n", "gaps", "ordinal", "doc_id", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        ids, terms, counts, size = [], [], [], 0
        for b in batches:
            for lo, hi, buf, offsets in text_slices(b.column(1)):
                t, c = words(buf, offsets)
                ids.append(b.column(0).slice(lo, hi - lo))
                terms.append(t)
                counts.append(c)
                size += len(buf)
                if size >= SEGMENT_BYTES:
                    yield from segment_batch(segment, ids, terms, counts)
                    segment, ids, terms, counts, size = segment + 1, [], [], [], 0
        if ids:
            yield from segment_batch(segment, ids, terms, counts)
        tidy()

    table = stored(df.select(id_col, text_col).mapInArrow(run, f"segment bigint, term bigint, n bigint, gaps binary, ordinal int, doc_id {kind}, n_words bigint"))
    return table.where("n IS NOT NULL").select("segment", "term", "n", "gaps"), table.where("ordinal IS NOT NULL").select("segment", "ordinal", "doc_id", "n_words")


@dataclass
class Item:
    """An item's words, or of a long item the words of some of its windows."""

    item_id: str
    terms: np.ndarray


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Iterator[list[Item]]:
    """The test items with words, a block at a time: the stated query set."""
    held: list[Item] = []
    size = 0
    for item_id, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        buf = np.frombuffer(text.encode(), np.uint8)
        terms, _ = words(buf, np.array([0, len(buf)]))
        for lo in range(0, max(1, len(terms) - window + 1) if len(terms) else 0, BLOCK_WORDS):
            held.append(Item(item_id, terms[lo : lo + BLOCK_WORDS + window - 1]))
            size += len(held[-1].terms)
            if size >= BLOCK_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each of a block's terms occurs in the whole index."""
    wanted = index.sparkSession.createDataFrame(pd.DataFrame({"term": terms}), "term bigint")
    return dict(index.select("term", "n").join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("n")).collect())


def _per_segment(index: DataFrame, terms: np.ndarray, schema: str, match) -> DataFrame:
    """``match(lists, begins)`` on each segment's postings of ``terms``; null terms carry the begins."""
    wanted = index.sparkSession.createDataFrame(pd.DataFrame({"term": terms}), "term bigint")
    needed = index.join(F.broadcast(wanted), "term", "left_semi").unionByName(index.where("term IS NULL"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lists, begins = {}, None
        for batch in table.to_batches():
            for term, gaps in zip(batch["term"].to_pylist(), batch["gaps"]):
                if term is None:
                    begins = np.frombuffer(gaps.as_buffer(), "<i8")
                else:
                    lists[term] = np.cumsum(np.frombuffer(gaps.as_buffer(), "<i4"), dtype=np.int64)
        rows = match(lists, begins)
        del lists, begins
        tidy()
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.Table.from_pydict({"segment": [key[0]] * len(rows)} | {c: [r[i] for r in rows] for i, c in enumerate(names[1:])}, pa.schema([(n, types[n]) for n in names]))

    types = {"segment": pa.int64(), "ordinal": pa.int32(), "item_id": pa.string(), "start": pa.int64(), "end": pa.int64(), "spread": pa.int64()}
    return needed.repartition(partitions(index.sparkSession), "segment").groupBy("segment").applyInArrow(run, schema)


def _holds(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def phrase_matches(index: DataFrame, items: list[Item], window: int = WINDOW) -> DataFrame:
    """(segment, ordinal, item_id, start, end): each occurrence of a window of an item, as word positions
    in its text, end exclusive; overlapping occurrences of one item are merged."""
    often = _frequencies(index, np.unique(np.concatenate([i.terms for i in items])))
    plans = []  # (item, its terms, how often each occurs, the starts of windows all of whose terms occur)
    for item in items:
        size = min(window, len(item.terms))
        n = np.array([often.get(t, 0) for t in item.terms.tolist()])
        lacks = np.concatenate([[0], np.cumsum(n == 0)])
        if len(possible := np.flatnonzero(lacks[size:] == lacks[:-size])):
            plans.append((item.item_id, item.terms, n, possible))
    needed = np.unique(np.concatenate([t[n > 0] for _, t, n, _ in plans])) if plans else np.zeros(0, np.int64)

    def match(lists: dict[int, np.ndarray], begins: np.ndarray) -> list[tuple]:
        found: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for item_id, terms, n, possible in plans:
            size = min(window, len(terms))
            lacks = np.concatenate([[0], np.cumsum([t not in lists for t in terms.tolist()])])
            for w in possible[lacks[possible + size] == lacks[possible]].tolist():
                starts = None
                for o in np.argsort(n[w : w + size], kind="stable").tolist():  # from the rarest term on
                    own = lists[int(terms[w + o])]
                    starts = own - o if starts is None else starts[_holds(own, starts + o)]
                    if not len(starts):
                        break
                else:
                    docs = np.searchsorted(begins, starts, "right") - 1
                    for s, d in zip((starts - begins[docs]).tolist(), docs.tolist()):
                        found.setdefault((d, item_id), []).append((s, s + size))
        rows = []
        for (d, item_id), own in sorted(found.items()):
            own.sort()
            s, e = own[0]
            for a, b in own[1:]:
                if a > e:
                    rows.append((d, item_id, s, e))
                    s, e = a, b
                e = max(e, b)
            rows.append((d, item_id, s, e))
        return rows

    return _per_segment(index, needed, "segment bigint, ordinal int, item_id string, start bigint, end bigint", match)


def proximity_matches(index: DataFrame, items: list[Item], within: int) -> DataFrame:
    """(segment, ordinal, item_id, start, spread): places of an item's rarest term that have each of its
    other terms at most ``within`` words away in the same text; spread: the farthest of the nearest."""
    often = _frequencies(index, np.unique(np.concatenate([i.terms for i in items])))
    plans = [(i.item_id, sorted(set(i.terms.tolist()), key=lambda t: (often[t], t))) for i in items if all(t in often for t in i.terms.tolist())]
    needed = np.unique(np.array([t for _, ts in plans for t in ts], np.int64))

    def match(lists: dict[int, np.ndarray], begins: np.ndarray) -> list[tuple]:
        rows = []
        for item_id, terms in plans:
            if any(t not in lists for t in terms):
                continue
            at = lists[terms[0]]
            docs, spread = np.searchsorted(begins, at, "right") - 1, np.zeros(len(at), np.int64)
            for t in terms[1:]:
                own = lists[t]
                near = np.full(len(at), within + 1)
                for side in (np.searchsorted(own, at) - 1, np.searchsorted(own, at)):
                    ok = (side >= 0) & (side < len(own))
                    p = own[np.clip(side, 0, len(own) - 1)]
                    ok &= np.searchsorted(begins, p, "right") - 1 == docs
                    near = np.where(ok, np.minimum(near, np.abs(p - at)), near)
                spread = np.maximum(spread, near)
            keep = spread <= within
            rows += [(d, item_id, s, x) for d, s, x in zip(docs[keep].tolist(), (at - begins[docs])[keep].tolist(), spread[keep].tolist())]
        return rows

    return _per_segment(index, needed, "segment bigint, ordinal int, item_id string, start bigint, spread bigint", match)


def contamination(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index, docs = build_index(df, id_col, text_col)
    hits, path = None, shared_dir(df.sparkSession)
    for block in item_blocks(benchmark, window=window):  # the hits of all blocks are one table
        own = phrase_matches(index, block, window)
        own.write.mode("append").parquet(path)
        hits = df.sparkSession.read.schema(own.schema).parquet(path)
    docs = docs.withColumnRenamed("doc_id", id_col)
    if hits is None:
        per_doc = docs.select("segment", "ordinal").limit(0).withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    else:
        # words in the union of a text's spans: each span adds what lies beyond all before it
        covered = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "end"))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")), lambda a: a["n"])
        per_doc = hits.groupBy("segment", "ordinal").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    joined = docs.join(per_doc.hint("shuffle_hash"), ["segment", "ordinal"], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(id_col, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM bs),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw)),
hits AS (SELECT doc_id, item_id, s, k FROM (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM ds) JOIN bw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, list(DISTINCT item_id ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
