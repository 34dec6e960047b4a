"""Best-fit packing of token sequences.

Each text is encoded, closed with an end id and cut into pieces of at most ``capacity`` ids. Each task deals its
documents to the groups in turn, so that groups are of one size whatever the ids are; in each group a
best-fit-decreasing pass places every piece in the open sequence with the least room that still holds it, found
with a segment tree over the remaining capacities in logarithmic time. Full pieces are sequences of their own. A
group holds the pieces of some GROUP_DOCS documents, which is what meets in one task; it leaves at most a few
sequences partly filled, whatever the size of the corpus.

Encoding: the tokenizer works on each run of letters, digit or run of symbols alone, so a batch's distinct
parts are encoded once and looked up by hash (mixed, see common.hash_spans: with d distinct parts in a cache some
d * d / 2**65 of them would be taken for another). Where borders could matter (apostrophes, non-ASCII symbols, the
tokenizer's own special tokens), a run between white space stays whole.

Null text counts as empty (the end id alone). Repeated rows and rows without an id are packed each on their own, and ids come back as they
are, of any size and beside nulls; extra columns are ignored, also those named as the results; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import ascii_lower, hash_spans, spans, text_slices, tidy, word_counts

GROUP_DOCS = 20_000
CACHE_PARTS, CACHE_IDS = 500_000, 8_000_000

# Classes of bytes: 1 letters and all non-ASCII, 2 digits, 3 symbols; 0 is white space that never joins.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1


class PartEncoder:
    """Ids of texts by way of their distinct parts. Once it holds more than CACHE_PARTS, or CACHE_IDS ids of them, it forgets all before it learns a slice's."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, parts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        """Add parts; plain a-z words are encoded many at a time and told apart by their word-end ids."""
        if self.ends is None:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        plain = np.array([p.isalpha() for p in parts], bool)  # of bytes: a-z alone, as they are lower-cased
        found: list[list[int]] = [[]] * len(parts)
        words = np.flatnonzero(plain).tolist()
        for lo in range(0, len(words), 1000):
            some = words[lo : lo + 1000]
            ids = np.array(self._encode([b" ".join(parts[i] for i in some)])[0], np.uint32)
            pieces = np.split(ids, np.flatnonzero(self.ends[ids])[:-1] + 1)
            assert len(pieces) == len(some)
            for i, x in zip(some, pieces):
                found[i] = x
        rest = np.flatnonzero(~plain).tolist()
        for i, x in zip(rest, self._encode([parts[i] for i in rest])):
            found[i] = x
        size = np.array([len(x) for x in found], np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *[np.asarray(x, np.uint32) for x in found]])
        at = np.searchsorted(self.hashes, hashes)  # both are in order, so the insertion keeps it
        self.hashes, self.first, self.size = np.insert(self.hashes, at, hashes), np.insert(self.first, at, first), np.insert(self.size, at, size)

    ends: np.ndarray | None = None

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, ``end_id`` after each text, and each text's first place among them."""
        low = ascii_lower(buf)
        classes = _CLASS[low]
        glue = _glued(buf, classes, self.special)
        if glue is not None:
            classes, low = glue, np.where(glue == 4, buf, low)  # special tokens are told by case
        starts, ends = spans(classes, offsets)
        h = hash_spans(low, starts, ends)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            new = self.hashes[at] != distinct
        else:
            new = np.ones(len(distinct), bool)
        if new.any():
            if len(self.hashes) > CACHE_PARTS or len(self.ids) > CACHE_IDS:  # only between slices: all parts of this one are learned together
                self._clear()
                new[:] = True
            raw, some = low.tobytes(), where[new]
            self._learn(distinct[new], [raw[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist())])
        at = np.searchsorted(self.hashes, distinct)
        first, size = self.first[at][back], self.size[at][back]
        counts = word_counts(starts, offsets)
        n_docs = len(counts)
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        doc_end = np.cumsum(counts)
        doc_first = total[doc_end - counts] + np.arange(n_docs)
        out = np.full(int(total[-1]) + n_docs, end_id, np.uint32)
        doc_of = np.repeat(np.arange(n_docs), counts)
        shift = first - (total[:-1] + doc_of)  # from place in the output to place in the cache
        place = np.ones(len(out), bool)
        place[np.append(doc_first[1:], len(out)) - 1] = False
        to = np.flatnonzero(place)
        out[to] = self.ids[to + np.repeat(shift, size)]
        return out, np.append(doc_first, len(out))


_encoders: dict[str, PartEncoder] = {}


def encoder_of(tokenizer_path: str) -> PartEncoder:
    """The worker process's encoder, which its tasks share: one tokenizer and one cache in memory."""
    if tokenizer_path not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_path] = PartEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


def _glued(buf: np.ndarray, classes: np.ndarray, special: list[bytes]) -> np.ndarray | None:
    """Where a run between white space holds a special token, an apostrophe or a non-ASCII byte beside a symbol
    or digit, its parts stay together: class 4 for the whole run."""
    bad, raw = buf == 39, buf.tobytes()
    for token in special:
        at = raw.find(token)
        while at >= 0:
            bad[at] = True
            at = raw.find(token, at + len(token))
    high = buf >= 128
    if high.any():
        other = (classes == 2) | (classes == 3)
        beside = np.zeros(len(buf), bool)
        beside[1:] |= other[1:] & high[:-1]
        beside[:-1] |= other[:-1] & high[1:]
        bad |= beside
    if not bad.any():
        return None
    space = classes == 0
    run = np.cumsum(space)
    mark = np.zeros(int(run[-1]) + 1, bool)
    mark[run[bad]] = True
    return np.where(mark[run] & ~space, np.uint8(4), classes)


class RoomTree:
    """Segment tree over remaining capacities: how many open sequences have each room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a sequence with the least room of at least ``least``: (room, sequence)."""
        count, i = self.count, least + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        sequence = self.open[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, longest first; equal lengths keep their order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = RoomTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if (found := tree.take(size)) is None:
            found, n = (capacity, n), n + 1
        room, sequence[i] = found
        offset[i] = capacity - room
        if room > size:
            tree.add(room - size, int(sequence[i]))
    return sequence, offset


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, groups: int = 1) -> DataFrame:
    """(pack_group, doc_id, piece, start, length, ids_crc32) of each piece of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        dealt = TaskContext.get().partitionId() * 7919  # where this task begins to deal
        for b in batches:
            for lo, hi, buf, offsets in text_slices(b.column(1)):
                ids, first = encoder.encode(buf, offsets, end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                sizes = np.diff(first)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                at = ((first[doc] + start) * 4).tolist()
                crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at, length.tolist())]
                own = b.column(0).slice(lo, hi - lo).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array((dealt + doc) % groups), own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["pack_group", "doc_id", "piece", "start", "length", "ids_crc32"])
                dealt += hi - lo
        tidy()

    return df.select(id_col, text_col).mapInArrow(run, f"pack_group bigint, doc_id {df.schema[id_col].dataType.simpleString()}, {PIECES}")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset in place of their group."""

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns("pack_group").sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        sequence, offset = best_fit_decreasing(table["length"].to_numpy(), capacity)
        return table.append_column("sequence_id", pa.array((key[0].as_py() << 36) + sequence)).append_column("offset", pa.array(offset))

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.groupBy("pack_group").applyInArrow(place, f"doc_id {kind}, {PIECES}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    groups = max(1, -(-df.count() // GROUP_DOCS))
    return pack(token_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, groups), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
