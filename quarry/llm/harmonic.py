"""Harmonic packing of token sequences.

Classes of pieces have reciprocal capacities as their lengths: a piece of class k has floor(capacity / k) ids, and a
sequence of that class holds k of them, no fewer and no more. Documents are cut to such lengths: whole capacities
first, then the longest class length that what is left can fill, and so on; what is left shrinks with its square, so
a document ends in two or three pieces as a rule. Of the class lengths those are used whose sequences have at most
``most_padding`` ids of padding.

Each task fills the sequences of its classes on its own, in one pass over its texts and without a shuffle; it holds the
open sequence of each class. What stands in open sequences when its texts are done is laid end to end and cut anew into
full sequences and, for the rest, sequences of powers of two, which aren't padded.

Null text counts as empty (the end id alone). Repeated rows and rows without an id are packed each on their own; extra
columns are ignored, also those named as the results; an empty table gives an empty result. Texts of any length are
encoded a slice at a time, and a text that is longer than a slice on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import text_slices, tidy
from quarry.llm.packing import encoder_of

FLUSH_ROWS = 50_000
FIELDS = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
Piece = tuple[object, int, int, bytes]  # id of its document, start there, the document's tokens, ids


def class_lengths(capacity: int, most_padding: int) -> dict[int, int]:
    """Length of a class's pieces: how many of them fill a sequence."""
    lengths = {capacity // k for k in range(1, capacity + 1)}
    return {n: capacity // n for n in sorted(lengths, reverse=True) if capacity % n <= most_padding}


def cuts(capacity: int, lengths: dict[int, int]) -> list[list[int]]:
    """Lengths of the pieces of a rest of each size below ``capacity``."""
    known = sorted(lengths)
    out: list[list[int]] = [[]]
    for size in range(1, capacity):
        first = known[int(np.searchsorted(known, size, "right")) - 1]
        out.append([first, *out[size - first]])
    return out


class HarmonicPacker:
    """Open sequences of one task. ``add`` takes a piece; ``rows`` are those of sequences that are full."""

    def __init__(self, capacity: int, most_padding: int, first_sequence: int):
        self.capacity, self.lengths = capacity, class_lengths(capacity, most_padding)
        self.cuts = cuts(capacity, self.lengths)
        self.open: dict[int, list[Piece]] = {}
        self.sequence, self.rows = first_sequence, []

    def add_document(self, own_id: object, ids: memoryview) -> None:
        """``ids``: bytes of little-endian unsigned 32-bit ids."""
        total, at = len(ids) // 4, 0
        for n in [*[self.capacity] * (total // self.capacity), *self.cuts[total % self.capacity]]:
            self.add(n, (own_id, at, total, bytes(ids[4 * at : 4 * (at + n)])))
            at += n

    def add(self, n: int, piece: Piece) -> None:
        held = self.open.setdefault(n, [])
        held.append(piece)
        if len(held) == self.lengths[n]:
            self._close([(p, i * n) for i, p in enumerate(held)])
            held.clear()

    def _close(self, placed: list[tuple[Piece, int]]) -> None:
        self.rows += [(own_id, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset) for (own_id, start, total, ids), offset in placed]
        self.sequence += 1

    def finish(self) -> None:
        """Close what is open: full sequences, then powers of two, cut from its pieces end to end."""
        rest = [p for n in sorted(self.open, reverse=True) for p in self.open[n]]
        self.open.clear()
        left = sum(len(p[3]) for p in rest) // 4
        placed, room, size = [], 0, 0
        for own_id, start, total, ids in rest:
            while ids:
                if not room:
                    size = room = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1
                n = min(room, len(ids) // 4)
                placed.append(((own_id, start, total, ids[: 4 * n]), size - room))
                ids, start, room, left = ids[4 * n :], start + n, room - n, left - n
                if not room:
                    self._close(placed)
                    placed = []


def pack_harmonic(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, most_padding: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of each text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, id_type = encoder_of(tokenizer_path), HarmonicPacker(capacity, most_padding, TaskContext.get().partitionId() << 36), None

        def taken() -> pa.RecordBatch:
            columns = list(zip(*packer.rows))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, t) for c, t in zip(columns[1:], FIELDS.values())]], names=["doc_id", *FIELDS])

        for b in batches:
            id_type = b.schema.field(0).type
            ids_of = b.column(0).to_pylist()
            for lo, hi, buf, offsets in text_slices(b.column(1)):
                ids, first = encoder.encode(buf, offsets, end_id)
                raw, bounds = memoryview(ids.astype("<u4").tobytes()), (first * 4).tolist()
                for i in range(hi - lo):
                    packer.add_document(ids_of[lo + i], raw[bounds[i] : bounds[i + 1]])
                if len(packer.rows) >= FLUSH_ROWS:
                    yield taken()
        packer.finish()
        if packer.rows:
            yield taken()
        tidy()

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} bigint' for n in FIELDS)}")


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_harmonic(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
