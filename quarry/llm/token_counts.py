"""Token counts that follow edits.

A text is split into pre-tokens, which the tokenizer encodes each on its own; the counts are the leaves of a
segment tree that also sums characters. An edit finds its leaves by character position, re-splits only from
the last untouched leaf with a visible character before it (what stands left of that cannot change) until
the new borders meet an old border again, re-encodes those pre-tokens and updates the sums above them. The
count is at the root.

Trees are kept by their leaves (``count_trees``), and a table of edits by document is applied to what was kept
(``edit_trees``), so that later edits neither split nor encode the rest of a text again.

Null text counts as empty (0 tokens). Repeated rows are counted each on their own; extra columns are ignored, also those
named as the results; an empty table gives an empty result; memory follows one text and a bounded table of pre-tokens' counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored

CACHE = 500_000
Edit = tuple[int, int, str]  # start, end, replacement; positions in the text as it then is


class Known(dict):
    """Tokens of pre-tokens. What is missing comes from an older table, else it is encoded."""

    def __init__(self, encode, older: dict[str, int]):
        self.encode, self.older = encode, older

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        self[piece] = n = len(self.encode(piece)) if n is None else n
        return n


class PieceCounter:
    """Tokens of pre-tokens of a byte-level BPE. Remembers some CACHE of them: half of these are kept
    when the newer half is full, and of them those that come up again stay."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known = Known(self.encoding.encode_ordinary, {})

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.known) > CACHE // 2:
            self.known = Known(self.known.encode, dict(self.known))
        return list(map(self.known.__getitem__, pieces))


_counters: dict[tuple[str, str], PieceCounter] = {}


def counter_of(ranks_path: str, pattern: str) -> PieceCounter:
    """The worker process's counter, which its tasks share."""
    if (ranks_path, pattern) not in _counters:
        _counters.clear()
        _counters[ranks_path, pattern] = PieceCounter(ranks_path, pattern)
    return _counters[ranks_path, pattern]


class CountedText:
    """Segment tree over a text's pre-tokens: tokens and characters below each node."""

    def __init__(self, text: str, counter: PieceCounter):
        leaves = counter.split(text)
        self._build(leaves, counter.counts(leaves), counter)

    @classmethod
    def restored(cls, text: str, chars: list[int], tokens: list[int], counter: PieceCounter) -> CountedText:
        """The tree of a text whose leaves (characters and tokens of each) were kept: nothing is split or encoded."""
        ends = np.cumsum(np.array(chars, np.int64)).tolist()
        if (ends[-1] if ends else 0) != len(text) or len(tokens) != len(chars):
            raise ValueError("the leaves aren't those of this text")
        tree = cls.__new__(cls)
        tree._build([text[e - n : e] for e, n in zip(ends, chars)], tokens, counter)
        return tree

    def _build(self, leaves: list[str], counts: list[int], counter: PieceCounter) -> None:
        self.counter = counter
        self.leaves = leaves  # an edit may put several pre-tokens into one leaf, or none
        n = len(self.leaves)
        self.size = 1 << max(n - 1, 0).bit_length()
        self.tokens, self.chars = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        if n:
            self.tokens[self.size : self.size + n] = counts
            self.chars[self.size : self.size + n] = list(map(len, self.leaves))
        for tree in (self.tokens, self.chars):
            lo = self.size
            while lo > 1:
                tree[lo // 2 : lo] = tree[lo : 2 * lo : 2] + tree[lo + 1 : 2 * lo : 2]
                lo //= 2
        self.reencoded = 0

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf, without leaves that edits emptied."""
        chars, tokens = (x[self.size : self.size + len(self.leaves)] for x in (self.chars, self.tokens))
        return chars[chars > 0].tolist(), tokens[chars > 0].tolist()

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf beyond the end), and where it starts."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i]:
                before += int(self.chars[i])
                i += 1
        return min(i - self.size, len(self.leaves) - 1), before

    def _put(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = "".join(pieces)
        i = leaf + self.size
        up = (sum(counts) - self.tokens[i], len(self.leaves[leaf]) - self.chars[i])
        while i:
            self.tokens[i] += up[0]
            self.chars[i] += up[1]
            i //= 2

    def _clear(self, lo: int, hi: int) -> None:
        """Empty the leaves lo..hi-1 and sum anew above them, a level at a time."""
        if lo >= hi:
            return
        self.leaves[lo:hi] = [""] * (hi - lo)
        a, b = lo + self.size, hi - 1 + self.size
        for tree in (self.tokens, self.chars):
            tree[a : b + 1] = 0
            x, y = a // 2, b // 2
            while x:
                tree[x : y + 1] = tree[2 * x : 2 * y + 2 : 2] + tree[2 * x + 1 : 2 * y + 2 : 2]
                x, y = x // 2, y // 2

    def edit(self, start: int, end: int, new: str) -> None:
        n = int(self.chars[1])
        start, end = max(0, min(start, n)), max(0, min(end, n))
        if not self.leaves:
            self.__init__(new, self.counter)
            self.reencoded += len(self.leaves)
            return
        first, _ = self._find(start)
        while first > 0:  # back to an untouched leaf with a visible character
            first -= 1
            if self.leaves[first] and not self.leaves[first].isspace():
                break
        at = self._start(first)
        last, _ = self._find(max(end - 1, 0))
        last += 1
        old = "".join(self.leaves[first:last])
        upto = at + len(old)
        step = 8
        while True:
            tail = "".join(self.leaves[last : last + step])
            changed = old[: start - at] + new + old[end - at :]
            region = self.counter.split(changed + tail)
            borders = self._borders(last, last + step, upto)
            reached = last + step >= len(self.leaves)
            shift = len(new) - (end - start)
            place, pieces, sync = at, [], None
            whole = changed + tail
            for p in region:
                pieces.append(p)
                place += len(p)
                if place - shift in borders and (reached or not (whole[place - at :] == "" or whole[place - at :].isspace())):
                    sync = borders[place - shift]
                    break
            if sync is not None:
                break
            if reached:
                sync = len(self.leaves)
                pieces = region
                break
            step *= 2
        counts = self.counter.counts(pieces)
        self.reencoded += len(pieces)
        self._clear(first + 1, sync)
        self._put(first, pieces, counts)

    def _start(self, leaf: int) -> int:
        i, before = leaf + self.size, 0
        while i > 1:
            if i & 1:
                before += int(self.chars[i - 1])
            i //= 2
        return before

    def _borders(self, lo: int, hi: int, at: int) -> dict[int, int]:
        """Old character position of each leaf border from ``lo`` on: the first leaf to keep."""
        out = {at: lo}
        for leaf in range(lo, min(hi, len(self.leaves))):
            at += len(self.leaves[leaf])
            out[at] = leaf + 1
        return out


def sample_edits(n_chars: int) -> list[Edit]:
    """The edits of the query: a tenth in the middle goes, a note comes in at a third, a word at the end."""
    middle = n_chars // 2
    return [(middle, middle + n_chars // 10, ""), (n_chars // 3, n_chars // 3, " [edited 2024] "), (10**9, 10**9, " end")]


def edited(text: str, edits: list[Edit]) -> str:
    for start, end, new in edits:
        start, end = min(start, len(text)), min(end, len(text))
        text = text[:start] + new + text[end:]
    return text


def count_tokens(df: DataFrame, ranks_path: str, pattern: str, edits_of=sample_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens before and after its edits, pre-tokens, and how many the edits re-encoded."""
    names = [id_col, "n_tokens", "n_pretokens", "edited_tokens", "reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(ranks_path, pattern)
        for b in batches:
            rows = []
            for text in b.column(1):
                tree = CountedText(text.as_py() or "", counter)
                before, pieces = tree.n_tokens, len(tree.leaves)
                for e in edits_of(int(tree.chars[1])):
                    tree.edit(*e)
                rows.append((before, pieces, tree.n_tokens, tree.reencoded))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, n_pretokens bigint, edited_tokens bigint, reencoded bigint")


TREE = {"text": pa.string(), "leaf_chars": pa.list_(pa.int32()), "leaf_tokens": pa.list_(pa.int32()), "n_tokens": pa.int64(), "reencoded": pa.int64()}
_TREE = "text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens bigint, reencoded bigint"
FEW_EDITED = 100_000  # documents whose edits are sent to the scan of the trees


def _as_batch(ids: pa.Array, trees: list[CountedText], id_col: str) -> pa.RecordBatch:
    leaves = [t.kept() for t in trees]
    columns = ([t.text() for t in trees], [c for c, _ in leaves], [n for _, n in leaves], [t.n_tokens for t in trees], [t.reencoded for t in trees])
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, TREE.values())]], names=[id_col, *TREE])


def count_trees(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, leaf_chars, leaf_tokens, n_tokens, reencoded: all leaves): each document's tree, to be stored. Sums above
    the leaves are made when a tree is used. Null text counts as empty; repeated rows have trees of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(ranks_path, pattern)
        for b in batches:
            trees = [CountedText(t.as_py() or "", counter) for t in b.column(1)]
            for t in trees:
                t.reencoded = len(t.leaves)
            yield _as_batch(b.column(0), trees, id_col)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {_TREE}")


def edit_trees(trees: DataFrame, edits: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``trees`` (of ``count_trees``, or of an earlier call) after ``edits`` (id, seq, start, end, replacement: positions in
    the text as it then is). A document's edits are applied in the order of seq, equal ones by place and text; only
    pre-tokens around them are split and encoded anew, and ``reencoded`` tells how many. Trees without edits stay as they
    are, with 0. Null replacements count as empty, null places as the text's end; edits of unknown or null ids do nothing;
    all rows of a repeated id are edited."""
    own = edits.select(F.col(id_col).alias("_id"), "seq", F.coalesce(F.col("start").cast("long"), F.lit(1 << 40)).alias("start"), F.coalesce(F.col("end").cast("long"), F.lit(1 << 40)).alias("end"), F.coalesce("replacement", F.lit("")).alias("replacement"))
    listed = own.where("_id IS NOT NULL").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    listed = stored(listed)
    few = listed.count() <= FEW_EDITED
    held = trees.select(id_col, *TREE)
    joined = held.join(listed.hint("broadcast" if few else "merge"), held[id_col] == listed["_id"], "left").drop("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(ranks_path, pattern)
        for b in batches:
            changed, at, out = b.column(6).is_valid(), [], []
            for i in np.flatnonzero(changed.to_numpy(zero_copy_only=False)).tolist():
                text, chars, tokens = (b.column(j)[i].as_py() for j in (1, 2, 3))
                tree = CountedText.restored(text, chars, tokens, counter)
                for e in b.column(6)[i].as_py():
                    tree.edit(e["start"], max(e["start"], e["end"]), e["replacement"])
                at.append(i)
                out.append(tree)
            if out:
                yield _as_batch(b.column(0).take(pa.array(at)), out, id_col)
            same = b.filter(pc.invert(changed))
            if same.num_rows:
                yield pa.RecordBatch.from_arrays([*same.columns[:5], pa.array(np.zeros(same.num_rows, np.int64))], names=[id_col, *TREE])

    return joined.mapInArrow(run, f"`{id_col}` {trees.schema[id_col].dataType.simpleString()}, {_TREE}")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
