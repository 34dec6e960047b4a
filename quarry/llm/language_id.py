"""Language ID: cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text per language recognises every substring of that
sample. A text is parsed greedily into the longest matches; the fewer phrases a language needs, the closer
it is. Phrases are normalised by the sample's size: c * log2(n) / length, the cross entropy's estimate in
bits. The least wins; ties go to the first language by name.

The automata are flattened to one transition table in which a missing transition restarts at the root and
marks a phrase, so thousands of runs of text advance together, one byte a step, with numpy. A text is cut
into runs of RUN bytes; each cut costs at most one phrase in every language alike. Whole texts are parsed.

Null text or one without a letter: ``und`` and score 0. No labelled rows: ``und`` for all; an empty table gives an
empty result. Repeated rows are predicted alike and learned once; rows without an id are predicted too, and never
held out; texts of any length are parsed a slice at a time; extra columns are ignored. The table of all automata is
bounded by the characters of the sample (``fit``): of very many languages each has its least share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored, text_slices

RUN = 512
PARTS = 32  # of a language, so that no task ranks all of its texts
SEPARATOR = 0


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


class SuffixAutomaton:
    """States with transitions by symbol; built online in linear time."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class LanguageModel:
    """One table for all languages. ``step[state * width + symbol]`` is (next state * width) << 1 | phrase."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(k for k, v in samples.items() if v)
        raw = {k: np.frombuffer(samples[k].lower().encode(), np.uint8) for k in self.languages}
        seen = np.unique(np.concatenate([*raw.values(), np.zeros(0, np.uint8)]))
        letters = [b for b in seen.tolist() if b >= 128 or 97 <= b <= 122]
        self.symbol = np.full(256, SEPARATOR, np.uint8)
        self.symbol[128:] = len(letters) + 1  # never seen: no automaton has it
        self.symbol[97:123] = len(letters) + 1
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 2
        blocks, self.roots, self.log_n, at = [], [], [], 0
        for k in self.languages:
            states = SuffixAutomaton(self.symbol[raw[k]].tolist()).next
            root, table = at, np.empty((len(states), self.width), np.int64)
            first = np.array([((root + states[0].get(c, 0)) * self.width) << 1 | 1 for c in range(self.width)])
            table[:] = first
            for i, to in enumerate(states):
                for c, j in to.items():
                    table[i, c] = ((root + j) * self.width) << 1
            blocks.append(table.ravel())
            self.roots.append(root * self.width)
            self.log_n.append(math.log2(len(raw[k]) + 1))
            at += len(states)
        self.step = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
        if not blocks or self.step.max() < 1 << 31:
            self.step = self.step.astype(np.int32)

    def phrases(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each language needs for each text: (texts, languages)."""
        sizes = np.diff(offsets)
        n_runs = -(-sizes // RUN)
        owner = np.repeat(np.arange(len(sizes)), n_runs)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        start = offsets[:-1][owner] + nth * RUN
        length = np.minimum(RUN, offsets[1:][owner] - start)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        symbols = self.symbol[buf].astype(self.step.dtype)
        n_lang = len(self.languages)
        state = np.repeat(np.array(self.roots, self.step.dtype)[:, None], len(start), 1)
        count = np.ones((n_lang, len(start)), np.int32)
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
        for t, k in enumerate(active.tolist()):
            v = self.step[state[:, :k] + symbols[start[:k] + t]]
            count[:, :k] += v & 1
            state[:, :k] = v >> 1
        out = np.zeros((len(sizes), n_lang))
        for j in range(n_lang):
            out[:, j] = np.bincount(owner, weights=count[j], minlength=len(sizes))
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = np.array([*self.languages, "und"], object), np.zeros(len(texts))
        pred = np.full(len(texts), len(self.languages))
        if self.languages:
            for lo, hi, buf, offsets in text_slices(pc.utf8_lower(texts)):
                cost = self.phrases(buf, offsets) * np.array(self.log_n)
                best = cost.argmin(1)
                low = np.partition(cost, 1, axis=1)[:, :2] if len(self.languages) > 1 else np.column_stack([cost[:, 0], np.zeros(hi - lo)])
                total = low.sum(1)
                pred[lo:hi] = best
                scores[lo:hi] = np.divide(low[:, 1] if len(self.languages) > 1 else total, total, out=np.zeros(hi - lo), where=total > 0)
                plain = np.zeros(len(buf) + 1, np.int64)
                np.cumsum((buf >= 97) & (buf <= 122), out=plain[1:])
                for i in np.flatnonzero(plain[offsets[1:]] == plain[offsets[:-1]]).tolist():
                    if not any(map(str.isalpha, texts[lo + i].as_py() or "")):
                        pred[lo + i], scores[lo + i] = len(self.languages), 0.0
        return names[pred].tolist(), scores


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 96, chars_per_language: int = 60_000, max_chars: int = 240_000, least_chars: int = 500) -> LanguageModel:
    """Learn from a bounded sample: of each language the distinct whole texts that come first by hash, at most
    ``docs_per_language`` of them, with a language's share of ``max_chars`` characters together (not over
    ``chars_per_language``, not under ``least_chars``). Every language that has a text is learned: one whose texts are
    all longer than its share gives the beginning of its shortest text. Only hashes of texts are shuffled, copies made
    one before that; the driver gets the chosen texts."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.length(text_col).cast("long").alias("n"), F.col(text_col).alias("t"))
    shortest = stored(rows.where("n > 0").groupBy("lang").agg(F.min(F.struct("n", "h")).alias("s"))).select("lang", "s.h", "s.n")
    most = max(least_chars, min(chars_per_language, max_chars // max(1, shortest.count())))
    by_hash, by_part = Window.partitionBy("lang").orderBy("h", "n"), Window.partitionBy("lang", "part").orderBy("h", "n")
    first = rows.where(F.col("n").between(1, most)).groupBy("lang", "h", "n").agg(F.pmod("h", F.lit(PARTS)).alias("part"))
    for w in (by_part, by_hash):  # the first of each part of a language, then the first of those
        first = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= docs_per_language)
    whole = first.withColumn("upto", F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= most).select("lang", "h", "n")
    chosen = whole.unionByName(shortest.where(F.col("n") > most))
    texts = rows.join(F.broadcast(chosen), ["lang", "h", "n"]).groupBy("lang", "h", "n").agg(F.min(F.left("t", F.lit(most))).alias("t"))  # at most docs_per_language for each language are broadcast
    parts: dict[str, list[str]] = {}
    for r in sorted(texts.collect()):
        parts.setdefault(r.lang, []).append(r.t)
    return LanguageModel({k: "\n".join(v) for k, v in parts.items()})


def predict(df: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``df`` with lang_pred and score of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's parameters
    kept = df.select(*keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    return predict(docs, fit(docs.where("NOT held_out")), ["doc_id", "held_out"])
