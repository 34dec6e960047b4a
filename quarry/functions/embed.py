"""Embedders: text to vectors of a fixed size, by Arrow batches.

An embedder is a function from a list of texts to an array of vectors; it is made once for each task, so a
model is loaded once. A batch that fails gives zero vectors and ``embed_ok`` false, which can be counted and
left out of a search. The built-in embedder is signed feature hashing, which SQL can express too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 100
KNOWN = 100_000  # words whose places a task remembers; the commonest come back at once
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Embedder:
    """``make()`` gives the function of a task; ``dim`` is the size of its vectors."""

    name: str
    make: Callable[[], Callable[[list[str]], np.ndarray]]
    dim: int


_registry: dict[str, Embedder] = {}


def register_embedder(name: str, make: Callable[[], Callable[[list[str]], np.ndarray]], dim: int) -> Embedder:
    if not callable(make) or dim < 1:
        raise TypeError("an embedder needs a callable and a size of at least 1")
    _registry[name] = Embedder(name, make, dim)
    return _registry[name]


def embedder(name: str) -> Embedder:
    if name not in _registry:
        raise ValueError(f"no embedder {name!r}; there are: {', '.join(sorted(_registry))}")
    return _registry[name]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Tokens [a-z0-9]+ of the lower-cased text; bucket: first 8 hex digits of md5 modulo ``dim``; sign: the
    9th digit's parity; vectors have length 1, or 0 without tokens."""

    def make() -> Callable[[list[str]], np.ndarray]:
        known: dict[str, tuple[int, int]] = {}

        def place(token: str) -> tuple[int, int]:
            if (found := known.get(token)) is None:
                if len(known) >= KNOWN:
                    known.clear()
                digest = hashlib.md5(token.encode()).hexdigest()
                found = known[token] = (int(digest[:8], 16) % dim, 1 - 2 * (int(digest[8], 16) % 2))
            return found

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                tokens = _TOKEN.findall(text.lower())
                if tokens:
                    at = np.array([place(t) for t in tokens])
                    out[i] = np.bincount(at[:, 0], weights=at[:, 1], minlength=dim)
            length = np.sqrt((out * out).sum(1, keepdims=True))
            return np.divide(out, length, out=np.zeros_like(out), where=length > 0)

        return embed

    return Embedder(f"hash{dim}", make, dim)


def embedded(by: Embedder, text_col: str = "content", batch: int = BATCH, precise: bool = False) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """``make()`` of a task: a function that adds embedding and embed_ok to a batch."""
    number = pa.float64() if precise else pa.float32()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        function = by.make()

        def add(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = ["" if t is None else t for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            vectors, ok = np.zeros((len(texts), by.dim)), np.ones(len(texts), bool)
            for lo in range(0, len(texts), batch):
                try:
                    vectors[lo : lo + batch] = function(texts[lo : lo + batch])
                except Exception:  # noqa: BLE001  any failure of a model is this batch's alone
                    ok[lo : lo + batch] = False
                    vectors[lo : lo + batch] = 0
            offsets = pa.array(np.arange(len(texts) + 1) * by.dim, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel(), number))
            return pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(ok)], names=[*b.schema.names, "embedding", "embed_ok"])

        return add

    return make


def embedded_fields(precise: bool) -> str:
    return f"embedding array<{'double' if precise else 'float'}>, embed_ok boolean"


def embed(df: DataFrame, by: Embedder, text_col: str = "content", batch: int = BATCH, precise: bool = False) -> DataFrame:
    """``df`` with embedding (float, or double if ``precise``) and embed_ok. Null texts count as empty."""
    make = embedded(by, text_col, batch, precise)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(make(), batches)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {embedded_fields(precise)}")


register_embedder("hash64", hashing_embedder(64).make, 64)
