"""Chunks of texts: overlapping runs of lines, and structural units by rules on lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.embed import Embedder, embedded, embedded_fields
from quarry.functions.units import SCANNERS, Unit, line_numbers

MAX_CHARS = 1000
OVERLAP = 100
FLUSH_CHARS = 4 << 20


def line_ranges(lengths: list[int], max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) line of each chunk, from 1. A chunk ends with the line that fills it; the next begins
    with the longest run of its last lines within ``overlap``. Where the last line fills a chunk, its
    overlap is one more chunk."""
    out, n, s, done = [], len(lengths), 1, 0
    while True:
        size, e = sum(lengths[s - 1 : done]) + done - s + 1, done
        filled = False
        while e < n and not filled:
            size += lengths[e] + 1
            e += 1
            filled = size >= max_chars
        out.append((s, e))
        if not filled:
            return out
        k, tail = e + 1, 0
        while k > s and tail + lengths[k - 2] + e - k + 1 <= overlap:
            k -= 1
            tail += lengths[k - 1]
        start = k  # k - 1 is the first line from the end that no longer fits, if any fits not
        if e == n:
            if start <= n:
                out.append((start, n))
            return out
        s, done = start, e


def _expanded(df: DataFrame, keep: list[str], inputs: list[str], rows_of: Callable[..., Iterator[tuple]], fields: dict[str, str], by: Embedder | None = None) -> DataFrame:
    """``keep`` columns with the rows that ``rows_of`` makes of the ``inputs`` of each row, on its executor; the
    last of ``fields`` (name -> int or string) is the longest. Rows go out every FLUSH_CHARS characters of it, with
    their (double) vectors if an embedder is given: a task then has one Python process, not two."""
    make = embedded(by, list(fields)[-1], precise=True) if by else lambda: lambda b: b
    kept = df.select(*keep, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    arrow = {"int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = make()
        for b in batches:

            def made(owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
                at, cols = pa.array(owner, pa.int64()), list(zip(*rows))
                return pa.RecordBatch.from_arrays([*[b.column(j).take(at) for j in range(len(keep))], *[pa.array(c, arrow[t]) for c, t in zip(cols, fields.values())]], names=[*keep, *fields])

            owner, rows, size = [], [], 0
            for i, values in enumerate(zip(*b.columns[len(keep) :])):
                for row in rows_of(*(v.as_py() for v in values)):
                    owner.append(i)
                    rows.append(row)
                    size += len(row[-1])
                    if size >= FLUSH_CHARS:
                        yield add(made(owner, rows))
                        owner, rows, size = [], [], 0
            if rows:
                yield add(made(owner, rows))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(run, ", ".join(filter(None, [own, *(f"{n} {t}" for n, t in fields.items()), embedded_fields(True) if by else ""])))


CHUNK = {"chunk_no": "int", "start_line": "int", "end_line": "int", "content": "string"}


def _line_chunks(lines: list[str], first: int, max_chars: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    for k, (s, e) in enumerate(line_ranges([len(x) for x in lines], max_chars, overlap)):
        yield k, s + first - 1, e + first - 1, "\n".join(lines[s - 1 : e])


def chunk_lines(df: DataFrame, keep: list[str], text_col: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, first_line: str | None = None, by: Embedder | None = None) -> DataFrame:
    """``keep`` columns with chunk_no (from 0), start_line, end_line and content of each chunk of each text, and with
    embedding and embed_ok if it is to be embedded in the same pass (``by``).

    A text is folded in one pass on its executor; ``first_line`` names a column with the number of the
    text's first line. Null texts give no chunk.
    """

    def rows_of(text: str, first: int = 1) -> Iterator[tuple]:
        return _line_chunks(text.split("\n"), first, max_chars, overlap)

    return _expanded(df.where(F.col(text_col).isNotNull()), keep, [text_col, first_line] if first_line else [text_col], rows_of, CHUNK, by)


@dataclass(frozen=True)
class UnitRule:
    """A unit of ``kind`` begins at a line (column 0) that ``regex`` matches; ``name`` extracts its name
    with its first group. A ``prefix`` line (a decorator) joins the unit on the next line."""

    kind: str
    regex: str
    name: str | None = None
    prefix: bool = False


#: Of a language either line rules or a scanner of its syntax (``units``).
Rules = dict[str, tuple[UnitRule, ...] | Callable[[str], Iterator[Unit]]]
RULES: Rules = dict(SCANNERS)


_INSIDE = re.compile(r"\s|$|[\])}]", re.A)


def _units(lines: list[str], rules: list[tuple]) -> Iterator[tuple[str, str | None, int, int, str]]:
    """(kind, name, first line, last line, content) of each unit; ``rules``: (regex, kind, name's regex, prefix)."""
    unit, joins = None, False

    def closed(last: int) -> Iterator[tuple]:
        if unit:
            while not lines[last - 1].strip(" "):
                last -= 1
            yield *unit, last, "\n".join(lines[unit[2] - 1 : last])

    for n, line in enumerate(lines, 1):
        if _INSIDE.match(line):
            joins = False
            continue
        rule = next((r for r in rules if r[0].search(line)), None)
        if not joins:
            yield from closed(n - 1)
            name = rule[2].search(line) if rule and rule[2] else None
            unit = (rule[1], (name[1] or None) if name else None, n) if rule else None
        joins = bool(rule and rule[3])
    yield from closed(len(lines))


def _compiled(rules: Rules) -> dict[str, Callable[[str], Iterator[tuple]]]:
    """Of each language the function that gives the units of a text: (kind, name, first line, last line, content)."""

    def by_lines(own: tuple[UnitRule, ...]) -> Callable[[str], Iterator[tuple]]:
        patterns = [(re.compile(r.regex, re.A), r.kind, re.compile(r.name, re.A) if r.name else None, r.prefix) for r in own]
        return lambda text: _units(text.split("\n"), patterns)

    def by_syntax(scan: Callable[[str], Iterator[Unit]]) -> Callable[[str], Iterator[tuple]]:
        return lambda text: line_numbers(text, scan(text))

    return {k: by_syntax(own) if callable(own) else by_lines(own) for k, own in rules.items()}


UNIT = {"kind": "string", "name": "string", "start_line": "int", "end_line": "int", "content": "string"}


def structural_units(df: DataFrame, rules: Rules = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, kind, name, start_line, end_line, content): units of texts by their language's rules.

    A unit of a scanner is what its syntax spans. One of line rules covers the blank, indented and closing lines below its
    first, without trailing blank lines. What stands outside of units is left out. A row's text is read in one pass,
    whatever its id is.
    """
    compiled = _compiled(rules)
    own = df.where(F.col("language").isin(*rules) & F.col(text_col).isNotNull())
    return _expanded(own, [id_col, "language"], ["language", text_col], lambda language, text: compiled[language](text), UNIT)


def chunk_units(units: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, id_col: str = "doc_id") -> DataFrame:
    """Units as chunks; a unit of more than ``max_chars`` is split by its lines, with true line numbers."""
    keep = [id_col, "language", "kind", "name"]
    small = units.where(F.length("content") <= max_chars).select(*keep, F.lit(0).alias("chunk_no"), "start_line", "end_line", "content")
    large = chunk_lines(units.where(F.length("content") > max_chars), keep, "content", max_chars, overlap, "start_line")
    return small.unionByName(large)


def chunk_files(df: DataFrame, rules: Rules = RULES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Structural chunks where a text has units, else chunks of lines (kind ``text``): one pass for each text."""
    compiled = _compiled(rules)

    def rows_of(language: str, text: str) -> Iterator[tuple]:
        found = False
        for kind, name, first, last, content in compiled[language](text) if language in compiled else ():
            found = True
            chunks = [(0, first, last, content)] if len(content) <= max_chars else _line_chunks(content.split("\n"), first, max_chars, overlap)
            yield from ((kind, name, *c) for c in chunks)
        if not found:
            yield from (("text", None, *c) for c in _line_chunks(text.split("\n"), 1, max_chars, overlap))

    known = df.where(F.col(text_col).isNotNull()).withColumn("language", F.coalesce("language", F.lit("unknown")))
    return _expanded(known, [id_col, "language"], ["language", text_col], rows_of, {"kind": "string", "name": "string"} | CHUNK)


def decode_text(df: DataFrame, keep: list[str], content_col: str = "content", lines: bool = True) -> DataFrame:
    """Text of binary content: UTF-8 without its bad bytes; ``lines``: CR LF and CR become LF."""
    kept = df.select(*keep, content_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else x.decode("utf-8", "ignore") for x in b.column(len(keep)).to_pylist()]
            if lines:
                out = [x if x is None or "\r" not in x else x.replace("\r\n", "\n").replace("\r", "\n") for x in out]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(run, f"{fields}, text string")
