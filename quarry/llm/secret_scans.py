"""Secret scans: assignment-aware lexing.

Texts are lexed for name-literal pairs (``name = "literal"``, ``"name": 'literal'``, ``name: literal``,
``name := literal``, ``name => literal``); a name that stands for an earlier constant of the same text
passes that constant on; each literal that reaches a sensitive target name gets the product of the name's
sensitivity and the literal's strength as its score. Three fixed patterns (assign, access, hex) are the base
and always stay; the lexer adds ``name`` spans where no single base span holds the whole literal, so spans may
overlap; masking takes overlapping ones as one. A name may have any length and any number of blanks after it;
a quoted literal may hold blanks.

Spans are code points, end exclusive. Null or empty text: no spans. Repeated rows are scanned each on their
own; extra columns are ignored (masking keeps them); an empty table gives an empty result; work and memory follow the
length of one text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import tidy

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "name")

# How sensitive a part of a name is.
SENSITIVITY = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "creds": 0.9, "bearer": 0.8, "auth": 0.7,
    "key": 0.6, "privatekey": 1.0, "signature": 0.5, "salt": 0.5, "pin": 0.4,
}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|0+|<.*|\$\{.*|\{\{.*|your.*|example.*|change.?me.*|none|null|true|false|todo.*)$", re.I | re.A)
_SEPARATOR = re.compile(r":=|=>|==|!=|<=|>=|[:=]")
_NAME_BACKWARDS = re.compile(r"""\n?[ \t]*["']?([A-Za-z0-9_.$-]*[A-Za-z_$])""", re.A)
_VALUE = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9_+/.=~$-]+))""", re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A)
_REFERENCE = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*$", re.A)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    return max((SENSITIVITY.get(p, 0.0) for p in parts + joined), default=0.0)


def strength(literal: str) -> float:
    """0 to 1: bits of entropy of the literal's characters, against those of a strong key."""
    n = len(literal)
    if n < LEAST_ASSIGNED or PLACEHOLDER.match(literal):
        return 0.0
    bits = sum(-c * math.log2(c / n) for c in Counter(literal).values())
    mixed = 1.0 if re.search(r"\d", literal) else 0.6
    return min(1.0, bits / 36) * mixed


def lexed_pairs(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, quoted) of each assignment, in order."""
    if "=" not in text and ":" not in text:
        return
    after = 0
    for sep in _SEPARATOR.finditer(text):
        before, after = text[after : sep.start()], sep.end()  # no name holds a separator, so all pieces are one text's length
        if sep[0] in ("==", "!=", "<=", ">="):
            continue
        name = _NAME_BACKWARDS.match(before[::-1])
        if name is None or (value := _VALUE.match(text, sep.end())) is None:
            continue
        k = value.lastindex
        yield name[1][::-1], value[k], value.start(k), value.end(k), k != 3


def scored_literals(text: str) -> dict[tuple[int, int], float]:
    """Best score of each literal (by its span) over the target names that it reaches."""
    known: dict[str, tuple[str, int, int]] = {}
    scores: dict[tuple[int, int], float] = {}
    for name, literal, start, end, quoted in lexed_pairs(text):
        if not quoted and _REFERENCE.match(literal) and literal in known:
            literal, start, end = known[literal]
        known[name] = (literal, start, end)
        score = sensitivity(name) * strength(literal)
        if score > scores.get((start, end), 0.0):
            scores[start, end] = score
    return scores


def scan(text: str | None, threshold: float = 0.5) -> list[Span]:
    """All spans by start, then kind: the base, and literals of at least ``threshold`` that none of it holds whole."""
    if not text:
        return []
    base = base_spans(text)
    starts, upto = [], []  # of the base by start, and the farthest end so far
    for a, b, _ in sorted(base):
        starts.append(a)
        upto.append(max(b, upto[-1]) if upto else b)
    inside = lambda s, e: (k := bisect_right(starts, s)) > 0 and upto[k - 1] >= e
    added = [(s, e, "name") for (s, e), score in scored_literals(text).items() if score >= threshold and not inside(s, e)]
    return sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))


def masked(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by ``mask``."""
    if not (found := scan(text)):
        return text
    out, at = [], 0
    for s, e, _ in found:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digest(found: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in found)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base spans, a digest of them, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                found = scan(text.as_py())
                base = [x for x in found if x[2] != "name"]
                n = Counter(x[2] for x in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(digest(base).encode()).hexdigest(), digest(found)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def mask_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with secrets masked in its text and, if it has such a column of whole numbers, ``n_chars`` counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text_col)
            texts = [masked(t.as_py()) for t in b.column(i)]
            b = b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))
            if (j := b.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(b.schema.field(j).type):
                b = b.set_column(j, b.schema.field(j), pa.array([None if t is None else len(t) for t in texts], b.schema.field(j).type))
            yield b
        tidy()

    return df.mapInArrow(run, df.schema)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
