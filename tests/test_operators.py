"""Edge cases with inline rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.embed import Embedder, embed, embedder, hashing_embedder, register_embedder
from quarry.functions.languages import language, suffix
from quarry.functions.patterns import glob_regex
from quarry.operators import chunking, filters, index, search, stats
from quarry.sources.tree import read_ignore_lines, read_tree


def paths(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "path string")
    return df.withColumns({"parts": F.split("path", "/"), "suffix": suffix(F.element_at(F.split("path", "/"), -1))})


def kept(df):
    return sorted(r[0] for r in df.select("path").collect())


def test_default_excludes_compare_literally(spark):
    df = paths(spark, [".env", "a/node_modules/x.js", "x.egg-info/a", "dist/a.py", "src/a.py"])
    assert kept(filters.default_excludes(df)) == ["src/a.py", "x.egg-info/a"]


def test_ignore_rules(spark):
    df = paths(spark, ["build/keep.py", "keep.log", "a/b.log", "src/x.py", "doc/a/b.txt", "top", "x/top"])
    out = filters.ignore_rules(df, ["build/", "!build/keep.py", "*.log", "!keep.log", "doc/**/b.txt", "/top"])
    assert kept(out) == ["keep.log", "src/x.py", "x/top"]
    assert filters.ignore_rules(df, []).count() == 7


@pytest.mark.parametrize(
    ("path", "pattern", "expected"),
    [
        ("/r/tests/x.py", "tests/*", True),
        ("/r/tests", "tests", True),
        ("/r/a/tests/sub/x.py", "**/x.py", True),
        ("/r/a/x.test.js", "*.test.js", True),
        ("/r/x.py", "/r/*", True),
        ("/r/ab.py", "a[bc].py", True),
        ("/r/a.py", "?.py", True),
        ("/r/tests/x.py", "tests", False),
        ("/r/a/tests/sub/x.py", "tests/*", False),
        ("/r/a/tests/sub/x.py", "tests/**", False),
        ("/r/x.PY", "*.py", False),
        ("/r/a/x.py", "/r/*", False),
    ],
)
def test_globs(spark, path, pattern, expected):
    assert spark.range(1).select(F.lit(path).rlike(glob_regex(pattern))).first()[0] is expected


def test_suffix_and_language(spark):
    names = {".gitignore": ("", None), "a.tar.gz": (".gz", None), "x.": ("", None), "B.PY": (".py", "python"), "m.rst": (".rst", "rst")}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r[0]: (r[1], r[2]) for r in df.select("name", suffix(F.col("name")), language(F.col("name"))).collect()} == names


def test_nul_probe(spark):
    rows = [("a", b"0123456789\x00"), ("b", b"x" * 1024 + b"\x00"), ("c", None), ("d", b"\x10\x01"), ("e", b"")]
    out = filters.nul_probe(spark.createDataFrame(rows, "path string, content binary"))
    assert kept(out) == ["b", "d", "e"]


def test_decode(spark):
    rows = [(1, bytes.fromhex("6F6BFFFE656E64")), (2, b"a\r\nb\rc"), (3, None)]
    out = chunking.decode_text(spark.createDataFrame(rows, "id int, content binary"), ["id"])
    assert {r.id: r.text for r in out.collect()} == {1: "okend", 2: "a\nb\nc", 3: None}


def test_line_ranges():
    assert chunking.line_ranges([0], 1000, 100) == [(1, 1)]
    assert chunking.line_ranges([5000], 1000, 100) == [(1, 1)]
    assert chunking.line_ranges([990, 20, 9], 1000, 100) == [(1, 2), (2, 3)]
    assert chunking.line_ranges([990, 20], 1000, 100) == [(1, 2), (2, 2)]
    assert chunking.line_ranges([5, 5], 10, 1000) == [(1, 2), (1, 2)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.integers(1, 80), st.integers(0, 60))
def test_line_ranges_cover_all_lines(lengths, size, overlap):
    out = chunking.line_ranges(lengths, size, overlap)
    assert {i for s, e in out for i in range(s, e + 1)} == set(range(1, len(lengths) + 1))
    for s, e in out:
        assert sum(lengths[s - 1 : e - 1]) + e - s < max(size, overlap + 2)


PYTHON = """import os
from x import y
def one(a):

    return a

loose = 1
@decorated
def two():
    pass

class Three:
    def method(self):
        pass
"""


def test_structural_units(spark):
    df = spark.createDataFrame([(1, "python", PYTHON), (2, "python", "x = 1\n"), (3, None, "def f():\n"), (4, "javascript", "export const a = 1\nclass B {\n  m() {}\n}\nconst f = x => x\n"), (5, "python", None)], "doc_id long, language string, text string")
    units = {(r.doc_id, r.kind, r.name, r.start_line, r.end_line) for r in chunking.structural_units(df).collect()}
    assert units == {
        (1, "import_statement", None, 1, 1),
        (1, "import_from_statement", None, 2, 2),
        (1, "function_definition", "one", 3, 5),
        (1, "decorated_definition", None, 8, 10),
        (1, "class_definition", "Three", 12, 14),
        (4, "export_statement", None, 1, 1),
        (4, "class_declaration", "B", 2, 4),
        (4, "arrow_function", None, 5, 5),
    }
    chunks = {(r.doc_id, r.kind) for r in chunking.chunk_files(df).collect()}
    assert {(2, "text"), (3, "text")} <= chunks and (1, "text") not in chunks


def test_units_of_rows_with_one_id_stay_apart(spark):
    rows = [(1, "python", "def a():\n    x = 1\n"), (1, "python", "def b():\n    y = 2\n"), (None, "python", "class C:\n    z = 3"), (None, "python", "loose = 1")]
    df = spark.createDataFrame(rows, "doc_id long, language string, text string")
    want = {(1, "def a():\n    x = 1"), (1, "def b():\n    y = 2"), (None, "class C:\n    z = 3")}
    assert {(r.doc_id, r.content) for r in chunking.structural_units(df).collect()} == want
    assert {(r.doc_id, r.content) for r in chunking.chunk_files(df).collect()} == want | {(None, "loose = 1")}


def test_long_texts_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chunking, "FLUSH_CHARS", 50)
    df = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(200))), (2, "short")], "doc_id long, text string")
    got = chunking.chunk_lines(df, ["doc_id"], max_chars=40, overlap=8).collect()
    assert [r.chunk_no for r in got if r.doc_id == 1] == list(range(len(got) - 1)) and got[-1].content == "short"


def test_limits(spark):
    checks = stats.limit_check(stats.corpus_stats(spark.createDataFrame([("a", 10), ("b", None)], "path string, size long"), 5), 1, 500)
    assert {r.check_name: r.severity for r in checks.collect()} == {"files": "error", "total_mb": "ok", "oversized": "warning"}
    with pytest.raises(ValueError, match="files"):
        stats.require_limits(checks)


def test_source_tree(spark, tmp_path):
    for name, text in {".gitignore": "ignored.py\n", "included.py": "#", "ignored.py": "#", "__init__.py": "", ".hid/z.py": "z", "_x/w.py": "w", "x.pyc": "b", "node_modules/a.js": "a", "t.txt": "t"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    df = read_tree(spark, str(tmp_path))
    found = filters.binary_suffixes(filters.ignore_rules(df, read_ignore_lines(spark, str(tmp_path))))
    assert sorted(r[0] for r in found.select("rel_path").collect()) == [".gitignore", ".hid/z.py", "__init__.py", "_x/w.py", "included.py", "t.txt"]
    only = filters.include_globs(found, ["*.py"])
    assert sorted(r[0] for r in only.select("rel_path").collect()) == [".hid/z.py", "__init__.py", "_x/w.py", "included.py"]
    assert df.where("rel_path = 'x.pyc'").first().content is None
    (tmp_path / "deep/er/still").mkdir(parents=True)
    (tmp_path / "deep/er/still/d.py").write_text("d")
    assert read_tree(spark, str(tmp_path), max_bytes=0).where("rel_path = 'deep/er/still/d.py' AND content IS NULL AND size = 1").count() == 1


def test_embedders(spark):
    with pytest.raises(ValueError, match="hash64"):
        embedder("none")
    with pytest.raises(TypeError):
        register_embedder("bad", None, 3)

    def make():
        def run(texts):
            raise RuntimeError

        return run

    df = spark.createDataFrame([("a",), (None,)], "content string")
    rows = embed(df, Embedder("fails", make, 3)).collect()
    assert all(r.embedding == [0, 0, 0] and not r.embed_ok for r in rows)
    assert embed(df, hashing_embedder(8)).where("embed_ok").count() == 2


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z")], "index_name string, chunk_id string, content string")
    root = str(tmp_path / "index")
    with pytest.raises(ValueError, match="no index table"):
        index.open_index(spark, root)
    index.write_index(chunks, root)
    index.write_index(chunks, root, "append_new")
    assert index.open_index(spark, root).count() == 3
    index.write_index(chunks.where("index_name = 'a' AND chunk_id = '1'"), root)
    assert index.open_index(spark, root, "a").count() == 1 and index.open_index(spark, root, "b").count() == 1
    with pytest.raises(ValueError, match="no index 'c'"):
        index.open_index(spark, root, "c")


def test_drop_and_ledger(spark, tmp_path):
    chunks = spark.createDataFrame([("a b", "1", "x"), ("a b", "2", "y"), ("c", "1", "z")], "index_name string, chunk_id string, content string")
    root, ledger = str(tmp_path / "index"), str(tmp_path / "runs")
    index.index_run(index.stamped(chunks.where("index_name = 'a b'")), root, ledger, 2, 0.5)
    index.index_run(index.stamped(chunks.where("index_name = 'c'")), root, ledger, 1)
    with pytest.raises(Exception, match="nothing to add"):
        index.index_run(index.stamped(chunks.where("index_name = 'c'").withColumn("content", F.raise_error(F.lit("nothing to add")).cast("string"))), root, ledger)
    runs = spark.read.schema(index.LEDGER).parquet(ledger)
    assert {r.index_name: (r.status, r.files_count, r.chunks_count) for r in index.latest_runs(runs).collect()} == {"a b": ("completed", 2, 2), "c": ("failed", None, None)}
    assert runs.where("status = 'indexing'").count() == 3
    assert {r.index_name: (r.chunks, r.storage_bytes) for r in index.list_indexes(index.open_index(spark, root)).collect()} == {"a b": (2, 2), "c": (1, 1)}
    assert {r.index_name: (r.chunks, r.storage_bytes, r.status) for r in index.listing(spark, root).collect()} == {"a b": (2, 2, "ok"), "c": (1, 1, "ok")}
    index.drop_index(spark, root, "a b")
    assert [r.index_name for r in index.open_index(spark, root).collect()] == ["c"]
    with pytest.raises(ValueError, match="no index 'a b'"):
        index.drop_index(spark, root, "a b")


def test_attached_vectors_are_complete(spark):
    chunks = spark.createDataFrame([("1",), ("2",)], "chunk_id string")
    vectors = spark.createDataFrame([("1", [1.0]), ("2", None)], "chunk_id string, embedding array<double>")
    with pytest.raises(Exception, match="no vector for 2"):
        index.attach_vectors(chunks, vectors).collect()
    assert index.attach_vectors(chunks, vectors, missing="drop").count() == 1


def test_oversized_report(spark):
    df = spark.createDataFrame([(f"p{i}", i) for i in range(10)], "path string, size long")
    assert [tuple(r) for r in stats.oversized_report(df, 2).orderBy("rank").collect()] == [(1, "p9", 9), (2, "p8", 8), (3, "p7", 7), (4, "p6", 6), (5, "p5", 5), (6, "... and 2 more", None)]
    assert stats.oversized_report(df, 7).count() == 2 and stats.oversized_report(df, 99).count() == 0


def test_search_edges(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_DISTANCES", 3)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0], 0), (8, [0.0, 1.0], 99)], "query_id long, embedding array<float>, k int")
    got = {(r.query_id, r.rank, r.id, r.distance) for r in search.nearest(vectors, queries, "k").collect()}
    assert got == {(7, 1, 1, 0.0), (8, 1, 3, 0.0), (8, 2, 1, 2.0), (8, 3, 2, 2.0)}
    assert search.nearest(vectors, queries.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="metric"):
        search.nearest(vectors, queries, 3, "other")
    assert spark.range(1).select(search.similarity(F.lit(1.5)), search.similarity(F.lit(0.2))).first()[:] == (0.0, 0.8)


def test_index_stream(spark, tmp_path):
    from quarry.streaming.ingest import index_stream

    source, root = str(tmp_path / "in"), str(tmp_path / "index")
    rows = [("a.py", "a.py", "one\ntwo"), ("b.md", "b.md", "three")]
    spark.createDataFrame(rows, "path string, name string, text string").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("path string, name string, text string").parquet(source)
        index_stream(stream, "live", hashing_embedder(8), root, str(tmp_path / "check")).awaitTermination()
    assert index.open_index(spark, root, "live").count() == 2
