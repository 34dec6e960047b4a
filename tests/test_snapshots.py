"""Versions of an index table: what readers see after writes, failed writes, edits and drops."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.functions.embed import hashing_embedder
from quarry.operators import index, snapshots
from quarry.streaming.ingest import chunks_of, index_stream

CHUNK = "index_name string, chunk_id string, path string, chunk_no int, language string, content string"


def chunks(spark, rows):
    """(index, path, number, content)"""
    return index.stamped(spark.createDataFrame([(i, f"{i}/{p}/{n}", p, n, "python" if p.endswith("py") else None, c) for i, p, n, c in rows], CHUNK), "2024-01-01 00:00:00")


def stored(spark, root, name=None):
    return sorted((r.index_name, r.path, r.chunk_no, r.content) for r in index.open_index(spark, root, name).collect())


def build(new):
    return chunks_of(new, hashing_embedder(4))


def files(spark, rows):
    return spark.createDataFrame([(i, p, p.rpartition("/")[2], t) for i, p, t in rows], "index_name string, path string, name string, text string")


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    index.write_index(chunks(spark, [("a", "x.py", 0, "one")]), root)
    bad = chunks(spark, [("a", "x.py", 0, "two"), ("b", "y", 0, "three")]).withColumn("content", F.when(F.col("index_name") == "b", F.raise_error(F.lit("no content")).cast("string")).otherwise(F.col("content")))
    for mode in ("replace", "append_new"):
        with pytest.raises(Exception, match="no content"):
            index.write_index(bad, root, mode)
    assert stored(spark, root) == [("a", "x.py", 0, "one")] and snapshots.current(spark, root).number == 1
    with pytest.raises(Exception, match="no index_name"):
        index.write_index(chunks(spark, [("a", "x.py", 0, "z")]).withColumn("index_name", F.lit(None).cast("string")), root)


def test_of_two_writers_one_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    index.write_index(chunks(spark, [("a", "x.py", 0, "one")]), root)
    version = snapshots.current(spark, root)
    index.write_index(chunks(spark, [("b", "x.py", 0, "two")]), root)
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.publish(spark, root, snapshots.Version(version.number + 1, version.schema, version.entries))
    assert len(stored(spark, root)) == 2 and not [f for f in os.listdir(f"{root}/versions") if f.startswith(".") and not f.endswith(".crc")]


def test_edited_chunks_replace_what_was_there(spark, tmp_path):
    root = str(tmp_path / "t")
    index.write_index(chunks(spark, [("a b%", "x.py", 0, "one"), ("a b%", "x.py", 1, "two"), ("c", "x.py", 0, "c")]), root)
    index.write_index(chunks(spark, [("a b%", "x.py", 0, "new"), ("a b%", "x.py", 1, "two"), ("a b%", "z", 0, "added"), ("d", "z", 0, "d")]), root, "append_new")
    assert stored(spark, root) == [("a b%", "x.py", 0, "new"), ("a b%", "x.py", 1, "two"), ("a b%", "z", 0, "added"), ("c", "x.py", 0, "c"), ("d", "z", 0, "d")]
    assert stored(spark, root, "a b%") == stored(spark, root)[:3]
    assert {(r.index_name, r.chunks, r.files, r.languages) for r in index.counts(spark, root).collect()} == {("a b%", 3, 2, 2), ("c", 1, 1, 1), ("d", 1, 1, 1)}
    assert {tuple(r) for r in index.languages(spark, root).collect()} == {("python", 3), ("unknown", 2)}
    size = {r.index_name: r.storage_bytes for r in index.listing(spark, root).collect()}
    assert size == {"a b%": 3 + 3 + 5, "c": 1, "d": 1}
    index.compact(spark, root, "a b%")
    assert len(stored(spark, root)) == 5 and not any(e.dropped for e in snapshots.current(spark, root).entries)
    snapshots.vacuum(spark, root)
    assert len(stored(spark, root)) == 5 and len(os.listdir(f"{root}/versions")) <= 2


@pytest.mark.parametrize("positions", [0, 1_000_000])
def test_upsert_equals_a_fresh_build(spark, tmp_path, monkeypatch, positions):
    monkeypatch.setattr(snapshots, "BROADCAST_POSITIONS", positions)
    root, text = str(tmp_path / "t"), "line\n" * 300
    first = [("a", f"p{i}.py", f"{i} {text}") for i in range(12)] + [("b", "p0.py", "b"), ("b", "gone.md", "g"), ("b", "none.md", None)]
    counts = index.upsert(files(spark, first), root, build)
    assert counts == {"added_files": 14, "removed_files": 0, "kept_files": 0}
    assert index.upsert(files(spark, first), root, build) == {"added_files": 0, "removed_files": 0, "kept_files": 14}
    assert snapshots.current(spark, root).number == 1
    second = [("a", f"p{i}.py", f"{i} {'edited' * (i % 3 == 0)} {text}") for i in range(2, 14)] + [("b", "p0.py", "b"), ("b", "p0.py", "b"), ("b", "empty.md", ""), ("b", "none.md", None), ("c", "new", "x")]
    assert index.upsert(files(spark, second), root, build) == {"added_files": 14, "removed_files": 13, "kept_files": 1}
    fresh = str(tmp_path / "fresh")
    index.upsert(files(spark, second), fresh, build)
    assert stored(spark, root) == stored(spark, fresh)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(index.counts(spark, root).collect()) == key(index.counts(spark, fresh).collect())
    assert key(index.languages(spark, root).collect()) == key(index.languages(spark, fresh).collect())
    assert key(index.listing(spark, root).drop("created").collect()) == key(index.listing(spark, fresh).drop("created").collect())
    part = [("a", "p3.py", "other"), ("a", "p99.py", "new")]
    index.upsert(files(spark, part), root, build, complete=False)
    assert [r for r in stored(spark, root) if r[1] in ("p3.py", "p99.py")] == [("a", "p3.py", 0, "other"), ("a", "p99.py", 0, "new")]
    assert len({r[1] for r in stored(spark, root, "a")}) == 13
    assert index.upsert(files(spark, []), root, build) == {"added_files": 0, "removed_files": 0, "kept_files": 0}


def test_only_changed_files_are_built(spark, tmp_path):
    root = str(tmp_path / "t")
    index.upsert(files(spark, [("a", "x", "one"), ("a", "y", "two")]), root, build)

    def picky(new):
        assert sorted(r.path for r in new.collect()) == ["y"]
        return build(new)

    assert index.upsert(files(spark, [("a", "x", "one"), ("a", "y", "2")]), root, picky) == {"added_files": 1, "removed_files": 1, "kept_files": 1}
    assert index.upsert(files(spark, [("a", "x", "one")]), root, picky) == {"added_files": 0, "removed_files": 1, "kept_files": 1}
    assert [r[1] for r in stored(spark, root)] == ["x"]


def test_pages_cover_all_rows_and_read_few_files(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path / "t"), []
    rows = [("a", f"p{i:03}.py", n, f"{i}") for i in range(120) for n in range(3)]
    table = chunks(spark, rows)
    index.write_index(table.repartitionByRange(12, "path").sortWithinPartitions("path", "chunk_no"), root, unique=True)
    real = snapshots.rows
    monkeypatch.setattr(snapshots, "rows", lambda *a, **k: (seen.append(k.get("files")), real(*a, **k))[1])
    got, after = [], None
    while page := index.page(spark, root, 50, after).collect():
        assert len(page) == min(50, len(rows) - len(got))
        got += [(r.path, r.chunk_no) for r in page]
        after = got[-1]
    assert got == sorted((p, n) for _, p, n, _ in rows)
    assert all(len(f) <= 4 for f in seen if f is not None)
    index.write_index(chunks(spark, [("a", "p000.py", 0, "new"), ("a", "p119.py", 3, "more")]), root, "append_new")
    first = index.page(spark, root, 4).collect()
    assert [(r.path, r.chunk_no, r.content) for r in first] == [("p000.py", 0, "new"), ("p000.py", 1, "0"), ("p000.py", 2, "0"), ("p001.py", 0, "1")]
    last = index.page(spark, root, 9, ("p119.py", 1)).collect()
    assert [(r.path, r.chunk_no) for r in last] == [("p119.py", 2), ("p119.py", 3)]


def test_bad_tables_and_indexes_hide_no_others(spark, tmp_path):
    for name in ("good", "torn"):
        index.write_index(chunks(spark, [("a", "x", 0, "one"), ("b", "x", 0, "two")]), str(tmp_path / name))
    (tmp_path / "torn/versions/000000000002.json").write_text("{")
    (tmp_path / "other").mkdir()
    got = {r.table: (r.indexes, r.chunks, r.status.split(":")[0]) for r in index.list_tables(spark, str(tmp_path)).collect()}
    assert got == {"good": (2, 2, "ok"), "torn": (None, None, "unreadable"), "other": (None, None, "unreadable")}
    segment = snapshots.current(spark, str(tmp_path / "good")).entries[0].segment
    os.rename(tmp_path / f"good/data/seg={segment}/index_name=a", tmp_path / "moved")
    assert {(r.index_name, r.status) for r in index.listing(spark, str(tmp_path / "good")).collect()} == {("a", "unreadable"), ("b", "ok")}
    assert len(stored(spark, str(tmp_path / "good"), "b")) == 1
    with pytest.raises(ValueError, match="column chunk_no"):
        index.write_index(chunks(spark, [("b", "x", 0, "z")]).withColumn("chunk_no", F.lit("text")), str(tmp_path / "good"))


def test_columns_may_be_added(spark, tmp_path):
    root = str(tmp_path / "t")
    index.write_index(chunks(spark, [("a", "x", 0, "one")]), root)
    index.write_index(chunks(spark, [("b", "x", 0, "two")]).withColumn("author", F.lit("me")), root)
    assert {(r.index_name, r.author) for r in index.open_index(spark, root).collect()} == {("a", None), ("b", "me")}


def test_a_stream_replaces_changed_files(spark, tmp_path):
    source, root, schema = str(tmp_path / "in"), str(tmp_path / "t"), "path string, name string, text string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(schema).parquet(source), "live", hashing_embedder(8), root, str(tmp_path / "check")).awaitTermination()
        return stored(spark, root, "live")

    assert run([("a.py", "a.py", "one"), ("b.md", "b.md", "three")]) == [("live", "a.py", 0, "one"), ("live", "b.md", 0, "three")]
    assert run([("a.py", "a.py", "edited"), ("c.md", "c.md", "c")]) == [("live", "a.py", 0, "edited"), ("live", "b.md", 0, "three"), ("live", "c.md", 0, "c")]


def test_sketches_merge_without_a_rescan(spark, tmp_path):
    root = str(tmp_path / "t")
    first = chunks(spark, [("a", f"p{i}", 0, f"{i % 700}") for i in range(3000)] + [("b", "q", 0, "1")])
    index.write_index(first, root, sketched=("path", "content"))
    index.write_index(chunks(spark, [("a", f"r{i}", 0, f"{i % 900}") for i in range(1000)]), root, "append_new", sketched=("path", "content"))
    got = {(r.index_name, r.column): r.estimate for r in index.distinct_estimates(spark, root).collect()}
    assert got["b", "path"] == got["b", "content"] == 1
    assert abs(got["a", "path"] - 4000) < 160 and abs(got["a", "content"] - 900) < 36
    assert abs({r.column: r.estimate for r in index.distinct_estimates(spark, root, False).collect()}["path"] - 4001) < 160
    segments = {e.segment for e in snapshots.current(spark, root).entries}
    for s in segments:
        os.rename(f"{root}/data/seg={s}", f"{root}/data/moved-{s}")
    assert {(r.index_name, r.column): r.estimate for r in index.distinct_estimates(spark, root).collect()} == got  # no row was read
    index.drop_index(spark, root, "a", purge=False)
    assert {r.index_name for r in index.distinct_estimates(spark, root).collect()} == {"b"}
    plain = str(tmp_path / "plain")
    index.write_index(chunks(spark, [("a", "x", 0, "1")]), plain)
    assert index.distinct_estimates(spark, plain).count() == 0


def test_bitmaps_tell_the_rows_that_meet_a_filter(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path / "t"), []
    names = ["a", "b"]
    rows = [(names[i % 2], f"p{i:04}.{'py' if i % 5 == 0 else 'md'}", i % 3, f"{i}") for i in range(400)]
    table = chunks(spark, rows).withColumn("label", F.when(F.col("chunk_no") > 0, F.col("chunk_no")))
    dealt = table.repartitionByRange(8, "path").sortWithinPartitions("path")
    index.write_index(dealt, root, unique=True, posted=("language", "label"))
    real = snapshots.rows
    monkeypatch.setattr(snapshots, "rows", lambda *a, **k: (seen.append(k.get("files")), real(*a, **k))[1])
    trees = [
        {"language": "python"},
        {"language": {"ne": "python"}},
        {"label": {"gte": 1}},
        {"label": {"ne": 2}},
        {"and": [{"language": "python"}, {"label": {"in": [1, 2]}}]},
        {"or": [{"language": "python"}, {"and": [{"label": {"lt": 2}}, {"language": {"nin": ["sql"]}}]}]},
        {"language": "none"},
    ]
    for tree in trees:
        whole = index.open_index(spark, root)
        want = whole.where(index.condition(whole, tree)).count()
        found = index.matches(spark, root, tree)
        assert found.agg(F.sum(F.bitmap_count("bits"))).first()[0] == (want or None)
        assert index.open_index(spark, root, where=tree).count() == want
        assert index.open_index(spark, root, "a", tree).count() == whole.where("index_name = 'a'").where(index.condition(whole, tree)).count()
    mixed = {"and": [{"language": "python"}, {"path": {"lt": "p0050"}}]}
    assert index.open_index(spark, root, where=mixed).count() == 10
    assert index.matches(spark, root, {"or": [{"language": "python"}, {"path": "p0001.md"}]}) is None
    seen.clear()
    index.write_index(chunks(spark, [("a", f"q{i}.py", 0, "q") for i in range(5)]).withColumn("label", F.lit(9)), root, "append_new", posted=("language", "label"))
    assert index.open_index(spark, root, where={"label": 9}).count() == 5 and len(seen[-1]) <= 5
    index.write_index(chunks(spark, [("c", "x", 0, "1")]).withColumn("label", F.lit(9)), root)  # a segment without bitmaps: all files are read
    assert index.open_index(spark, root, where={"label": 9}).count() == 6
