"""The source tree's reader: which folders it enters, which files it lists and opens."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.functions.patterns import ignore_rule
from quarry.operators import filters
from quarry.sources import tree

FILES = {"a/x.py": 10, "a/y.md": 5, "a/deep/z.PY": 300, "b/x.py": 2000, "b/.hid/w.py": 1, "ab/x.py": 7, "b/img.png": 9, "top.txt": 0}


@pytest.fixture
def root(tmp_path):
    for name, size in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    return str(tmp_path)


CASES = {
    "suffix": (lambda: F.col("suffix") == ".py", lambda p, n: p.lower().endswith(".py")),
    "suffixes": (lambda: F.col("suffix").isin(".md", ".txt"), lambda p, n: p.endswith((".md", ".txt"))),
    "not": (lambda: ~F.col("suffix").isin(".py", ".png"), lambda p, n: not p.lower().endswith((".py", ".png"))),
    "size": (lambda: (F.col("size") > 5) & (F.col("size") <= 300), lambda p, n: 5 < n <= 300),
    "prefix": (lambda: F.col("rel_path").startswith("a/"), lambda p, n: p.startswith("a/")),
    "deep": (lambda: F.col("rel_path").startswith("b/.hid/") & (F.col("size") < 100), lambda p, n: p.startswith("b/.hid/")),
    "name": (lambda: F.col("name").contains("x") & F.col("name").endswith(".py") & (F.col("name") != "y"), lambda p, n: p.endswith("x.py")),
    "one": (lambda: F.col("rel_path") == "ab/x.py", lambda p, n: p == "ab/x.py"),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_filters_are_the_readers(spark, root, case):
    where, plain = CASES[case]
    listed = tree.list_tree(spark, root).where(where())
    assert sorted(r.rel_path for r in listed.collect()) == sorted(p for p, n in FILES.items() if plain(p, n))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_other_filters_stay_with_spark(spark, root):
    listed = tree.list_tree(spark, root).where((F.length("name") == 4) & (F.col("suffix") == ".py"))
    assert sorted(r.rel_path for r in listed.collect()) == ["a/deep/z.PY", "a/x.py", "ab/x.py", "b/.hid/w.py", "b/x.py"]
    assert listed.where((F.col("suffix") == ".md") | (F.col("size") == 10)).count() == 1


def test_folders_without_wanted_paths_are_not_entered(root, monkeypatch):
    reader = tree._Reader({"path": root})
    assert list(reader.pushFilters([tree.ds.StringStartsWith(("rel_path",), "a/")])) == []
    entered, scan, walk = [], os.scandir, os.walk
    monkeypatch.setattr(os, "scandir", lambda p: (entered.append(os.path.relpath(p, root)), scan(p))[1])
    rows = [r[1] for p in reader.partitions() for r in reader.read(p)]
    assert sorted(rows) == ["a/deep/z.PY", "a/x.py", "a/y.md"]
    assert set(entered) == {".", "a", "a/deep"} and walk is os.walk


def test_only_listed_files_are_opened(spark, root):
    os.chmod(f"{root}/b/x.py", 0o000)
    got = {r.rel_path: (None if r.content is None else len(r.content)) for r in tree.read_tree(spark, root, where=(F.col("suffix") == ".py") & (F.col("size") < 1000)).collect()}
    assert got == {"a/x.py": 10, "a/deep/z.PY": 300, "b/.hid/w.py": 1, "ab/x.py": 7}
    everything = {r.rel_path: r.content is None for r in tree.read_tree(spark, root).collect()}
    assert set(everything) == set(FILES) and everything["b/img.png"]


def test_an_unreadable_ignore_file_gives_no_rules(spark, tmp_path):
    assert tree.read_ignore_lines(spark, str(tmp_path)) == []
    (tmp_path / ".gitignore").mkdir()
    assert tree.read_ignore_lines(spark, str(tmp_path)) == []


@pytest.mark.parametrize(
    ("line", "path", "hit"),
    [
        (r"\*.py", "*.py", True),
        (r"\*.py", "a.py", False),
        ("name\\ ", "name ", True),
        ("name\\ ", "name", False),
        ("name  ", "name", True),
        (r"\#x", "#x", True),
        (r"\!x", "!x", True),
        (r"a\\b", "a\\b", True),
        (r"a\[b", "a[b", True),
        ("x.py\r\n", "x.py", True),
    ],
)
def test_escapes_in_ignore_rules(spark, line, path, hit):
    rule = ignore_rule(line)
    assert spark.range(1).select(F.lit(path).rlike(rule.regex)).first()[0] is hit
    df = spark.createDataFrame([(path,)], "path string").withColumn("parts", F.split("path", "/"))
    assert filters.ignore_rules(df, [line]).count() == (0 if hit else 1)


def test_a_task_holds_few_contents():
    from quarry.sources import tree

    assert 8 * tree.FLUSH_BYTES <= 16 << 20  # a batch, its copies and those of its neighbours in the executor
