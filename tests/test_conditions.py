"""Filter trees against plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.conditions import condition

ROWS = [(1, "python", 3.5, True, {"author": "me", "year": "2020"}), (2, None, None, None, None), (3, "sql", -1.0, False, {"author": "you", "year": "x"}), (4, "python", 7.0, True, {}), (5, "", 0.0, None, {"year": "2021", "author": None})]
PLAIN = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "n long, language string, score double, done boolean, metadata map<string, string>").cache()


def value_of(row, field, wanted):
    at = {"n": 0, "language": 1, "score": 2, "done": 3}
    v = row[at[field]] if field in at else (row[4] or {}).get(field)
    if v is not None and field not in at and isinstance(wanted, int | float):
        try:
            return float(v)
        except ValueError:
            return None
    return v


def holds(row, tree):
    out = True
    for key, value in tree.items():
        op = key.removeprefix("$")
        if op in ("and", "or"):
            out &= (all if op == "and" else any)(holds(row, t) for t in value)
            continue
        for name, wanted in value.items() if isinstance(value, dict) else [("eq", value)]:
            name = name.removeprefix("$")
            if name in ("in", "nin"):
                out &= any(value_of(row, key, w) == w for w in wanted) == (name == "in")
            elif name == "ne":
                out &= value_of(row, key, wanted) != wanted
            else:
                v = value_of(row, key, wanted)
                out &= v is not None and PLAIN[name](v, wanted)
    return out


FIELDS = {"n": st.integers(0, 6), "language": st.sampled_from(["python", "sql", "", "no"]), "score": st.sampled_from([-1.0, 0.0, 3.5, 7.0]), "author": st.sampled_from(["me", "you", "x"]), "year": st.integers(2019, 2022)}
OPS = ["eq", "ne", "gt", "$gte", "lt", "$lte"]


@st.composite
def leaves(draw):
    field = draw(st.sampled_from(sorted(FIELDS)))
    if draw(st.booleans()):
        return {field: {draw(st.sampled_from(["in", "$nin"])): draw(st.lists(FIELDS[field], max_size=3))}}
    if draw(st.booleans()):
        return {field: draw(FIELDS[field])}
    return {field: {op: draw(FIELDS[field]) for op in draw(st.lists(st.sampled_from(OPS), min_size=1, max_size=2, unique=True))}}


trees = st.recursive(leaves(), lambda x: st.builds(lambda op, own: {op: own}, st.sampled_from(["and", "$or"]), st.lists(x, min_size=1, max_size=3)), max_leaves=6)


@settings(max_examples=25, deadline=None)
@given(st.lists(trees, min_size=8, max_size=8))
def test_trees_hold_as_in_plain_python(table, some):
    got = table.select(*[F.coalesce(condition(table, t), F.lit(False)).alias(f"c{i}") for i, t in enumerate(some)], "n").orderBy("n").collect()
    for row, r in zip(ROWS, got):
        assert [r[f"c{i}"] for i in range(len(some))] == [holds(row, t) for t in some]


def test_types_and_empty_trees(table):
    ids = lambda tree: [r.n for r in table.where(condition(table, tree)).orderBy("n").collect()]
    assert ids({}) == [1, 2, 3, 4, 5]
    assert ids({"done": True}) == [1, 4] and ids({"done": {"ne": True}}) == [2, 3, 5]
    assert ids({"n": "3"}) == [3] and ids({"language": 5}) == []
    assert ids({"year": "2020"}) == [1] and ids({"year": {"gte": 2020}}) == [1, 5]
    assert ids({"and": [{"n": {"gt": 1}}, {"or": [{"language": "sql"}, {"author": "me"}]}]}) == [3]


@pytest.mark.parametrize(
    ("tree", "names"),
    [
        ({"n": {"$like": 3}}, "like"),
        ({"$not": [{"n": 1}]}, "not"),
        ({"$and": []}, "and"),
        ({"$or": {"n": 1}}, "or"),
        ({"n": {"$in": 3}}, "in"),
        ({"n": {"$gt": [3]}}, "gt"),
        ({"n": None}, "NoneType"),
        ({"metadata": "x"}, "metadata"),
        ([{"n": 1}], "list"),
    ],
)
def test_errors_name_what_is_wrong(table, tree, names):
    with pytest.raises(ValueError, match=names):
        condition(table, tree)


def test_unknown_fields(table):
    with pytest.raises(ValueError, match="no field 'what'"):
        condition(table.drop("metadata"), {"what": 1})
    assert table.where(condition(table, {"what": {"ne": 1}})).count() == 5


def test_conditions_on_columns_reach_the_scan(table, tmp_path, spark):
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = stored.where(condition(stored, {"and": [{"n": {"gt": 3}}, {"language": {"in": ["python"]}}]}))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,3)" in plan and "EqualTo(language,python)" in plan
    assert stored.where(condition(stored, {"n": {"gt": 3}})).agg(F.count("*")).first()[0] == 2
