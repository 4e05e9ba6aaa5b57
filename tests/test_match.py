import json
import random
import warnings

import pytest
from pyspark.sql import functions as F

from lumenq.collection import Collection
from lumenq.errors import QueryError
from lumenq.functions.fields import VariantResolver
from lumenq.operators.match import suggestion
from tests.evaluator import matches

#: A field f that is missing, null, or of every kind; the last items are no objects or nest it.
MIXED = [
    {"id": 0}, {"id": 1, "f": None}, {"id": 2, "f": True}, {"id": 3, "f": 30}, {"id": 4, "f": 30.0}, {"id": 5, "f": "30"}, {"id": 6, "f": ""}, {"id": 7, "f": []},
    {"id": 8, "f": {}}, {"id": 9, "f": [1, "a"]}, {"id": 10, "f": {"g": None}}, {"id": 11, "f": 18446744073709551615}, {"id": 12, "f": -7.5}, {"id": 13, "f": "New York"},
    {"id": 14, "f": {"g": {"h": [10, {"i": "deep"}]}}}, {"id": 15, "f": False}, 42, "text", None, [1, 2], {"id": 16, "f": "naïve straße"}, {"id": 17, "f": [1.0, "a"]}, {"id": 18, "0": "zero"},
]

VALUES = [None, True, 30, 30.0, "30", "", "New", [1, "a"], {"g": None}, 0, -100, 1e3, 18446744073709551615]
CONDITIONS = (
    [{"f": v} for v in VALUES if not isinstance(v, dict)]
    + [{"f": {op: v}} for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte") for v in VALUES]
    + [{"f": {op: v}} for op in ("$in", "$nin") for v in ([], [None], [30], [30.0, "30"], ["30", "New York", None], [True, [1, "a"]], 30, "x", None)]
    + [{"f": {"$exists": v}} for v in (True, False, 1, None)]
    + [{"f": {op: v}} for op in ("$contains", "$startsWith", "$endsWith", "$regex") for v in ("", "New", "York", "30", 5, None)]
    + [{"f": {"$regex": p}} for p in ("^N.w", "(", "[0-9]+$", "(?P<a>N)ew", "ß", r"^\w+ \w+$")]
    + [{}, {"f": {}}, [], "x", None, 5, {"$or": []}, {"$and": []}, {"$nor": []}, {"$or": {"f": 30}}, {"$not": 5}, {"$not": {"f": 30}}, {"$xyz": []}, {"f": {"$not": {"$gt": 3}}}]
    + [{"$or": [{"f": 30}, {"f": {"$gt": 29}}]}, {"$nor": [{"f": {"$lt": 100}}, {"f": "30"}]}, {"$and": [{"f": {"$exists": True}}, {"id": {"$gte": 5}}]}, {"f": {"$gte": 30, "$lte": 30}}]
    + [{"f.g": None}, {"f.g.h.1.i": "deep"}, {"f.0": 1}, {"f.g.h.0": {"$gt": 9}}, {"0": "zero"}, {"f.5": {"$exists": False}}]
)


@pytest.fixture(scope="module")
def mixed(spark):
    return Collection.of_values(spark, MIXED).on(Collection.of_values(spark, MIXED).df.cache())


def hits(collection, conditions):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        columns = [collection.condition(c).alias(f"c{k}") for k, c in enumerate(conditions)]
        row = collection.df.select("_pos", *columns).orderBy("_pos").collect()
    return [[bool(r[f"c{k}"]) if r[f"c{k}"] is not None else None for r in row] for k in range(len(conditions))]


def test_every_operator_on_every_kind(mixed):
    for a in range(0, len(CONDITIONS), 40):
        part = CONDITIONS[a : a + 40]
        for condition, got in zip(part, hits(mixed, part)):
            assert got == [matches(x, condition) for x in MIXED], json.dumps(condition)


def test_random_condition_trees(mixed):
    r = random.Random(11)

    def tree(depth):
        if depth == 0 or r.random() < 0.4:
            c = r.choice([c for c in CONDITIONS if isinstance(c, dict)])
            return c
        return {r.choice(["$or", "$and", "$nor"]): [tree(depth - 1) for _ in range(r.randint(0, 3))]} if r.random() < 0.7 else {"$not": tree(depth - 1)}

    trees = [tree(3) for _ in range(30)]
    for condition, got in zip(trees, hits(mixed, trees)):
        assert got == [matches(x, condition) for x in MIXED], json.dumps(condition)


def test_find_returns_items_in_order(mixed):
    assert mixed.values(mixed.find({"f": {"$gt": 0}})) == [x for x in MIXED if matches(x, {"f": {"$gt": 0}})]
    assert mixed.values(mixed.find_one({"f": {"$contains": "New"}})) == [MIXED[13]]
    assert mixed.find([]).count() == 0
    assert mixed.find({}).count() == len(MIXED)


def test_typed_condition_and_its_negation_split_the_table(spark):
    df = spark.range(30).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("n"), "id")).alias("s"))
    c = Collection.of_table(df, "id")
    for condition in ({"v": {"$gt": 10}}, {"v": {"$lt": 10}}, {"v": None}, {"s": {"$contains": "1"}}, {"v": {"$in": [1, 2, None]}}, {"s": {"$regex": "^n1"}}, {"nowhere": 3}, {"v": "x"}, {"v": {"$ne": 4}}):
        yes, no = c.find(condition).count(), c.find({"$not": condition}).count()
        assert yes + no == 30, condition
    assert c.find({"v": {"$lt": 10}}).count() == 10 + 6
    assert c.find({"v": {"$exists": False}}).count() == 10
    assert c.find({"nowhere": {"$exists": False}}).count() == 30


def test_range_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    c = Collection.of_table(spark.read.parquet(str(tmp_path / "t")), "id")
    plan = c.find({"id": {"$gt": 90, "$lte": 95}})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(id,90)" in plan and "LessThanOrEqual(id,95)" in plan
    assert "Python" not in plan


def test_unknown_operators(spark):
    c = Collection.of_values(spark, [{"a": 1}])
    with pytest.warns(UserWarning, match=r"did you mean '\$gt'"):
        assert c.find({"a": {"$gtt": 0}}).count() == 0
    with pytest.raises(QueryError):
        Collection.of_values(spark, [{"a": 1}], strict=True).find({"a": {"$gtt": 0}})
    assert suggestion("contins", ("contains", "in")) == "contains" and suggestion("zzzzz", ("contains",)) is None


def test_order_by_text_only_where_asked_for(spark):
    rows = [{"d": "2024-01-01"}, {"d": "2025-01-01"}, {"d": 5}]
    with pytest.warns(UserWarning):
        assert Collection.of_values(spark, rows).find({"d": {"$gt": "2024-06-01"}}).count() == 1  # the number
    assert Collection.of_values(spark, rows, lexicographic=True).find({"d": {"$gt": "2024-06-01"}}).count() == 1


def test_second_tier_operators(spark):
    rows = [{"t": [1, 2, 3]}, {"t": [1, "a"]}, {"t": "x"}, {}, {"t": [{"n": 1, "m": "q"}, {"n": 9}]}, {"t": None}]
    c = Collection.of_values(spark, rows)
    at = lambda cond: [r["_pos"] for r in c.find(cond).collect()]
    assert at({"t": {"$size": 3}}) == [0]
    assert at({"t": {"$all": [1, "a"]}}) == [1]
    assert at({"t": {"$elemMatch": {"$gt": 2}}}) == [0]
    assert at({"t": {"$elemMatch": {"n": {"$gte": 1}, "m": "q"}}}) == [4]
    assert at({"t": {"$type": "string"}}) == [2]
    assert at({"t": {"$type": "array"}}) == [0, 1, 4]
    assert at({"t": {"$type": "null"}}) == [5]


def test_large_texts_are_not_searched_by_regex(spark):
    c = Collection.of_values(spark, [{"s": "a" * 102400}, {"s": "a" * 102401}])
    assert [r["_pos"] for r in c.find({"s": {"$regex": "a$"}}).collect()] == [0]


def test_resolver_keeps_quoted_keys_apart(spark):
    rows = [{"a b": 1, 'q"t': 2, "it's": 3, "x": {"y z": 4}}]
    c = Collection.of_values(spark, rows)
    assert isinstance(c.resolver, VariantResolver)
    for condition in ({"a b": 1}, {'q"t': 2}, {"it's": 3}, {"x.y z": 4}):
        assert c.find(condition).count() == 1, condition
