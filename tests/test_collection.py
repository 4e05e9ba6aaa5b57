import json

import pytest
from pyspark.sql import functions as F

from lumenq.collection import Collection, python_value
from lumenq.errors import PointerError, QueryError, SecurityError, UnsupportedSql
from lumenq.functions import paths, values
from lumenq.operators import items, jsonpath
from lumenq.plans import sqlfront
from lumenq.sources import documents
from lumenq.streaming import pointer

USERS = [
    {"name": "Alice", "age": 30, "city": "NYC", "role": "admin", "score": 95},
    {"name": "Bob", "age": 25, "city": "LA", "role": "user", "score": 82},
    {"name": "Charlie", "age": 35, "city": "NYC", "role": "admin", "score": 88},
    {"name": "Diana", "age": 28, "city": "Chicago", "role": "user", "score": 91},
    {"name": "Eve", "age": 22, "city": "LA", "role": "viewer", "score": 76},
]


@pytest.fixture(scope="module")
def users(spark):
    return Collection.of_values(spark, USERS)


@pytest.fixture(scope="module")
def table(spark):
    return Collection.of_table(spark.createDataFrame([{"id": i, **u} for i, u in enumerate(USERS)]), "id")


def names(collection, df):
    return [x["name"] for x in collection.values(df)]


# ---- front ends agree --------------------------------------------------------------------------------------------

SAME = [
    ({"role": "admin"}, [{"field": "role", "value": "admin"}], "role = 'admin'"),
    ({"age": {"$gte": 25, "$lt": 31}}, [{"field": "age", "op": ">=", "value": 25}, {"field": "age", "op": "<", "value": 31}], "age >= 25 AND age < 31"),
    ({"city": {"$in": ["LA", "Chicago"]}}, [{"field": "city", "op": "in", "value": ["LA", "Chicago"]}], "city IN ('LA', \"Chicago\")"),
    ({"name": {"$contains": "li"}}, [{"field": "name", "op": "contains", "value": "li"}], "name LIKE '%li%'"),
    ({"name": {"$ne": "Bob"}, "score": {"$gt": 80}}, [{"field": "name", "op": "ne", "value": "Bob"}, {"field": "score", "op": "gt", "value": 80}], "name != 'Bob' AND score > 80"),
]


@pytest.mark.parametrize("match,where,sql", SAME)
def test_front_ends_agree(users, table, match, where, sql):
    wanted = names(users, users.find(match))
    assert wanted
    assert names(users, users.query({"where": where})) == wanted
    assert names(users, users.sql(f"SELECT * FROM users WHERE {sql}")) == wanted
    assert names(users, users.stream(match)) == wanted
    assert users.stream_count(match).first()[0] == len(wanted)
    assert sorted(r["name"] for r in table.find(match).collect()) == sorted(wanted)
    assert sorted(r["name"] for r in table.sql(f"SELECT * FROM users WHERE {sql}").collect()) == sorted(wanted)


# ---- query specifications ----------------------------------------------------------------------------------------


def test_clauses_apply_in_order(users, table):
    spec = {"where": [{"field": "score", "op": ">", "value": 80}], "order_by": {"field": "score", "desc": True}, "skip": 1, "limit": 2, "select": ["name", "score"]}
    assert users.values(users.query(spec), spec["select"]) == [{"name": "Diana", "score": 91}, {"name": "Charlie", "score": 88}]
    assert [tuple(r) for r in table.query(spec).collect()] == [("Diana", 91), ("Charlie", 88)]


def test_top_k_is_one_operator(table):
    plan = table.query({"order_by": {"field": "score"}, "limit": 2})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_single_field_gives_scalars(spark):
    c = Collection.of_values(spark, [{"a": 1, "b": {"c": "x"}}, {"b": None}, {}])
    assert c.values(c.query({"select": ["a"]}), ["a"]) == [1, None, None]
    assert c.values(c.query({"select": ["a", "b.c"]}), ["a", "b.c"]) == [{"a": 1, "b.c": "x"}, {}, {}]
    assert c.values(c.query({"select": ["a", "b"]}), ["a", "b"])[1] == {"b": None}


def test_except(users, table):
    assert users.values(users.query({"except": ["age", "score", "city", "role"]})) == [{"name": u["name"]} for u in USERS]
    assert table.query({"except": ["age"]}).columns == [c for c in table.df.columns if c != "age"]
    assert users.query({"select": ["name"], "except": ["name"]}).columns == ["name"]


def test_sort_is_stable_and_odd_values_come_last(spark):
    rows = [{"i": 0, "k": 2}, {"i": 1}, {"i": 2, "k": 1}, {"i": 3, "k": 2}, {"i": 4, "k": None}, {"i": 5, "k": 1}]
    c = Collection.of_values(spark, rows)
    order = lambda spec: [x["i"] for x in c.values(c.query(spec))]
    assert order({"order_by": {"field": "k"}}) == [2, 5, 0, 3, 1, 4]
    assert order({"sort": {"field": "k", "direction": "desc"}}) == [0, 3, 2, 5, 1, 4]


@pytest.mark.parametrize("skip,limit,wanted", [(0, None, 5), (2.9, None, 3), (-4, 2, 2), (99, None, 0), (0, "x", 5), (0, 0, 0)])
def test_paging_bounds(users, skip, limit, wanted):
    spec = {"skip": skip} | ({} if limit is None else {"limit": limit})
    assert users.query(spec).count() == wanted


def test_between_counts_what_is_missing_as_zero(spark):
    c = Collection.of_values(spark, [{"v": 5}, {"v": "x"}, {}, {"v": 50}])
    at = lambda value: [r["_pos"] for r in c.query({"where": [{"field": "v", "op": "between", "value": value}]}).collect()]
    assert at([0, 10]) == [0, 1, 2] and at([1, 10]) == [0] and at(["a", 10]) == [0, 1, 2] and at([1]) == [] and at(5) == []


def test_default_condition_looks_at_the_whole_item(spark):
    c = Collection.of_values(spark, [1, None, "a", {"x": 1}])
    assert c.values(c.query({"where": [{"op": "=", "value": 1}]})) == [1]
    assert c.values(c.query({"where": [{}]})) == [None]


def test_or_where_and_synonyms(users):
    spec = {"where": [{"field": "age", "op": "==", "value": 30}], "orWhere": [{"field": "city", "op": "starts_with", "value": "Ch"}]}
    assert names(users, users.query(spec)) == ["Alice", "Diana"]
    assert names(users, users.query({"where": [{"field": "city", "op": "not in", "value": ["NYC", "LA"]}]})) == ["Diana"]
    assert names(users, users.query({"where": [{"field": "city", "op": "<>", "value": "NYC"}]})) == ["Bob", "Diana", "Eve"]


# ---- SQL ---------------------------------------------------------------------------------------------------------


def test_sql_reader():
    s = sqlfront.parse("select a.b, c from data.users LIMIT 5 where a.b >= -2.5 AND c = 'x AND y' AND d = New York AND e = true order by c desc, a offset 2;")
    assert (s.fields, s.collection, s.order, s.limit, s.offset) == (["a.b", "c"], "data.users", ("c", True), 5, 2)
    assert [(c["field"], c["op"], c["value"]) for c in s.where] == [("a.b", ">=", -2.5), ("c", "=", "x AND y"), ("d", "=", "New York"), ("e", "=", True)]
    assert sqlfront.parse("SELECT * FROM c WHERE a = 1 AND a = 2").spec(last_wins=True)["where"] == [{"field": "a", "op": "=", "value": 2}]
    assert sqlfront.parse("SELECT * FROM").collection == ""
    like = lambda p: tuple(sqlfront.parse(f"SELECT * FROM c WHERE a LIKE '{p}'").where[0].values())[1:]
    assert [like("%x%"), like("%x"), like("x%"), like("x"), like("a%b_%")] == [("contains", "x"), ("endsWith", "x"), ("startsWith", "x"), ("=", "x"), ("startsWith", "a%b_")]
    u = sqlfront.parse("UPDATE c SET a = 'x, y', p.q = 2 WHERE b IN (1, 'two', null)")
    assert u.changes == {"a": "x, y", "p.q": 2} and u.where[0]["value"] == [1, "two", None]


@pytest.mark.parametrize(
    "text,error",
    [
        ("SELECT a", QueryError), ("DROP TABLE c", UnsupportedSql), ("SELECT * FROM c WHERE a = 1 OR b = 2", UnsupportedSql), ("SELECT * FROM c WHERE NOT a = 1", UnsupportedSql),
        ("SELECT COUNT(*) FROM c", UnsupportedSql), ("SELECT DISTINCT a FROM c", UnsupportedSql), ("SELECT * FROM c WHERE a", QueryError), ("SELECT * FROM c LIMIT x", QueryError),
        ("INSERT INTO c (a, b) VALUES (1)", QueryError), ("INSERT c (a) VALUES (1)", QueryError), ("SELECT * FROM c WHERE a IN 1", QueryError), ("SELECT * FROM c WHERE a BETWEEN 1 AND 2", UnsupportedSql),
        ("SELECT * FROM c WHERE a = 'open", QueryError), ("SELECT * FROM c WHERE a IS NULL", UnsupportedSql),
    ],
)
def test_sql_errors(text, error):
    with pytest.raises(error):
        sqlfront.parse(text)


def test_sql_changes_on_a_table(table):
    assert table.sql("INSERT INTO users (id, name) VALUES (9, 'Zoe')").where("id = 9").first()["age"] is None
    assert table.sql("UPDATE users SET role = 'x' WHERE city = 'NYC'").where("role = 'x'").count() == 2
    assert table.sql("DELETE FROM users WHERE age < 30").count() == 2
    assert table.sql("DELETE FROM users").count() == 0


def test_nested_update(spark):
    c = Collection.of_table(spark.createDataFrame([(1, ("new",)), (2, ("old",))], "id long, profile struct<status string>"), "id")
    out = c.sql("UPDATE t SET profile.status = 'seen', extra = 5 WHERE id = 1").orderBy("id").collect()
    assert [(r["profile"]["status"], r["extra"]) for r in out] == [("seen", 5), ("old", None)]


# ---- aggregates and groups ---------------------------------------------------------------------------------------


def test_aggregates(spark, users, table):
    for c in (users, table):
        assert c.aggregate("age", "sum").first()[0] == 140.0 and c.aggregate("age", "avg").first()[0] == 28.0
        assert c.aggregate("age", "min").first()[0] == 22.0 and c.aggregate("age", "max").first()[0] == 35.0
        assert c.aggregate("age", "count").first()[0] == 5 and c.aggregate("name", "count").first()[0] is None
        assert c.aggregate("name", "sum").first()[0] is None and c.aggregate("age", "median").first()[0] is None
    points = Collection.of_values(spark, [{"s": 10}, {}, {"s": 20}, {"s": "invalid"}])
    assert points.aggregate("s", "avg").first()[0] == 15.0 and points.aggregate("s", "count").first()[0] == 4
    assert points.stream_aggregate("count", "s").first()[0] == 4 and points.stream_aggregate("max", "t").first()[0] is None
    assert points.stream_aggregate("avg", "t").first()[0] == 0.0
    with pytest.raises(QueryError):
        points.stream_aggregate("median", "s")
    assert tuple(users.aggregate_many({"sum": "age", "max": "score", "count": "x"}).first()) == (140.0, 95.0, 5)


def test_groups(spark, users, table):
    wanted = {"admin": ["Alice", "Charlie"], "user": ["Bob", "Diana"], "viewer": ["Eve"]}
    got = {r["key"]: [json.loads(i.toJson())["name"] for i in r["items"]] for r in users.group_by("role").collect()}
    assert got == wanted
    assert {r["key"]: [i["name"] for i in r["items"]] for r in table.group_by("role").collect()} == wanted
    odd = Collection.of_values(spark, [{"k": 1}, {"k": "1"}, {"k": None}, {}, {"k": "null"}, {"k": 1.0}, {"k": [1, 2]}, {"k": True}])
    assert {r["key"]: r["n"] for r in odd.group_sizes("k").collect()} == {"1": 2, "null": 3, "1.0": 1, "[1,2]": 1, "true": 1}


def test_groups_sum_up_before_the_shuffle(table):
    plan = table.group_aggregate("role", {"a": ("age", "avg")})._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan


# ---- collection methods ------------------------------------------------------------------------------------------


def test_item_methods(spark, users):
    c = Collection.of_values(spark, [{"v": "a", "n": {"x": 1}}, {"v": None}, {}, {"v": 5}, 7, {"v": [1, {"q": "deep Word"}]}, {"v": True, "word": 0}])
    assert [python_value(r["v"]) for r in c.column("v").collect()] == ["a", None, 5, [1, {"q": "deep Word"}], True]
    assert c.implode("v", "|").first()[0] == 'a|null|5|[1,{"q":"deep Word"}]|true'
    assert [r["_pos"] for r in c.search("WORD").collect()] == [5]
    assert [r["_pos"] for r in c.search("tru").collect()] == [6]
    assert [r["_pos"] for r in c.search("null").collect()] == [1]
    assert users.chunk(2).orderBy("chunk_id").select("n").toPandas()["n"].tolist() == [2, 2, 1]
    assert json.loads(users.chunk(2).orderBy("chunk_id").first()["members"][1])["name"] == "Bob"
    with pytest.raises(ValueError):
        users.chunk(0)
    assert users.pluck(["name", "age"]).columns == ["name", "age"]


def test_typed_search_reaches_nested_values(spark):
    c = Collection.of_table(spark.createDataFrame([(1, ["Apple", "x"], ("q", {"k": "Pear"})), (2, None, ("r", None))], "id int, a array<string>, s struct<t string, m map<string,string>>"), "id")
    hit = lambda w: [r["id"] for r in c.search(w).collect()]
    assert hit("apple") == [1] and hit("PEAR") == [1] and hit("r") == [1, 2] and hit("2") == [2]


def test_keys_values_count(spark):
    df = documents.document_from_text(spark, '{"b": 1, "a": [1, 2, 3], "c": {}}')
    row = df.select(items.keys(F.col("doc")).alias("k"), F.size(items.values(F.col("doc"))).alias("v"), items.count(F.col("doc")).alias("n"), items.count(F.variant_get("doc", "$.a", "variant")).alias("m"), items.keys(F.variant_get("doc", "$.a", "variant")).alias("none")).first()
    assert (row["k"], row["v"], row["n"], row["m"], row["none"]) == (["a", "b", "c"], 3, 3, 3, [])


# ---- JSONPath and pointers ---------------------------------------------------------------------------------------

DOC = {
    "store": {"book": [{"t": "A", "p": 8}, {"t": "B", "p": 12, "tags": ["x", "y"]}, {"t": "C"}], "bike": {"p": 20}},
    "inventory": {"z": {"price": 1.5}, "a": {"price": 2.5}},
    "n": {"id": 1, "child": {"id": 2, "list": [{"id": 3}, {"no": 0}]}},
    "deep": {"0": "key", "k.l": 1},
}


def reach(doc, segments):
    """JSONPath on plain values, level by level."""

    def everything(v):
        yield v
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            yield from everything(x)

    nodes = [doc]
    for s in segments:
        out = []
        for v in nodes:
            inner = [v[k] for k in sorted(v)] if isinstance(v, dict) else v if isinstance(v, list) else []
            if isinstance(s, paths.Key):
                out += [v[s.name]] if isinstance(v, dict) and s.name in v else []
            elif isinstance(s, paths.Index):
                out += [v[s.at]] if isinstance(v, list) and -len(v) <= s.at < len(v) else []
            elif isinstance(s, paths.Wildcard):
                out += inner
            elif isinstance(s, paths.Slice):
                out += [v[i] for i in paths.slice_bounds(s, len(v))] if isinstance(v, list) else []
            elif isinstance(s, paths.Keys):
                out += [{k: v[k] for k in s.names if k in v}] if isinstance(v, dict) else []
            else:
                for x in everything({k: v[k] for k in sorted(v)} if isinstance(v, dict) else v):
                    if s.name == "*":
                        out += [x[k] for k in sorted(x)] if isinstance(x, dict) else x if isinstance(x, list) else []
                    elif isinstance(x, dict) and s.name in x:
                        out.append(x[s.name])
        nodes = out
    return nodes


@pytest.mark.parametrize(
    "path",
    [
        "$", "store.book", "$.store.book[0].t", "store.book[-1].t", "store.book[7]", "store.book[*].t", "inventory.*.price", "$..p", "n..id", "store..*", "store.book[0:2].t", "store.book[::-1].t",
        "store.book[-2:].t", "store.book[5:1:-2].t", "store.book[:1]", "store.book[1]['t','p','zz']", 'store.book[1]["t"]', "store.bike[0]", "deep.0", "deep[0]", "..tags[1]", "store.book.0", "*", "n.child..id", "store.book[::2].p",
    ],
)
def test_json_path(spark, path):
    frame = jsonpath.nodes(documents.document_from_text(spark, json.dumps(DOC)).select(F.col("doc").alias("v")), path)
    got = [python_value(r["v"]) for r in frame.orderBy("ord").collect()]
    assert got == reach(json.loads(json.dumps(DOC, sort_keys=True)), paths.json_path(path)), path


def test_json_path_filter(spark):
    frame = jsonpath.nodes(documents.document_from_text(spark, json.dumps(DOC)).select(F.col("doc").alias("v")), "store.book[?(@.p > 10)].t")
    assert [python_value(r["v"]) for r in frame.collect()] == ["B"]


def test_path_errors():
    with pytest.raises(QueryError) as e:
        paths.json_path("a.b[1")
    assert e.value.position == 3 and "^" in str(e.value) and "']'" in str(e.value)
    for bad in ("a[1:2:3:4]", "a[::0]"):
        with pytest.raises(QueryError):
            paths.json_path(bad)
    with pytest.raises(SecurityError):
        paths.check_depth(".".join("a" * 51))
    assert paths.parent_and_key("a.b.c") == ("a.b", "c") and paths.path_depth("a.b") == 2
    assert paths.json_path("a[x:y]") == [paths.Key("a"), paths.Slice(None, None, 1)]


def test_pointers(spark):
    doc = documents.document_from_text(spark, json.dumps({"company": {"departments": [{"id": 1, "staff": [{"id": 7}]}, {"id": 2}], "name": "x"}, "a/b": [1], "a~b": [2, 3]}))
    at = lambda p: [python_value(r["item"]) for r in pointer.items_at(doc, p).orderBy("_pos").collect()]
    assert at("/company/departments/0/staff") == [{"id": 7}] and at("/a~1b") == [1] and at("/a~0b") == [2, 3]
    assert at("/company") == [] and at("/company/name") == ["x"] and at("/company/departments/1/id") == [2]
    for bad in ("/nope", "/company/departments/5", "/company/name/x", "company", "/company/departments/x"):
        with pytest.raises(PointerError):
            pointer.items_at(doc, bad)
    root = documents.document_from_text(spark, "[1, 2, 3]")
    assert [python_value(r["item"]) for r in pointer.items_at(root, "").collect()] == [1, 2, 3]


def test_streams(spark, users):
    c = Collection.of_values(spark, [*USERS, 5])
    got = [python_value(r["item"]) for r in c.stream({"age": {"$gte": 25}}, limit=2, skip=1, select=["name"]).collect()]
    assert got == [{"name": "Bob"}, {"name": "Charlie"}]
    same = pointer.StreamFilter({"age": {"$gte": 25}}, ["name"], 2, 1).apply(c.df, c.resolver, c.position)
    assert [python_value(r["item"]) for r in same.collect()] == got
    assert c.stream([]).count() == 6 and c.stream(select=["name"]).collect()[-1]["item"].toPython() == 5


def test_unbounded_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"t": "2024-01-01 00:00:10", "k": "a"}\nbroken\n{"t": "2024-01-01 00:01:10", "k": "a"}\n{"k": "b", "t": "2024-01-01 00:00:20"}\n')
    rows = pointer.read_jsonl_stream(spark, str(tmp_path / "in"), {"k": {"$in": ["a", "b"]}})
    q = pointer.windowed_counts(rows, "t", "1 minute", "10 seconds", "k").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["key"], r["n"]) for r in spark.table("windows").collect()) == [("a", 1), ("a", 1), ("b", 1)]


# ---- values and documents ----------------------------------------------------------------------------------------


def test_editing_values():
    assert values.write({}, "a.0.b", 1) == {"a": [{"b": 1}]}
    assert values.write({"a": [1]}, "a.3", 9) == {"a": [1, None, None, 9]}
    assert values.write({"a": [1]}, "a.2.x", 9) == {"a": [1, {}, {"x": 9}]}
    assert values.write({"a": 5}, "a.b", 1) == {"a": 5} and values.write({"a": [1]}, "a.x", 1) == {"a": [1]}
    doc = {"a": [1, 2, {"b": 3}]}
    assert values.remove(doc, "a.2.b") and values.remove(doc, "a.0") and doc == {"a": [2, {}]} and not values.remove(doc, "a.9")
    assert values.merged({"a": {"x": 1}, "l": [1]}, {"a": {"y": 2}, "l": [2], "n": 0}) == {"a": {"x": 1, "y": 2}, "l": [1, 2], "n": 0}
    assert [values.value_key(v) for v in (values.MISSING, None, "a", 1, 1.0, True, {"b": 1, "a": [2]})] == ["null", "null", "a", "1", "1.0", "true", '{"a":[2],"b":1}']
    assert values.readable_size(10) == "10 B" and values.readable_size(2048) == "2.00 KB" and values.readable_size(3 << 20) == "3.00 MB"


def test_documents(spark, tmp_path):
    text = json.dumps({"a": [1, 2]}).encode()
    for codec in ("none", "gzip", "zstd"):
        (tmp_path / "d.json").write_bytes(documents.pack(text, codec))
        doc = documents.read_document(spark, str(tmp_path / "d.json"))
        assert Collection.of_document(doc, "a").df.count() == 2 and documents.loads(documents.pack(text, codec)) == {"a": [1, 2]}
    assert python_value(documents.document_from_text(spark, '{"a": 1, "a": 2}').first()[0]) == {"a": 2}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbad\n[2]\n')
    assert [python_value(r["item"]) for r in documents.read_jsonl(spark, str(tmp_path / "l.jsonl")).collect()] == [{"a": 1}, [2]]
    folder = str(tmp_path / "out")
    documents.append_jsonl(spark.range(3), folder)
    documents.append_jsonl(spark.range(3, 5), folder, "gzip")
    assert documents.read_jsonl(spark, folder).count() == 5
    assert documents.write_json_array(spark.range(5), str(tmp_path / "a.json"), ["id"]) == 5
    assert json.loads((tmp_path / "a.json").read_text()) == [{"id": i} for i in range(5)]
    for path, wanted in (("nowhere", 0), ("a", 2), ("", 0)):
        assert Collection.of_document(documents.document_from_text(spark, '{"a": [1, 2]}'), path).df.count() == wanted
