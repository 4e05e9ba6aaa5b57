import json
import math
from dataclasses import dataclass, field

import pytest

import lumenq.config as settings
from lumenq.collection import Collection
from lumenq.config import config
from lumenq.errors import HydrationError, LumenqError, SecurityError, TransactionError, ValidationError
from lumenq.hydrate import Coercion, HydratedStore, Hydrator, HydratorOptions, camel_case, spark_type, typed_items
from lumenq.operators import schema
from lumenq.sources.store import Store

VECTORS = [{"id": 1, "e": [1, 0, 0]}, {"id": 2, "e": [0, 1, 0]}, {"id": 3, "e": [0.707, 0.707, 0]}, {"id": 4, "e": [-1, 0, 0]}, {"id": 5, "e": [1, "x", 0]}, {"id": 6}, {"id": 7, "e": [1, 2]}]


@pytest.fixture()
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "db.json"))
    out.set("users", [{"id": 1, "name": "Ann", "age": 30}, {"id": 2, "name": "Bo", "age": 25}, {"id": 3, "name": "Cy"}])
    return out


# ---- vectors -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric,order,best", [("cosine", [1, 3], 1.0), ("l2", [1, 3], 0.0), ("euclidean", [1, 3], 0.0), ("dot", [1, 3], 1.0), ("inner_product", [1, 3], 1.0), (None, [1, 3], 1.0), ("strange", [1, 3], 1.0)])
def test_vector_search(spark, metric, order, best):
    c = Collection.of_values(spark, VECTORS)
    got = c.vector_search("e", [1, 0, 0], 2, metric).collect()
    assert [json.loads(r["item"].toJson())["id"] for r in got] == order and math.isclose(got[0]["score"], best, abs_tol=1e-6)
    index = c.create_vector_index("e", metric=metric)
    assert [json.loads(r["item"].toJson())["id"] for r in index.search([1, 0, 0], 2).collect()] == order


def test_vector_edges(spark):
    c = Collection.of_values(spark, VECTORS)
    scores = {json.loads(r["item"].toJson())["id"]: r["score"] for r in c.vector_search("e", [1, 0, 0], 99, "l2").collect()}
    assert set(scores) == {1, 2, 3, 4, 7} and scores[7] == math.inf
    zero = c.vector_search("e", [0, 0, 0], 99).collect()
    assert {r["score"] for r in zero} == {0.0}
    assert c.create_vector_index("e", dimension=3) is None  # one has two
    with pytest.raises(ValueError):
        c.vector_search("e", [1, 0], 3, dimension=3)
    typed = Collection.of_table(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id int, e array<float>"), "id")
    assert typed.vector_search("e", [1, 0], 5).count() == 1
    assert "TakeOrderedAndProject" in typed.vector_search("e", [1, 0], 5)._jdf.queryExecution().executedPlan().toString()


# ---- validation --------------------------------------------------------------------------------------------------

RULES = {
    "type": "object",
    "required": ["name", "age"],
    "properties": {
        "name": {"type": "string", "minLength": 2, "maxLength": 5, "pattern": "a"},
        "age": {"type": "integer", "min": 0, "maximum": 150},
        "mail": {"format": "email"},
        "role": {"enum": ["x", "y", 1]},
        "tags": {"type": "array", "items": {"type": "string"}},
    },
}


@pytest.mark.parametrize(
    "item,paths",
    [
        ({"name": "ann a", "age": 3, "mail": "a@b.c", "role": "x", "tags": ["t"]}, []),
        ({"name": "ä", "age": 3.0, "role": "x", "tags": []}, ["name"]),  # two bytes, but no "a"
        ({"name": "annaanna", "age": 3.5, "role": 1, "tags": ["t", 5]}, ["name", "age", "tags.1"]),
        ({"name": "an", "age": -1, "mail": "no", "role": "z", "tags": []}, ["age", "mail", "role"]),
        ({"name": "an", "role": "x"}, ["", "age", "tags"]),  # what is missing is checked as null
        ({"name": None, "age": 200, "role": 1.0, "tags": {}}, ["name", "age", "role", "tags"]),
        ([1], [""]),
        ("text", [""]),
    ],
)
def test_validation(spark, item, paths):
    c = Collection.of_values(spark, [item])
    got = c.df.select(schema.errors_column(c.resolver, RULES)).first()[0]
    assert sorted(e["path"] for e in got) == sorted(paths), got


def test_validation_of_collections(spark):
    c = Collection.of_values(spark, [{"name": "ana", "age": 1, "role": "x", "tags": []}, {}, 5])
    assert tuple(c.validate(RULES).first()) == (3, 1, 2, False)
    assert [r["_pos"] for r in c.invalid(RULES).collect()] == [1, 2]
    typed = Collection.of_table(spark.createDataFrame([(1, "ab"), (2, None)], "a int, s string"))
    rules = {"properties": {"a": {"type": "integer", "max": 1}, "s": {"type": "string"}, "gone": {"type": "string"}}}
    assert [sorted(e["path"] for e in r["errors"]) for r in typed.invalid(rules).orderBy("a").collect()] == [["gone"], ["a", "gone", "s"]]
    deep: dict = {"type": "integer"}
    for _ in range(102):
        deep = {"properties": {"a": deep}}
    with pytest.raises(SecurityError):
        schema.errors_column(c.resolver, deep)


@pytest.mark.parametrize(
    "rules,good,bad",
    [
        ({"multipleOf": 5}, 10, 7), ({"exclusiveMinimum": 3}, 4, 3), ({"exclusiveMaximum": 3}, 2, 3), ({"minItems": 2}, [1, 2], [1]), ({"maxItems": 1}, [1], [1, 2]),
        ({"uniqueItems": True}, [1, 2, "1"], [1, 2, 1]), ({"const": "a"}, "a", "b"), ({"format": "ipv4"}, "1.2.3.4", "1.2.3.400"), ({"format": "uuid"}, "123e4567-e89b-12d3-a456-426614174000", "x"),
        ({"format": "date"}, "2024-02-28", "2024-13-01"), ({"format": "date-time"}, "2024-02-28T10:00:00Z", "2024-02-28"), ({"format": "url"}, "https://a.b/c", "ftp:/x"), ({"format": "ipv6"}, "::1", "1.2.3.4"),
        ({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1}, {"a": 1, "b": 2}), ({"allOf": [{"type": "integer"}, {"min": 3}]}, 4, 2), ({"anyOf": [{"type": "string"}, {"min": 3}]}, "x", 2),
        ({"oneOf": [{"min": 3}, {"min": 5}]}, 4, 6), ({"not": {"type": "string"}}, 1, "x"), ({"if": {"type": "integer"}, "then": {"min": 3}, "else": {"minLength": 2}}, 4, "x"),
        ({"type": ["string", "null"]}, None, 5), ({"type": "string", "nullable": True}, None, 5), ({"format": "uri"}, "mailto:x", "no uri"),
    ],
)
def test_extended_keywords(spark, rules, good, bad):
    c = Collection.of_values(spark, [good, bad])
    assert [r["_pos"] for r in c.invalid(rules, extended=True).collect()] == [1]


# ---- the store ---------------------------------------------------------------------------------------------------


def test_reading_and_editing(store):
    assert store.get("users.0.name") == "Ann" and store.get("users.9") is None and store.get("users[-1].name") == "Cy" and store.get("users[*].age") == [30, 25] and store.get("$..id") == [1, 2, 3]
    assert store.has("users.2") and not store.has("users.3") and store.count("users") == 3 and store.keys("users.0") == ["age", "id", "name"] and store.values("users.1") == [25, 2, "Bo"]
    assert store.push("users", {"id": 4}) and store.count("users") == 4 and store.push("users.0.name", 1) and store.get("users.0.name") == "Ann"
    assert store.increment("users.0.age", 2) and store.get("users.0.age") == 32.0 and store.decrement("users.0.name") and store.get("users.0.name") == "Ann"
    assert store.merge("users.0", {"tags": [1]}) and store.merge("users.0", {"tags": [2]}) and store.get("users.0.tags") == [1, 2]
    assert store.set_many({"a.b": 1, "c": 2}) == 2 and store.remove_many(["a.b", "zz"]) == 1 and store.remove("users.3") and store.count("users") == 3
    assert json.loads(store.to_json(True))["c"] == 2 and store.stats()["top_level_keys"] == ["a", "c", "users"]
    assert store.memory_stats()["unique_keys"] == 7
    with pytest.raises(SecurityError):
        store.get(".".join(["a"] * 60))
    assert store.from_json('{"x": 1}') and store.get_all() == {"x": 1} and store.clear() and store.get_all() == {}
    with pytest.raises(LumenqError):
        store.from_json("{nope")


def test_store_queries(store, tmp_path):
    assert store.find("users", {"age": {"$lt": 28}}) == [{"id": 2, "name": "Bo", "age": 25}, {"id": 3, "name": "Cy"}]
    assert store.find("users", []) == [] and store.find("nowhere", {}) == [] and store.find_one("users", {"id": 9}) is None
    assert store.execute_query("users", {"order_by": {"field": "name", "desc": True}, "select": ["name"]}) == ["Cy", "Bo", "Ann"]
    assert store.query("SELECT name FROM users WHERE age >= 25 ORDER BY age") == ["Bo", "Ann"]
    assert store.query("INSERT INTO users (id, name, p.q) VALUES (4, 'Di', 1)") == 1 and store.find_one("users", {"id": 4}) == {"id": 4, "name": "Di", "p.q": 1}
    assert store.query("UPDATE users SET meta.seen = true, age = 1 WHERE name LIKE 'A%'") == 1 and store.get("users.0") == {"id": 1, "name": "Ann", "age": 1, "meta": {"seen": True}}
    assert store.query("DELETE FROM users WHERE id > 2") == 2 and store.count("users") == 2 and store.query("DELETE FROM users") == 2 and store.query("INSERT INTO fresh (a) VALUES (1)") == 1
    store.set("users", [{"n": "x", "v": 1}, {"n": "y", "v": 2}, {"n": "x", "v": 3}])
    assert store.aggregate("users", "v", "sum") == 6.0 and list(store.group_by("users", "n")) == ["x", "y"] and store.pluck("users", ["v"]) == [1, 2, 3] and store.column("users", "n") == ["x", "y", "x"]
    assert store.implode("users", "v", "-") == "1-2-3" and len(store.chunk("users", 2)) == 2 and store.search("users", "Y") == [{"n": "y", "v": 2}]
    assert list(store.stream("/users", {"n": "x"}, limit=1)) == [{"n": "x", "v": 1}] and store.stream_count("/users", {"n": "x"}) == 2 and store.stream_aggregate("/users", "max", "v") == 3.0
    assert store.stream_to_file("/users", str(tmp_path / "o.json"), {"n": "x"}) == 2 and json.loads((tmp_path / "o.json").read_text())[1]["v"] == 3
    assert store.validate("users.0", {"type": "object", "properties": {"v": {"min": 5}}}) == {"valid": False, "error_count": 1, "errors": [{"path": "users.0.v", "error": "Value 1.0 < minimum 5"}]}
    assert store.validate_collection("users", {"properties": {"v": {"max": 2}}})["details"][0]["index"] == 2


def test_transactions(store, spark):
    store.begin()
    store.set("users", [])
    assert store.in_transaction() and store.find("users", {}) == [] and store.stream_count("/users") == 0
    assert Store(spark, str(store.main)).count("users") == 3  # others see nothing yet
    with pytest.raises(TransactionError):
        store.begin()
    before = len(store.history())
    store.rollback()
    assert store.count("users") == 3 and len(store.history()) == before
    with store.transaction():
        store.set("a", 1)
        store.set("b", 2)
    assert store.get("b") == 2 and [e["path"] for e in store.history()[-2:]] == ["a", "b"]
    with pytest.raises(RuntimeError), store.transaction():
        store.set("a", 9)
        raise RuntimeError
    assert store.get("a") == 1
    for wrong in (store.commit, store.rollback):
        with pytest.raises(TransactionError):
            wrong()


def test_history(store):
    store.set("v", 1)
    store.set("v", 2)
    store.remove("users.0")
    store.set("w.x", 1)
    assert [e["id"] for e in store.history()] == [1, 2, 3, 4, 5] and [e["id"] for e in store.history("users")] == [1, 4] and [e["id"] for e in store.history("w")] == [5]
    assert store.history_frame().where("op = 'set'").count() == 4
    assert store.rollback_to(3) and store.get("v") == 2 and store.has("w") and not store.has("w.x") and len(store.history()) == 3
    assert store.rollback_to(2) and store.get("v") == 1
    with pytest.raises(LumenqError):
        store.rollback_to(77)
    assert store.rollback_to_timestamp(0) and not store.has("v")
    store.set_option("revision", False)
    store.set("q", 1)
    assert store.history() == []


def test_branches_backups_options(store, spark, tmp_path):
    store.create_branch("dev")
    store.switch_branch("dev")
    store.push("users", {"id": 9})
    store.set("config", {"theme": "dark"})
    store.switch_branch("main")
    assert store.count("users") == 3 and store.list_branches() == ["main", "dev"]
    store.merge_branch("dev")
    assert store.count("users") == 7 and store.get("config.theme") == "dark"
    store.delete_branch("dev")
    for bad in (lambda: store.switch_branch("dev"), lambda: store.create_branch("../x"), lambda: store.delete_branch("main")):
        with pytest.raises(LumenqError):
            bad()
    copy = store.backup()
    store.clear()
    assert store.restore(copy) and store.count("users") == 7
    for codec in ("gzip", "zstd", "none"):
        store.set_option("compression", codec)
        store.set("c", codec)
        assert Store(spark, str(store.main)).get("c") == codec
    store.set_option("pretty_print", True)
    store.set("c", 1)
    assert "\n" in store.main.read_text() and store.get_option("pretty") is True
    for bad in (lambda: store.get_option("zz"), lambda: store.set_option("compression", "rar")):
        with pytest.raises(LumenqError):
            bad()
    assert store.metrics()["writes"] > 0 and store.write_to_file(str(tmp_path / "x.json"))


def test_jsonl_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log.jsonl"))
    s.append_jsonl({"a": 1})
    s.append_jsonl([1])
    with open(s.path, "a") as f:
        f.write("broken\n\n")
    assert s.read_jsonl().count() == 2


def test_indexes(store):
    assert store.create_index("users", "id") and store.create_index("users", "id", "name") and store.stats()["active_indexes"] == 2
    assert store.index_lookup("users", "id", "2") == [{"id": 2, "name": "Bo", "age": 25}] and store.index_lookup("users", "id", 9) is None and store.index_lookup("users", "name", "Bo") is None
    rows = {r["field"]: (r["type"], r["unique_values"], r["total_entries"]) for r in store.list_indexes()}
    assert rows == {"id": ("single", 3, 3), "id,name": ("compound", 3, 3)}
    assert store.drop_index("users.id") and store.drop_index("users") and not store.drop_index("users")
    store.set("items", [v for v in VECTORS if v["id"] < 5])
    assert store.create_vector_index("items", "e", 3, "l2") and not store.create_vector_index("items", "e", 2)
    assert [r["item"]["id"] for r in store.vector_search("items", "e", [1, 0, 0], 1)] == [1] and store.list_indexes()[0]["dimension"] == 3
    with pytest.raises(ValueError):
        store.vector_search("items", "e", [1], 1)
    store.create_index("users", "id")
    assert store.drop_all_indexes() == 2
    store.create_index("users", "id")
    store.set("x", 1)  # a write clears them
    assert store.list_indexes() == []


def test_enforced_schema(spark, tmp_path):
    s = Store(spark, str(tmp_path / "e.json"), enforce={"users": {"type": ["array", "null"], "items": {"required": ["id"]}}})
    s.set("users", [{"id": 1}])
    with pytest.raises(ValidationError):
        s.push("users", {"no": 1})
    assert s.count("users") == 1


def test_config(spark, tmp_path):
    saved = settings.get_config()
    try:
        assert settings.set_max_file_size("1K") == 1024 and settings.parse_size("2G") == 2 << 30 and settings.set_allowed_extensions("json, DB,") == ["json", "db"]
        with pytest.raises(ValueError):
            settings.parse_size("many")
        with pytest.raises(SecurityError):
            Store(spark, str(tmp_path / "x.txt"))
        with pytest.raises(SecurityError):
            Store(spark, str(tmp_path / ".." / "x.json"))
        (tmp_path / "big.json").write_text(json.dumps({"a": "x" * 2000}))
        with pytest.raises(SecurityError):
            Store(spark, str(tmp_path / "big.json")).get("a")
        settings.set_base_path(str(tmp_path / "inside"))
        with pytest.raises(SecurityError):
            Store(spark, str(tmp_path / "y.json"))
        settings.clear_base_path()
    finally:
        for k, v in saved.items():
            setattr(config, k, v)


# ---- typed objects -----------------------------------------------------------------------------------------------


@dataclass
class Tag:
    id: int
    name: str


@dataclass
class User:
    id: int
    name: str
    email: str | None
    tags: list[Tag] = field(default_factory=list)
    active: bool = True


def test_hydration(spark, store):
    h = Hydrator()
    u = h.hydrate({"id": 1, "name": "A", "tags": [{"id": 1, "name": "t"}], "more": 0}, User)
    assert u == User(1, "A", None, [Tag(1, "t")], True) and h.dehydrate(u, ("tags",)) == {"id": 1, "name": "A", "email": None, "active": True}
    for bad in ({"id": "1", "name": "A"}, {"id": 1}, {"id": None, "name": "x"}, {"id": 1, "name": "x", "tags": 5}, {"id": 1, "name": "x", "tags": [5]}):
        with pytest.raises(HydrationError):
            h.hydrate(bad, User)
    loose = Hydrator(HydratorOptions(coercion=Coercion.LENIENT, unknown="raise", key=camel_case))
    assert loose.hydrate({"id": "12abc", "name": 5, "active": "0"}, User) == User(12, "5", None, [], False)
    with pytest.raises(HydrationError):
        loose.hydrate({"id": 1, "name": "x", "first_name": "y"}, User)
    assert camel_case("first_name") == "firstName"
    assert spark_type(User).simpleString() == "struct<id:bigint,name:string,email:string,tags:array<struct<id:bigint,name:string>>,active:boolean>"
    rows = typed_items(store.collection("users").df, User).orderBy("_pos").collect()
    assert [r["object"]["name"] for r in rows] == ["Ann", "Bo", "Cy"]
    hs = HydratedStore(store)
    assert hs.find_one_as("users", {"id": 2}, User).name == "Bo" and len(hs.find_in_as("users", {}, User)) == 3 and [u.id for u in hs.stream_as("/users", User)] == [1, 2, 3]
    assert hs.push_object("users", User(7, "Z", None)) and store.get("users.3.active") is True and hs.set_object("one", Tag(1, "q")) and store.get("one.name") == "q"
    assert hs.find_one_as("users", {"id": 99}, User) is None


def test_recursive_descent_has_no_row_limit(spark):
    from pyspark.sql import functions as F

    from lumenq.operators import jsonpath

    n = 510_000  # two nodes each
    docs = spark.range(n).select("id", F.parse_json(F.concat(F.lit('{"k":'), F.col("id").cast("string"), F.lit("}"))).alias("v"))
    found = jsonpath.nodes(docs, "$..k").agg(F.count(F.lit(1)), F.sum(F.try_variant_get("v", "$", "bigint"))).first()
    assert tuple(found) == (n, n * (n - 1) // 2)


def test_held_lock_survives_cleanup_and_keeps_others_out(spark, store):
    """Another process holds the lock, which looks stale; a second store neither removes it nor writes before it is free."""
    import os
    import subprocess
    import sys
    import time

    lock = f"{store.main}.lock"
    hold = "import fcntl, sys, time\nf = open(sys.argv[1], 'a')\nfcntl.flock(f, fcntl.LOCK_EX)\nprint('held', flush=True)\ntime.sleep(2)\n"
    other = subprocess.Popen([sys.executable, "-c", hold, lock], stdout=subprocess.PIPE, text=True)
    assert other.stdout.readline() == "held\n"
    os.utime(lock, (time.time() - 7200,) * 2)
    began = time.time()
    second = Store(spark, str(store.main))
    assert os.path.exists(lock)
    second.set("x", 1)
    assert time.time() - began > 1 and other.wait() == 0
    os.utime(lock, (time.time() - 7200,) * 2)
    assert second.cleanup() == 1 and not os.path.exists(lock)


def test_two_processes_lose_no_write(store):
    """Both add to one list through the lock; a transaction that began before another write doesn't commit."""
    import subprocess
    import sys

    add = (
        "import sys\nfrom lumenq.sources.store import Store\ns = Store(None, sys.argv[1])\nfor k in range(40):\n    s.push('log', [sys.argv[2], k])\n"
    )
    store.set("log", [])
    both = [subprocess.Popen([sys.executable, "-c", add, str(store.main), name], cwd=str(settings.__file__).rsplit("/", 2)[0]) for name in "ab"]
    assert [p.wait() for p in both] == [0, 0]
    assert sorted(map(tuple, store.get("log"))) == [(name, k) for name in "ab" for k in range(40)]
    assert [e["id"] for e in store.history()] == list(range(1, len(store.history()) + 1))
    other = Store(store.spark, str(store.main))
    store.begin()
    store.set("mine", 1)
    other.set("theirs", 1)
    with pytest.raises(TransactionError):
        store.commit()
    assert store.get("theirs") == 1 and store.get("mine") is None and not store.in_transaction()
