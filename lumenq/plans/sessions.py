"""Registered sessions with the document store, the path functions, schemas and typed objects, and the SQL of their results.

A session edits or reads a store over the nations and gives rows (name, value), values as text or JSON. Its SQL states
the same rows, from the tables where they hold them, else as values that follow from the semantics.
"""

from __future__ import annotations

import gzip
import json
import os
import tempfile
import time
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq import __version__
from lumenq.collection import Collection
from lumenq.config import clear_base_path, config, get_config, parse_size, set_allowed_extensions, set_base_path, set_max_file_size
from lumenq.errors import LumenqError
from lumenq.functions import paths, values
from lumenq.hydrate import Coercion, HydratedStore, Hydrator, HydratorOptions, camel_case, typed_items
from lumenq.plans.catalogue import register
from lumenq.sources import documents
from lumenq.sources.store import Store
from lumenq.streaming.pointer import StreamFilter

NATIONS = "SELECT json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'n_regionkey', n_regionkey) AS item, * FROM nation"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that executors see too: below spark.checkpoint.dir, or of this machine in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return f"{where.rstrip('/')}/{name}-{time.time_ns()}-{os.getpid()}"
    if not spark.sparkContext.master.startswith("local"):
        raise LumenqError("a cluster needs spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="lumenq-") + f"/{name}"


@contextmanager
def store_of(spark: SparkSession, d: str) -> Iterator[Store]:
    """A store over the nations in a folder of the driver, which alone reads and writes it; the folder goes at the end."""
    rows = [r.asDict() for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]
    base, config.base_path = config.base_path, None
    with tempfile.TemporaryDirectory(prefix="lumenq-") as folder:
        try:
            store = Store(spark, f"{folder}/db.json")
            store.from_json(json.dumps({"nations": rows}))
            yield store
        finally:
            config.base_path = base


def said(value: Any) -> str:
    return value if isinstance(value, str) else documents.dumps(value)


def refused(f: Callable[[], Any]) -> str:
    """The name of the error that f raises."""
    try:
        f()
    except Exception as e:
        return type(e).__name__
    return "nothing"


def rows_sql(**expected: Any) -> str:
    """Rows (name, value) with fixed values, or with a scalar query each: {"sql": text}."""
    quoted = lambda v: f"({v['sql']})" if isinstance(v, dict) and set(v) == {"sql"} else "'" + said(v).replace("'", "''") + "'"
    return " UNION ALL ".join(f"SELECT '{k}' AS name, CAST({quoted(v)} AS VARCHAR) AS value" for k, v in expected.items())


def session(name: str, **expected: Any):
    """Register f(store) -> {name: value} with the rows it must give."""

    def take(f: Callable[[Store], dict[str, Any]]):
        def query(spark: SparkSession, d: str) -> DataFrame:
            with store_of(spark, d) as store:
                found = f(store)
            return spark.createDataFrame([(k, said(v)) for k, v in found.items()], "name string, value string")

        register(name, rows_sql(**expected))(query)
        return f

    return take


FIRST = "SELECT {0} FROM nation ORDER BY n_nationkey LIMIT 1"
NAMES = "to_json(list(n_name ORDER BY n_nationkey))"


# ---- reading and paths -------------------------------------------------------------------------------------------


@session(
    "store_reads", file="db.json", all=["nations"], count={"sql": "SELECT count(*) FROM nation"}, keys=["n_name", "n_nationkey", "n_regionkey"], no_keys=[], values={"sql": FIRST.format("json_array(n_name, n_nationkey, n_regionkey)")},
    first={"sql": FIRST.format("n_name")}, missing=None, has=[True, False, True], size_of_scalar=0, top={"sql": "SELECT json_object('key_count', 2, 'top_level_keys', ['nations', 'void'], 'active_indexes', 0)"},
    names={"sql": f"SELECT {NAMES} FROM nation"}, several={"sql": FIRST.format("json_array(json_object('n_name', n_name, 'n_regionkey', n_regionkey))")}, version=__version__,
)
def store_reads(store: Store) -> dict[str, Any]:
    store.set("void", None)
    top = store.stats()
    return {
        "file": store.main.name, "all": [k for k in sorted(store.get_all()) if k != "void"], "count": store.count("nations"), "keys": store.keys("nations.0"), "no_keys": store.keys("nations"), "values": store.values("nations.0"),
        "first": store.get("nations.0.n_name"), "missing": store.get("nations.999"), "has": [store.has("nations.0.n_name"), store.has("nations.999"), store.has("void")], "size_of_scalar": store.count("nations.0.n_name"),
        "top": '{"key_count":%d,"top_level_keys":%s,"active_indexes":%d}' % (top["key_count"], said(top["top_level_keys"]), top["active_indexes"]),
        "names": store.get("$.nations[*].n_name"), "several": store.query_nodes('$.nations[0]["n_name","n_regionkey"]'), "version": __version__,
    }


@session(
    "path_functions", nested={"sql": FIRST.format("n_name")}, gone="MISSING", parent=["a.b", "c"], index=[True, False, False], depth=[3, 0], too_deep="SecurityError", deep_enough=True, bad_path="QueryError", told=True,
)
def path_functions(store: Store) -> dict[str, Any]:
    data = store.get_all()
    try:
        paths.json_path("$.a[")
        told = False
    except LumenqError as e:
        told = "^" in str(e)
    return {
        "nested": values.read(data, "nations.0.n_name"), "gone": "MISSING" if values.read(data, "nations.0.zz") is values.MISSING else "there", "parent": list(paths.parent_and_key("a.b.c")),
        "index": [paths.is_index("12"), paths.is_index("-1"), paths.is_index("x")], "depth": [paths.path_depth("a.b.c"), paths.path_depth("")],
        "too_deep": refused(lambda: store.get(".".join("a" * 51))), "deep_enough": store.get(".".join("a" * 50)) is None, "bad_path": refused(lambda: store.get("$.a[")), "told": told,
    }


# ---- edits, transactions, history, branches ----------------------------------------------------------------------


@session(
    "store_edits", set={"a": {"b": [1]}}, pushed={"a": {"b": [1, "x"]}}, no_push={"a": {"b": [1, "x"]}}, merged={"a": {"b": [1, "x", 2], "c": {"d": True}}}, increased=[3.5, 1.5], many=[2, {"m": 1, "n": {"o": 2}}], gone=[1, False, True], cleared={}, imported={"sql": "SELECT count(*) FROM nation"}, mutated=7,
)
def store_edits(store: Store) -> dict[str, Any]:
    out, before = {}, store.to_json()
    store.remove("nations")
    store.set("a.b", [1])
    out["set"] = store.get_all()
    store.push("a.b", "x")
    out["pushed"] = store.get_all()
    store.push("a", "no array")
    out["no_push"] = store.get_all()
    store.merge("a", {"b": [2], "c": {"d": True}})
    out["merged"] = store.get_all()
    store.set("n", 1)
    store.increment("n", 2.5)
    up = store.get("n")
    store.decrement("n", 2)
    out["increased"] = [up, store.get("n")]
    store.clear()
    n = store.set_many({"m": 1, "n.o": 2})
    out["many"] = [n, store.get_all()]
    out["gone"] = [store.remove_many(["m", "zz"]), store.has("m"), store.has("n.o")]
    store.clear()
    out["cleared"] = store.get_all()
    store.from_json(before)
    out["imported"] = store.count("nations")
    store.mutate(lambda data: {"seven": 7})
    out["mutated"] = store.get("seven")
    return out


@session(
    "store_transactions", states=[False, True, False, False], kept={"sql": "SELECT count(*) FROM nation WHERE n_regionkey = 0"}, rolled_back={"sql": "SELECT count(*) FROM nation"}, seen_inside=0, errors=["TransactionError", "TransactionError", "TransactionError"], lost_update=["TransactionError", "theirs"], journal_grows_at_commit=[0, 2],
    after_error={"sql": "SELECT count(*) FROM nation"},
)
def store_transactions(store: Store) -> dict[str, Any]:
    states = [store.in_transaction()]
    store.begin()
    states.append(store.in_transaction())
    before = len(store.history())
    store.query("UPDATE nations SET n_name = 'X' WHERE n_regionkey = 0")
    store.set("meta", 1)
    inside = len(store.history()) - before
    twice = refused(store.begin)
    store.commit()
    grown = [inside, len(store.history()) - before]
    states.append(store.in_transaction())
    out = {"kept": len(store.find("nations", {"n_name": "X"}))}
    store.begin()
    store.clear()
    out["seen_inside"] = store.count("nations")
    store.rollback()
    out["rolled_back"] = store.count("nations")
    states.append(store.in_transaction())
    out |= {"states": states, "errors": [twice, refused(store.commit), refused(store.rollback)], "journal_grows_at_commit": grown}
    other = Store(store.spark, str(store.main))
    store.begin()
    store.set("meta", "ours")
    other.set("meta", "theirs")
    out["lost_update"] = [refused(store.commit), store.get("meta")]

    def broken():
        with store.transaction():
            store.clear()
            raise KeyError

    refused(broken)
    out["after_error"] = store.count("nations")
    return out


@register("store_history", "SELECT * FROM (VALUES (1, 'import', '', true), (2, 'set', 'meta.version', false), (3, 'increment', 'meta.version', true), (4, 'set', 'nations', true)) t(id, op, path, existed)")
def store_history(spark: SparkSession, d: str) -> DataFrame:
    with store_of(spark, d) as store:
        store.set("meta.version", 1)
        store.increment("meta.version")
        store.query("DELETE FROM nations WHERE n_regionkey = 0")
        store.remove("meta")
        store.rollback_to(4)
        return store.history_frame().select(F.col("id").cast("int").alias("id"), "op", "path", "existed")


@session(
    "store_rollback", versions=[2.0, 1, False], of_path=[2, 3], after_mutation={"sql": "SELECT count(*) FROM nation"}, unknown="LumenqError", by_time=[True, {}], off=0,
)
def store_rollback(store: Store) -> dict[str, Any]:
    store.set("meta.version", 1)
    store.increment("meta.version")
    out: dict[str, Any] = {"of_path": [len([e for e in store.history("meta") if e["path"]]), len(store.history("meta.version"))]}
    store.query("DELETE FROM nations WHERE n_regionkey = 0")
    store.rollback_to(3)
    out["after_mutation"] = store.count("nations")
    out["versions"] = [store.get("meta.version")]
    store.rollback_to(2)
    out["versions"].append(store.get("meta.version"))
    store.rollback_to(1)
    out["versions"].append(store.has("meta.version"))
    out["unknown"] = refused(lambda: store.rollback_to(99))
    out["by_time"] = [store.rollback_to_timestamp(0), store.get_all()]
    store.set_option("revision", False)
    before = len(store.history())
    store.set("unlogged", 1)
    out["off"] = len(store.history()) - before
    return out


@register("store_branches", "SELECT CAST(n_regionkey AS VARCHAR) AS key, count(*) AS n FROM (SELECT n_regionkey FROM nation UNION ALL SELECT n_regionkey FROM nation WHERE n_regionkey = 1) GROUP BY ALL")
def store_branches(spark: SparkSession, d: str) -> DataFrame:
    with store_of(spark, d) as store:
        store.create_branch("test")
        store.switch_branch("test")
        store.query("DELETE FROM nations WHERE n_regionkey != 1")
        store.switch_branch("main")
        store.merge_branch("test")
        sizes = [(str(r["n_regionkey"]), 1) for r in store.get("nations")]
        return spark.createDataFrame(sizes, "key string, one long").groupBy("key").agg(F.sum("one").alias("n"))


@session("store_branch_names", listed=["main", "dev", "test"], isolated=[1, 0], errors=["LumenqError"] * 4, left=["main", "dev"])
def store_branch_names(store: Store) -> dict[str, Any]:
    store.create_branch("test")
    store.create_branch("dev")
    listed = store.list_branches()
    store.switch_branch("test")
    store.set("here", 1)
    one = store.count("nations") > 0 and store.get("here")
    store.switch_branch("main")
    errors = [refused(f) for f in (lambda: store.create_branch("dev"), lambda: store.switch_branch("none"), lambda: store.create_branch("../x"), lambda: store.delete_branch("main"))]
    isolated = [one, int(store.has("here"))]
    store.delete_branch("test")
    return {"listed": listed, "isolated": isolated, "errors": errors, "left": store.list_branches()}


# ---- files -------------------------------------------------------------------------------------------------------


@session(
    "store_files", exported={"sql": f"SELECT '{{\"nations\":[' || string_agg(CAST(item AS VARCHAR), ',' ORDER BY n_nationkey) || ']}}' FROM ({NATIONS})"}, pretty=[True, True], written=True, restored={"sql": "SELECT count(*) FROM nation"}, codecs=["1f8b", "28b52ffd", "7b226322"], reread=["gzip", "zstd", "none"],
    read_gzip={"sql": "SELECT count(*) FROM nation"}, no_temporary=[], default_backup=True, made=[True, {}],
)
def store_files(store: Store) -> dict[str, Any]:
    folder = store.main.parent
    out: dict[str, Any] = {"exported": store.to_json()}
    out["pretty"] = [store.write_to_file(f"{folder}/out.json", pretty=True), "\n" in Path(f"{folder}/out.json").read_text()]
    out["written"] = json.loads(Path(f"{folder}/out.json").read_text()) == store.get_all()
    copy = store.backup()
    out["default_backup"] = copy.startswith(f"{store.main}.backup.")
    store.clear()
    store.restore(copy)
    out["restored"] = store.count("nations")
    Path(f"{folder}/packed.json").write_bytes(gzip.compress(store.to_json().encode()))
    out["read_gzip"] = Store(store.spark, f"{folder}/packed.json").count("nations")
    store.clear()
    out["codecs"], out["reread"] = [], []
    for codec in ("gzip", "zstd", "none"):
        store.set_option("compression", codec)
        store.set("c", codec)
        out["codecs"].append(store.main.read_bytes()[: 2 if codec == "gzip" else 4].hex())
        out["reread"].append(Store(store.spark, str(store.main)).get("c"))
    out["no_temporary"] = sorted(p.name for p in folder.glob("*.tmp"))
    fresh = Store(store.spark, f"{folder}/deeper/new.json")
    out["made"] = [fresh.main.exists(), fresh.get_all()]
    return out


@register("jsonl_round_trip", "SELECT r_name, 1 AS line FROM region UNION ALL SELECT r_name, 2 FROM region WHERE r_regionkey < 2")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_path(spark, "lines")
    region = spark.read.parquet(f"{d}/region.parquet")
    documents.append_jsonl(region.withColumn("line", F.lit(1)), folder)
    documents.append_jsonl(region.where("r_regionkey < 2").withColumn("line", F.lit(2)), folder)
    broken = spark.createDataFrame([("{broken",), ("",)], "value string")
    broken.coalesce(1).write.mode("append").text(folder)
    return documents.read_jsonl(spark, folder).select(F.try_variant_get("item", "$.r_name", "string").alias("r_name"), F.try_variant_get("item", "$.line", "int").alias("line"))


@session("store_streams", elements={"sql": f"SELECT {NAMES} FROM nation WHERE n_regionkey = 1"}, page={"sql": f"SELECT {NAMES} FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 3 OFFSET 2)"}, object=[], scalar=["ok"], escaped=[1, 2], missing="PointerError", through="PointerError", filtered=[{"id": 1}],
         exported={"sql": "SELECT json_array(count(*), to_json(list(json_object('n_name', n_name) ORDER BY n_nationkey))) FROM nation WHERE n_regionkey = 2"}, sees_transaction=0, counted={"sql": "SELECT count(*) FROM nation WHERE n_regionkey = 3"}, total={"sql": "SELECT CAST(sum(n_nationkey) AS DOUBLE) FROM nation"})
def store_streams(store: Store) -> dict[str, Any]:
    store.set("deep", {"a/b": [1], "a~b": [2], "word": "ok", "o": {"x": 1}})
    out = store.main.parent / "out.json"
    n = store.stream_to_file("/nations", str(out), {"n_regionkey": 2}, select=["n_name"])
    take, some = StreamFilter({"id": {"$gt": 0}}, select=["id"]), Collection.of_values(store.spark, [{"id": 1, "n": 2}, {"id": 0}])
    found = {
        "elements": [x["n_name"] for x in store.stream("/nations", {"n_regionkey": 1})], "page": [x["n_name"] for x in store.stream("/nations", limit=3, skip=2)], "object": list(store.stream("/deep/o")), "scalar": list(store.stream("/deep/word")),
        "escaped": [*store.stream("/deep/a~1b"), *store.stream("/deep/a~0b")], "missing": refused(lambda: list(store.stream("/none"))), "through": refused(lambda: list(store.stream("/deep/word/x"))),
        "filtered": some.values(take.apply(some.df, some.resolver, some.position)), "exported": f"[{n},{out.read_text()}]", "counted": store.stream_count("/nations", {"n_regionkey": 3}), "total": store.stream_aggregate("/nations", "sum", "n_nationkey"),
    }
    with store.transaction():
        store.set("nations", [])
        found["sees_transaction"] = store.stream_count("/nations")
    return found


# ---- options, errors, observation --------------------------------------------------------------------------------


@session("store_options", defaults=[False, False, "none", True], aliases=[True, True], unknown=["LumenqError", "LumenqError"], sizes=[1024, 2097152, 3221225472, 7], bad_size="ValueError", extensions=["json", "db"], wrong_extension="SecurityError", outside="SecurityError", too_large="SecurityError", limit=2048, cleared=True)
def store_options(store: Store) -> dict[str, Any]:
    out: dict[str, Any] = {"defaults": [store.get_option(n) for n in ("pretty", "fsync", "compression", "revision_log")]}
    store.set_option("pretty_print", True)
    store.set_option("sync", True)
    out["aliases"] = [store.get_option("pretty"), store.get_option("fsync")]
    out["unknown"] = [refused(lambda: store.get_option("zz")), refused(lambda: store.set_option("compression", "rar"))]
    out["sizes"], out["bad_size"] = [parse_size(x) for x in ("1K", "2M", "3G", "7")], refused(lambda: parse_size("many"))
    saved, folder = get_config(), store.main.parent
    try:
        out["extensions"] = set_allowed_extensions("json, DB,")
        out["wrong_extension"] = refused(lambda: Store(store.spark, f"{folder}/x.txt"))
        out["limit"] = set_max_file_size("2K")
        (folder / "big.json").write_text(json.dumps("x" * 3000))
        out["too_large"] = refused(lambda: Store(store.spark, f"{folder}/big.json").get_all())
        set_base_path(f"{folder}/inside")
        out["outside"] = refused(lambda: Store(store.spark, f"{folder}/y.json"))
        clear_base_path()
        out["cleared"] = get_config()["base_path"] is None
    finally:
        for k, v in saved.items():
            setattr(config, k, v)
    return out


@session("query_errors", sql=["UnsupportedSql", "QueryError", "UnsupportedSql", "QueryError"], clauses_in_any_case={"sql": "SELECT count(*) FROM nation WHERE n_regionkey = 1"}, unknown_op=[0, True], unknown_aggregate=None, journaled=["set", "nations", True], json_lines={"sql": "SELECT count(*) FROM nation"})
def query_errors(store: Store) -> dict[str, Any]:
    bad = ("FROM nations", "SELECT *", "DROP TABLE nations", "INSERT INTO nations (a, b) VALUES (1)")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        none = len(store.execute_query("nations", {"where": [{"field": "n_name", "op": "almost", "value": "x"}]}))
        told_so = any("almost" in str(w.message) for w in told)
    store.query("UPDATE nations SET n_name = 'Y' WHERE n_nationkey = 0")
    last = store.history()[-1]
    return {
        "sql": [refused(lambda t=t: store.query(t)) for t in bad], "clauses_in_any_case": len(store.query("select * from nations where n_regionkey = 1 order by n_name desc")), "unknown_op": [none, told_so], "unknown_aggregate": store.aggregate("nations", "n_nationkey", "median"),
        "journaled": [last["op"], last["path"], len(last["old"]) == len(last["new"]) and last["new"][0]["n_name"] == "Y"], "json_lines": len([json.loads(x) for x in store.collection("nations").df.select(F.to_json("item")).toPandas().iloc[:, 0]]),
    }


@session("store_observed", reads=True, writes=2, hit_rate=True, keys=["n_name", "n_nationkey", "n_regionkey", "nations"], unique=4, references={"sql": "SELECT 3 * count(*) + 1 FROM nation"}, cleaned=[2, True, True])
def store_observed(store: Store) -> dict[str, Any]:
    import fcntl

    before = store.metrics()
    store.set("a", 1)
    store.remove("a")
    store.get("nations")
    now, seen = store.metrics(), store.memory_stats()
    old = time.time() - 7200
    for name in ("db.json.1.tmp", "db.json.tx", "db.json.lock"):
        (store.main.parent / name).touch()
        os.utime(store.main.parent / name, (old, old))
    with open(f"{store.main}.lock", "a") as f:  # a lock that is held stays, however old it looks
        fcntl.flock(f, fcntl.LOCK_EX)
        n = store.cleanup()
        held = Path(f.name).exists()
    os.utime(f.name, (old, old))
    return {
        "reads": now["reads"] > before["reads"], "writes": now["writes"] - before["writes"], "hit_rate": 0 <= now["cache_hit_rate"] <= 1, "keys": sorted(set(values.all_keys(store.get_all()))), "unique": seen["unique_keys"], "references": seen["total_references"],
        "cleaned": [n, held, store.cleanup() == 1 and not Path(f.name).exists()],
    }


# ---- schemas, indexes, objects -----------------------------------------------------------------------------------

DEEP = {"type": "integer"}
for _ in range(110):
    DEEP = {"properties": {"a": DEEP}}
NESTED: Any = 1
for _ in range(110):
    NESTED = {"a": NESTED}


@session("schema_keywords", pattern=[True, False], email=[True, False, True], multiple=[True, False], items=[True, False, False], unique=[True, False], extra=[True, False], const=[True, False], nullable=[True, False], conditional=[True, False], choices=[True, False, False, True], exclusive=[True, False], formats=[True, False] * 7, too_deep="SecurityError", plain_ignores=True, enforced=["ValidationError", 1])
def schema_keywords(store: Store) -> dict[str, Any]:
    def ok(value: Any, rules: dict, extended: bool = True) -> bool:
        store.set("x", value)
        return store.validate("x", rules, extended)["valid"]

    each = lambda rules, *found: [ok(v, rules) for v in found]
    formats = [("url", "https://a.b/c", "no"), ("uri", "urn:a:b", "no scheme"), ("ipv4", "1.2.3.4", "1.2.3.400"), ("ipv6", "::1", "1.2.3"), ("date", "2024-02-29", "2024-13-01"), ("date-time", "2024-01-01T00:00:00Z", "2024"), ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123")]
    out = {
        "pattern": [ok("a.c", {"pattern": "."}, False), ok("abc", {"pattern": "a.c"}, False)], "email": [ok("a@b.c", {"format": "email"}, False), ok("ab", {"format": "email"}, False), ok("ab", {"format": "strange"}, False)], "multiple": each({"multipleOf": 3}, 9, 10),
        "items": each({"minItems": 1, "maxItems": 2}, [1], [], [1, 2, 3]), "unique": each({"uniqueItems": True}, [1, 2], [1, 1]), "extra": each({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1}, {"b": 1}), "const": each({"const": 5}, 5, 6),
        "nullable": [ok(None, {"type": "string", "nullable": True}), ok(None, {"type": "string"})], "conditional": each({"if": {"type": "string"}, "then": {"minLength": 3}, "else": {"type": "integer"}}, "abc", "ab"),
        "choices": [ok(1, {"anyOf": [{"type": "string"}, {"type": "integer"}]}), ok(1, {"oneOf": [{"type": "number"}, {"type": "integer"}]}), ok(1, {"allOf": [{"type": "integer"}, {"min": 2}]}), ok(1, {"not": {"type": "string"}})], "exclusive": each({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, 2, 3),
        "formats": [ok(v, {"format": f}) for f, *pair in formats for v in pair], "too_deep": refused(lambda: ok(NESTED, DEEP, False)), "plain_ignores": ok(10, {"multipleOf": 3}, False),
    }
    strict = Store(store.spark, f"{store.main.parent}/strict.json", enforce={"users": {"type": ["array", "null"], "items": {"required": ["id"]}}})
    strict.set("users", [{"id": 1}])
    out["enforced"] = [refused(lambda: strict.push("users", {"no": 1})), strict.count("users")]
    return out


@session("store_indexes", made=[True, True, 2], looked_up={"sql": "SELECT n_name FROM nation WHERE n_nationkey = 3"}, none=[None, None], dropped=[True, True, False], all_dropped=2, vector=[True, False, 1], dimension="ValueError", cleared=[])
def store_indexes(store: Store) -> dict[str, Any]:
    out: dict[str, Any] = {"made": [store.create_index("nations", "n_nationkey"), store.create_index("nations", "n_regionkey", "n_name"), store.stats()["active_indexes"]]}
    out["looked_up"] = store.index_lookup("nations", "n_nationkey", "3")[0]["n_name"]
    out["none"] = [store.index_lookup("nations", "n_nationkey", 999), store.index_lookup("nations", "n_name", "x")]
    out["dropped"] = [store.drop_index("nations.n_nationkey"), store.drop_index("nations"), store.drop_index("nations")]
    store.set("items", [{"id": 1, "e": [1, 0, 0]}, {"id": 2, "e": [0, 1, 0]}])
    out["vector"] = [store.create_vector_index("items", "e", 3), store.create_vector_index("items", "e", 2), store.vector_search("items", "e", [1, 0, 0], 1)[0]["item"]["id"]]
    out["dimension"] = refused(lambda: store.vector_search("items", "e", [1], 1))
    store.create_index("nations", "n_name")
    out["all_dropped"] = store.drop_all_indexes()
    store.create_index("nations", "n_name")
    store.set("x", 1)  # a write clears them
    out["cleared"] = store.list_indexes()
    return out


@dataclass
class Area:
    name: str
    tags: list[str] = field(default_factory=list)


@dataclass
class Nation:
    n_nationkey: int
    n_name: str
    area: Area | None
    known: bool = True


@session(
    "hydration", one={"sql": FIRST.format("json_object('area', NULL, 'known', json('true'), 'n_name', n_name, 'n_nationkey', n_nationkey)")}, all={"sql": "SELECT count(*) FROM nation"}, stream={"sql": "SELECT to_json(list(n_nationkey ORDER BY n_nationkey)) FROM nation WHERE n_regionkey = 1"}, none=None,
    nested={"name": "a", "tags": ["x"]}, ignored={"area": {"tags": []}, "known": True, "n_nationkey": 1}, strict=["HydrationError"] * 4, lenient={"area": None, "known": False, "n_name": "5", "n_nationkey": 12}, unknown="HydrationError", camel="firstName", pushed=[True, "Z", True], typed={"sql": f"SELECT {NAMES} FROM nation"},
)
def hydration(store: Store) -> dict[str, Any]:
    plain, typed = Hydrator(), HydratedStore(store)
    loose = Hydrator(HydratorOptions(coercion=Coercion.LENIENT, unknown="raise", key=camel_case))
    bad = ({"n_nationkey": "1", "n_name": "A"}, {"n_nationkey": 1}, {"n_nationkey": None, "n_name": "x"}, {"n_nationkey": 1, "n_name": "x", "area": 5})
    out = {
        "one": plain.dehydrate(typed.find_one_as("nations", {"n_nationkey": 0}, Nation)), "all": len(typed.find_in_as("nations", {}, Nation)), "stream": [n.n_nationkey for n in typed.stream_as("/nations", Nation, {"n_regionkey": 1})], "none": typed.find_one_as("nations", {"n_nationkey": 999}, Nation),
        "nested": plain.dehydrate(plain.hydrate({"n_nationkey": 1, "n_name": "x", "area": {"name": "a", "tags": ["x"]}}, Nation).area), "ignored": plain.dehydrate(Nation(1, "x", Area("a")), ("n_name", "name")), "strict": [refused(lambda b=b: plain.hydrate(b, Nation)) for b in bad],
        "lenient": plain.dehydrate(Hydrator(HydratorOptions(coercion=Coercion.LENIENT)).hydrate({"n_nationkey": "12abc", "n_name": 5, "known": "0"}, Nation)), "unknown": refused(lambda: loose.hydrate({"x_y": 1}, Area)), "camel": camel_case("first_name"),
        "typed": [r["object"]["n_name"] for r in typed_items(store.collection("nations").df, Nation).orderBy("_pos").collect()],
    }
    n = store.count("nations")
    out["pushed"] = [typed.push_object("nations", Nation(99, "Z", None)), store.get(f"nations.{n}.n_name"), typed.set_object("one", Area("q")) and store.get("one.name") == "q"]
    return out
