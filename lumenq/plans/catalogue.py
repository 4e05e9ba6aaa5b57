"""The registered queries of the engine's own operators, each through its front end, and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.collection import Collection
from lumenq.functions.fields import VariantResolver
from lumenq.operators import jsonpath

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {
    "events": ["event_id"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"], "part": ["p_partkey"],
    "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "embeddings": ["vec_id"], "documents": ["doc_id"],
}
THIRDS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE {0} END AS {1} FROM events"


def table(spark: SparkSession, sf_dir: str, name: str, **options) -> Collection:
    return Collection.of_table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS.get(name), name, **options)


def with_gaps(spark: SparkSession, sf_dir: str, column: str, name: str) -> Collection:
    """Events whose field is missing in every third."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    gap = F.when(F.col("event_id") % 3 != 0, F.col(column)).alias(name)
    return Collection.of_table(df.select("event_id", gap), "event_id", "events")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def take(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return take


def _found(name: str, source: str, condition: dict, columns: list[str], sql: str) -> None:
    register(name, sql)(lambda spark, d: table(spark, d, source).find(condition).select(*columns))


# ---- match documents ---------------------------------------------------------------------------------------------

_found("find_eq", "events", {"event_type": "purchase"}, ["event_id", "event_type", "value"], "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase'")
_found("find_op_eq", "events", {"event_type": {"$eq": "click"}}, ["event_id"], "SELECT event_id FROM events WHERE event_type = 'click'")
_found("find_implicit_and", "orders", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_found("find_ne", "customer", {"c_mktsegment": {"$ne": "BUILDING"}}, ["c_custkey", "c_mktsegment"], "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
_found("find_gt", "lineitem", {"l_quantity": {"$gt": 45}}, ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
_found("find_gte_lte_range", "orders", {"o_totalprice": {"$gte": 100000, "$lte": 200000}}, ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000")
_found("find_in", "part", {"p_type": {"$in": ["ECONOMY", "PROMO"]}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO')")
_found("find_nin", "part", {"p_type": {"$nin": ["ECONOMY", "PROMO"]}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE NOT (p_type IN ('ECONOMY', 'PROMO'))")
_found("find_regex", "part", {"p_brand": {"$regex": "^Brand#1[0-9]$"}}, ["p_partkey", "p_brand"], "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#1[0-9]$')")
_found("find_contains", "part", {"p_name": {"$contains": "bolt"}}, ["p_partkey", "p_name"], "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'bolt')")
_found("find_starts_with", "part", {"p_name": {"$startsWith": "large"}}, ["p_partkey", "p_name"], "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'large')")
_found("find_ends_with", "part", {"p_name": {"$endsWith": "widget"}}, ["p_partkey", "p_name"], "SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 'widget')")
_found("find_or", "orders", {"$or": [{"o_orderpriority": "1-URGENT"}, {"o_totalprice": {"$gt": 400000}}]}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 400000")
_found("find_and_nested", "orders", {"$and": [{"$or": [{"o_orderstatus": "O"}, {"o_orderstatus": "P"}]}, {"o_totalprice": {"$gte": 50000}}]}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderstatus = 'P') AND o_totalprice >= 50000")
_found("find_nor", "orders", {"$nor": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 300000}}]}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 300000)")
_found("find_not", "orders", {"$not": {"o_orderstatus": "F"}}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")


def _gapped(name: str, column: str, alias: str, condition: dict, sql: str) -> None:
    register(name, f"SELECT event_id FROM ({THIRDS.format(column, alias)}) WHERE {sql}")(lambda spark, d: with_gaps(spark, d, column, alias).find(condition).select("event_id"))


_gapped("find_lt_missing_matches", "value", "v", {"v": {"$lt": 50}}, "v IS NULL OR v < 50")
_gapped("find_lte_missing_matches", "value", "v", {"v": {"$lte": 20}}, "v IS NULL OR v <= 20")
_gapped("find_ne_missing_matches", "event_type", "t", {"t": {"$ne": "error"}}, "t IS DISTINCT FROM 'error'")
_gapped("find_in_null", "event_type", "t", {"t": {"$in": ["click", None]}}, "t IN ('click') OR t IS NULL")
_gapped("find_eq_null", "event_type", "t", {"t": None}, "t IS NULL")
_gapped("find_exists", "value", "v", {"v": {"$exists": True}}, "v IS NOT NULL")
_gapped("find_not_exists", "value", "v", {"v": {"$exists": False}}, "v IS NULL")
_gapped("find_not_gt_missing", "value", "v", {"$not": {"v": {"$gt": 50}}}, "NOT (v IS NOT NULL AND v > 50)")


@register("find_nested_path", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def find_nested_path(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.try_parse_json("props").alias("item"))
    return Collection(df, VariantResolver("item"), ["event_id"]).find({"k": {"$gte": 50}}, ordered=False).select("event_id")


@register("find_one", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 1")
def find_one(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").find_one({"event_type": "error"}).select("event_id", "event_type", "value")


# ---- query specifications ----------------------------------------------------------------------------------------


def _spec(name: str, source: str, spec: dict, sql: str, columns: list[str] | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = table(spark, d, source).query(spec)
        return out.select(*columns) if columns else out

    register(name, sql)(run)


BENCH = {
    "where": [{"field": "value", "op": ">", "value": 25}, {"field": "event_type", "op": "!=", "value": "error"}],
    "order_by": {"field": "value", "direction": "desc"},
    "limit": 10,
    "select": ["event_id", "event_type", "value"],
}
_spec("fluent_bench", "events", BENCH, "SELECT event_id, event_type, value FROM events WHERE value > 25 AND event_type IS DISTINCT FROM 'error' ORDER BY value DESC, event_id LIMIT 10")
_spec("fluent_eq", "orders", {"where": [{"field": "o_orderstatus", "value": "P"}], "select": ["o_orderkey"]}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
_spec("fluent_between", "lineitem", {"where": [{"field": "l_quantity", "op": "between", "value": [10, 12]}]}, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", ["l_orderkey", "l_linenumber"])
_spec("fluent_in", "customer", {"where": [{"field": "c_mktsegment", "op": "in", "value": ["BUILDING", "MACHINERY"]}], "select": ["c_custkey"]}, "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_spec("fluent_text", "part", {"where": [{"field": "p_name", "op": "contains", "value": "a"}, {"field": "p_name", "op": "startsWith", "value": "s"}, {"field": "p_name", "op": "endsWith", "value": "r"}], "select": ["p_partkey", "p_name"]}, "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND starts_with(p_name, 's') AND ends_with(p_name, 'r')")
_spec("fluent_offset_page", "customer", {"order_by": {"field": "c_name"}, "skip": 40, "limit": 20, "select": ["c_custkey", "c_name"]}, "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
_spec("fluent_select_single", "customer", {"where": [{"field": "c_acctbal", "op": ">=", "value": 0}], "select": ["c_name"]}, "SELECT c_name FROM customer WHERE c_acctbal >= 0")
_spec("fluent_except", "customer", {"except": ["c_nationkey", "c_acctbal"]}, "SELECT c_custkey, c_name, c_mktsegment FROM customer")


@register("fluent_between_missing_is_zero", f"SELECT event_id FROM ({THIRDS.format('value', 'v')}) WHERE COALESCE(v, 0) BETWEEN 0 AND 10")
def fluent_between_missing(spark: SparkSession, d: str) -> DataFrame:
    return with_gaps(spark, d, "value", "v").query({"where": [{"field": "v", "op": "between", "value": [0, 10]}], "select": ["event_id"]})


# ---- SQL ---------------------------------------------------------------------------------------------------------


def _sql(name: str, source: str, text: str, oracle: str) -> None:
    register(name, oracle)(lambda spark, d: table(spark, d, source).sql(text))


_sql("sql_select_where_order", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC LIMIT 25 OFFSET 5", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
_sql("sql_range_keeps_all", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
_sql("sql_ne", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
_sql("sql_like_contains", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ol%'", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ol')")
_sql("sql_like_prefix", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'co%'", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'co')")
_sql("sql_like_suffix", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%lt'", "SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 'lt')")
_sql("sql_in", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
_sql("sql_star", "nation", "SELECT * FROM nation", "SELECT * FROM nation")
_sql("sql_insert", "region", "INSERT INTO region (r_regionkey, r_name) VALUES (99, 'ATLANTIS')", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
_sql("sql_update", "nation", "UPDATE nation SET n_name = 'RENAMED' WHERE n_regionkey = 1", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation")
_sql("sql_delete", "nation", "DELETE FROM nation WHERE n_regionkey = 2", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT (n_regionkey = 2)")


# ---- aggregates --------------------------------------------------------------------------------------------------


@register("agg_sum", "SELECT round(sum(o_totalprice), 2) AS sum FROM orders")
def agg_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").aggregate("o_totalprice", "sum").select(F.round("sum", 2).alias("sum"))


@register("agg_avg", "SELECT round(avg(l_quantity), 6) AS avg FROM lineitem")
def agg_avg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").aggregate("l_quantity", "avg").select(F.round("avg", 6).alias("avg"))


@register("agg_min_max", "SELECT min(value) AS min, max(value) AS max FROM events")
def agg_min_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").aggregate_many({"min": "value", "max": "value"})


@register("agg_count_all_items", f"SELECT CASE WHEN count(v) > 0 THEN count(*) END AS count FROM ({THIRDS.format('value', 'v')})")
def agg_count(spark: SparkSession, d: str) -> DataFrame:
    return with_gaps(spark, d, "value", "v").aggregate("v", "count")


@register("agg_no_numbers", "SELECT CAST(NULL AS DOUBLE) AS sum FROM (SELECT 1)")
def agg_none(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").aggregate("event_type", "sum")


@register("group_by_sizes", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type")
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").group_sizes("event_type")


@register("group_by_null_key", f"SELECT COALESCE(t, 'null') AS key, count(*) AS n FROM ({THIRDS.format('event_type', 't')}) GROUP BY 1")
def group_null(spark: SparkSession, d: str) -> DataFrame:
    return with_gaps(spark, d, "event_type", "t").group_sizes("t")


@register("group_by_items", "SELECT CAST(n_regionkey AS VARCHAR) AS key, string_agg(n_name, ',' ORDER BY n_nationkey) AS items FROM nation GROUP BY n_regionkey")
def group_items(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "nation").group_by("n_regionkey")
    return groups.select("key", F.array_join(F.transform("items", lambda i: i["n_name"]), ",").alias("items"))


@register("group_aggregate", "SELECT o_orderstatus AS key, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most FROM orders GROUP BY 1")
def group_aggregated(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").group_aggregate("o_orderstatus", {"total": ("o_totalprice", "sum"), "most": ("o_totalprice", "max")})
    return out.withColumn("total", F.round("total", 2))


# ---- collection methods ------------------------------------------------------------------------------------------


@register("pluck_many", "SELECT s_name, s_acctbal FROM supplier")
def pluck_many(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").pluck(["s_name", "s_acctbal"])


@register("column_drop_missing", f"SELECT v FROM ({THIRDS.format('value', 'v')}) WHERE v IS NOT NULL")
def column_drop_missing(spark: SparkSession, d: str) -> DataFrame:
    return with_gaps(spark, d, "value", "v").column("v")


@register("chunk", "SELECT p_partkey // 50 AS chunk_id, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members FROM part GROUP BY 1")
def chunked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").chunk(50, "p_partkey", F.col("p_partkey")).withColumn("members", F.array_join("members", ","))


@register("implode", "SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) AS joined FROM nation")
def imploded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").implode("n_name", ", ")


@register("search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(lang), 'license') OR contains(lower(source), 'license') OR contains(CAST(doc_id AS VARCHAR), 'license') OR contains(CAST(n_chars AS VARCHAR), 'license')")
def searched(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").search("LICENSE").select("doc_id")


@register("search_variant", "SELECT event_id FROM events WHERE contains(CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR), '7')")
def searched_variant(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.try_parse_json("props").alias("item"))
    return Collection(df, VariantResolver("item"), ["event_id"]).search("7").select("event_id")


# ---- paths -------------------------------------------------------------------------------------------------------


def _props(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.try_parse_json("props").alias("v"))


@register("object_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    from lumenq.operators.items import keys

    return _props(spark, d).select(F.explode(keys(F.col("v"))).alias("key")).distinct()


@register("jsonpath_slice", "SELECT user_id, unnest(ids[2:9:3]) AS event_id FROM (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id)")
def jsonpath_slice(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    boxed = ids.select("user_id", F.to_variant_object(F.struct("ids")).alias("v"))
    return jsonpath.nodes(boxed, "$.ids[1:9:3]").select("user_id", F.try_variant_get("v", "$", "bigint").alias("event_id"))


@register("jsonpath_key", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsonpath_key(spark: SparkSession, d: str) -> DataFrame:
    return jsonpath.nodes(_props(spark, d), "$.k").select("event_id", F.try_variant_get("v", "$", "bigint").alias("k"))


@register("jsonpath_wildcard_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsonpath_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return jsonpath.nodes(_props(spark, d), "$.*").select("event_id", F.try_variant_get("v", "$", "bigint").alias("k"))


@register("jsonpath_recursive", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsonpath_recursive(spark: SparkSession, d: str) -> DataFrame:
    return jsonpath.nodes(_props(spark, d), "$..k").select("event_id", F.try_variant_get("v", "$", "bigint").alias("k"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.to_variant_object("embedding").alias("v"))


@register("jsonpath_negative_index", "SELECT vec_id, embedding[-1] AS last FROM embeddings")
def jsonpath_negative(spark: SparkSession, d: str) -> DataFrame:
    return jsonpath.nodes(_vectors(spark, d), "[-1]").select("vec_id", F.try_variant_get("v", "$", "float").alias("last"))


@register("jsonpath_slice_elements", "SELECT vec_id, unnest(embedding[3:9:3]) AS x FROM embeddings")
def jsonpath_slice_elements(spark: SparkSession, d: str) -> DataFrame:
    return jsonpath.nodes(_vectors(spark, d), "[2:9:3]").select("vec_id", F.try_variant_get("v", "$", "float").alias("x"))


# ---- streams -----------------------------------------------------------------------------------------------------


@register("stream_filter_page", "SELECT event_id, user_id FROM events WHERE user_id >= 5 ORDER BY event_id LIMIT 50 OFFSET 10")
def stream_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").stream({"user_id": {"$gte": 5}}, limit=50, skip=10, select=["event_id", "user_id"])


@register("stream_count", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def stream_counted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").stream_count({"event_type": "click"})


@register("stream_aggregate_sum", "SELECT COALESCE(round(sum(value), 2), 0.0) AS sum FROM events WHERE event_type = 'purchase'")
def stream_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").stream_aggregate("sum", "value", {"event_type": "purchase"}).select(F.round("sum", 2).alias("sum"))


@register("stream_aggregate_empty", "SELECT COALESCE(sum(value), 0.0) AS sum FROM events WHERE event_type = 'no-such-type'")
def stream_empty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").stream_aggregate("sum", "value", {"event_type": "no-such-type"})


# ---- vectors -----------------------------------------------------------------------------------------------------

_FIRST = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _nearest(spark: SparkSession, d: str, metric: str) -> DataFrame:
    c = table(spark, d, "embeddings")
    query = c.find_one({"vec_id": 0}).select("embedding").first()[0]
    return c.vector_search("embedding", query, 10, metric).select("vec_id", F.round(F.col("score").cast("double"), 3).alias("score"))


register("vector_cosine_topk", f"SELECT vec_id, round(CAST(list_cosine_similarity(embedding, {_FIRST}) AS DOUBLE), 3) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding, {_FIRST}) DESC, vec_id LIMIT 10")(lambda spark, d: _nearest(spark, d, "cosine"))
register("vector_l2_topk", f"SELECT vec_id, round(CAST(list_distance(embedding, {_FIRST}) AS DOUBLE), 3) AS score FROM embeddings ORDER BY list_distance(embedding, {_FIRST}), vec_id LIMIT 10")(lambda spark, d: _nearest(spark, d, "l2"))
register("vector_dot_topk", f"SELECT vec_id, round(CAST(list_inner_product(embedding, {_FIRST}) AS DOUBLE), 3) AS score FROM embeddings ORDER BY list_inner_product(embedding, {_FIRST}) DESC, vec_id LIMIT 10")(lambda spark, d: _nearest(spark, d, "dot"))


# ---- validation, indexes, changes --------------------------------------------------------------------------------

CUSTOMER_RULES = {
    "type": "object",
    "required": ["c_custkey"],
    "properties": {
        "c_acctbal": {"type": "number", "min": 0, "max": 9000},
        "c_name": {"type": "string", "minLength": 3},
        "c_mktsegment": {"enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]},
    },
}


@register("validate_collection", "SELECT count(*) AS total_items, count(*) FILTER (WHERE bad) AS invalid_items, count(*) FILTER (WHERE NOT bad) AS valid_items FROM (SELECT (c_acctbal < 0 OR c_acctbal > 9000 OR strlen(c_name) < 3 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')) AS bad FROM customer)")
def validated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").validate(CUSTOMER_RULES).select("total_items", "invalid_items", "valid_items")


@register("validate_errors", "SELECT c_custkey, path, count(*) AS n FROM (SELECT c_custkey, 'c_acctbal' AS path FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')) GROUP BY ALL")
def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "customer").invalid(CUSTOMER_RULES).select("c_custkey", F.explode("errors").alias("e"))
    return bad.groupBy("c_custkey", F.col("e.path").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@register("index_lookup", "SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) = '85'")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").create_index("o_custkey").index_lookup("o_custkey", "85").select("o_orderkey")


@register("list_indexes_stats", "SELECT 'orders' AS collection, 'single' AS type, 'o_custkey' AS field, count(DISTINCT o_custkey) AS unique_values, count(*) AS total_entries FROM orders")
def list_indexes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").create_index("o_custkey").list_indexes().drop("dimension", "metric")


@register("compound_index_stats", "SELECT count(DISTINCT o_orderstatus || '|' || o_orderpriority) AS unique_values, count(*) AS total_entries FROM orders")
def compound_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").create_index("o_orderstatus", "o_orderpriority").list_indexes().select("unique_values", "total_entries")


@register("increment", "SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) + 1 AS s_nationkey FROM supplier")
def increment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").incremented("s_nationkey").df.select("s_suppkey", "s_nationkey")


# ---- documented operators of the second tier ---------------------------------------------------------------------

_found("tier2_size", "embeddings", {"embedding": {"$size": 64}}, ["vec_id"], "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
_found("tier2_elem_match", "embeddings", {"embedding": {"$elemMatch": {"$gt": 0.25}}}, ["vec_id"], "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.25)) > 0")
_found("tier2_type", "events", {"value": {"$type": "number"}}, ["event_id"], "SELECT event_id FROM events WHERE value IS NOT NULL")
_spec("tier2_or_where", "orders", {"where": [{"field": "o_orderstatus", "op": "==", "value": "P"}], "orWhere": [{"field": "o_totalprice", "op": ">", "value": 400000}], "select": ["o_orderkey"]}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000")
_spec("tier2_not_in", "part", {"where": [{"field": "p_type", "op": "not in", "value": ["ECONOMY", "PROMO"]}], "select": ["p_partkey"]}, "SELECT p_partkey FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')")


@register("tier2_all", "SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY user_id) WHERE list_has_all(types, ['click', 'error'])")
def tier2_all(spark: SparkSession, d: str) -> DataFrame:
    types = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return Collection.of_table(types, "user_id").find({"types": {"$all": ["click", "error"]}}).select("user_id")


@register("tier2_multi_aggregate", "SELECT round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max, count(*) AS count FROM orders")
def tier2_multi(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").aggregate_many({"sum": "o_totalprice", "avg": "o_totalprice", "min": "o_totalprice", "max": "o_totalprice", "count": "o_totalprice"})
    return out.withColumn("sum", F.round("sum", 2)).withColumn("avg", F.round("avg", 4))


@register("tier2_jsonpath_filter", "SELECT vec_id, unnest(list_filter(embedding, lambda x: x > 0.3)) AS x FROM embeddings")
def tier2_filter(spark: SparkSession, d: str) -> DataFrame:
    boxed = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.to_variant_object(F.transform("embedding", lambda x: F.struct(x.cast("double").alias("x")))).alias("v"))
    return jsonpath.nodes(boxed, "[?(@.x > 0.3)].x").select("vec_id", F.try_variant_get("v", "$", "double").cast("float").alias("x"))


from lumenq.plans import sessions  # noqa: E402, F401  registers the sessions with a document store
