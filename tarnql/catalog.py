"""The engine's own queries, one per operator and rule, and the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Aggregate, AggregateKind, Comparator, Comparison, Relation
from .operators.aggregate import aggregate_by_names
from .operators.filter import conjunction, filtered, predicate
from .operators.order import limited, ordered, ordered_by_name
from .operators.project import project, project_by_names
from .plans.planner import sql
from .scratch import shared_folder
from .sources.csv import scan
from .sources.zonemap import pruned_scan, table_zone_map

Callback = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(text: str) -> Callback:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql(spark, text, lambda name: _table(spark, sf_dir, name))

    return run


def _on(name: str, build: Callable[[Relation], Relation]) -> Callback:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Relation.of(_table(spark, sf_dir, name))).frame()

    return run


def _conditions(rel: Relation) -> list:
    """l_quantity >= 10, l_discount > 0.05 and l_returnflag = 'A'."""
    found = [("l_quantity", Comparator.GTE, 10), ("l_discount", Comparator.GT, 0.05), ("l_returnflag", Comparator.EQ, "A")]
    return [predicate(rel, Comparison(rel.resolve(n), op, v)) for n, op, v in found]


def _csv(spark: SparkSession, df: DataFrame, parts: int | None = None, by: str | None = None) -> str:
    """Writes a table as CSV to the shared folder and returns the path."""
    path = shared_folder(spark, "csv")
    dealt = df.repartitionByRange(parts, by) if by else df.coalesce(1)
    dealt.write.options(header=True, quote='"', escape='"', emptyValue="").csv(path)
    return path


def csv_scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, _csv(spark, _table(spark, sf_dir, "nation").orderBy("n_nationkey"))).frame()


def csv_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that the first row gives the columns of part."""
    rel = scan(spark, _csv(spark, _table(spark, sf_dir, "part").orderBy("p_partkey")))
    return spark.createDataFrame(list(zip(rel.names, [k.value for k in rel.kinds], strict=True)), "column_name string, kind string")


def csv_parse_failure_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer column in which every third key from the second on is dirty text."""
    dirty = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("x"), F.col("p_size"))).otherwise(F.col("p_size").cast("string"))
    part = _table(spark, sf_dir, "part").select("p_partkey", dirty.alias("v")).orderBy(F.col("v").startswith("x"), "p_partkey")
    return scan(spark, _csv(spark, part)).frame()


def zonemap_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_zone_map(_table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"])


def zonemap_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-partitioned CSV files; those whose zone map excludes a match are never opened again."""
    path = _csv(spark, _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), 8, "l_orderkey")
    return pruned_scan(spark, path, [("l_orderkey", Comparator.LT, 100)]).frame()


QUERIES: dict[str, Callback] = {
    "scan_all": _sql("SELECT * FROM nation"),
    "filter_eq_str": _sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"),
    "filter_eq_int": _sql("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber = 1"),
    "filter_lt": _sql("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5"),
    "filter_gt": _sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000"),
    "filter_lte": _sql("SELECT p_partkey, p_size FROM part WHERE p_size <= 5"),
    "filter_gte": _sql("SELECT p_partkey, p_size FROM part WHERE p_size >= 45"),
    "filter_neq": _sql("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0"),
    "filter_and_parens": _sql("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE (l_quantity >= 10 AND l_discount > 0.05) AND l_returnflag = 'A'"),
    "filter_and_api": _on("lineitem", lambda r: project_by_names(filtered(r, conjunction(_conditions(r))), ["l_orderkey", "l_partkey", "l_quantity"])),
    "filter_int_col_float_lit": _sql("SELECT p_partkey, p_size FROM part WHERE p_size > 25.7"),
    "filter_int_col_str_lit": _sql("SELECT p_partkey, p_size FROM part WHERE p_size != '5'"),
    "filter_str_col_num_lit": _sql("SELECT p_partkey, p_brand FROM part WHERE p_brand > 5"),
    "filter_custom_predicate": _on("part", lambda r: project_by_names(filtered(r, (r.col(4) < 3) | (r.col(4) > 48)), ["p_partkey", "p_size"])),
    "project_reorder_dup": _on("nation", lambda r: project(r, [1, 0, 1], ["n_name_1", "n_nationkey", "n_name_2"])),
    "project_by_names": _on("nation", lambda r: project_by_names(r, ["n_name", "n_nationkey"])),
    "project_null_fill": lambda spark, d: project_by_names(Relation.of(_table(spark, d, "nation")), ["n_name", "missing"]).frame().toDF("n_name", "missing").withColumn("missing", F.col("missing").cast("string")),
    "agg_count_star": _sql("SELECT COUNT(*) AS n FROM lineitem"),
    "agg_count_col": _sql("SELECT COUNT(value) AS n FROM events"),
    "agg_sum": _sql("SELECT SUM(l_linenumber) AS s FROM lineitem"),
    "agg_min_max": _sql("SELECT MIN(p_size) AS mn, MAX(p_size) AS mx FROM part"),
    "agg_avg": _sql("SELECT AVG(l_linenumber) AS a FROM lineitem"),
    "agg_string_column": _sql("SELECT SUM(p_brand) AS s, MIN(p_brand) AS mn, MAX(p_brand) AS mx, AVG(p_brand) AS a, COUNT(p_brand) AS c FROM part"),
    "agg_empty_input": _sql("SELECT COUNT(*) AS c, SUM(l_quantity) AS s, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx, AVG(l_quantity) AS a FROM lineitem WHERE l_quantity < 0"),
    "agg_default_names": _sql("SELECT COUNT(*), SUM(p_size) FROM part"),
    "groupby_single": _sql("SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag"),
    "groupby_by_names": _on("lineitem", lambda r: aggregate_by_names(r, ["l_returnflag"], [Aggregate(AggregateKind.COUNT, alias="n"), Aggregate(AggregateKind.SUM, r.resolve("l_linenumber"), "s")])),
    "groupby_multi_all_aggs": _sql("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, MIN(l_quantity) AS min_qty, MAX(l_quantity) AS max_qty, AVG(l_quantity) AS avg_qty FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "groupby_filtered": _sql("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderpriority"),
    "groupby_keys_only": _sql("SELECT p_brand FROM part GROUP BY p_brand"),
    "groupby_select_order_ignored": _sql("SELECT COUNT(*) AS n, p_brand FROM part GROUP BY p_brand"),
    "groupby_order_limit": _sql("SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY p_brand LIMIT 5"),
    "sort_asc_int": _sql("SELECT * FROM customer ORDER BY c_custkey"),
    "sort_desc_float": _sql("SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC"),
    "sort_string": _on("customer", lambda r: project_by_names(ordered(r, [(r.resolve("c_name"), False)]), ["c_name"])),
    "sort_by_name": _on("customer", lambda r: project_by_names(ordered_by_name(r, "c_name"), ["c_name"])),
    "topk_hidden_key": _sql("SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 10"),
    "limit_zero": _sql("SELECT * FROM nation LIMIT 0"),
    "limit_over_count": _sql("SELECT * FROM region LIMIT 1000"),
    "limit_offset": _on("nation", lambda r: limited(ordered_by_name(r, "n_nationkey"), 5, 3)),
    "zonemap_lineitem": zonemap_lineitem,
    "zonemap_pruned_scan": zonemap_pruned_scan,
    "csv_scan_roundtrip": csv_scan_roundtrip,
    "csv_type_inference": csv_type_inference,
    "csv_parse_failure_zero": csv_parse_failure_zero,
    "flagship": _sql("SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, AVG(l_extendedprice) AS avg_price FROM lineitem WHERE l_quantity >= 10 AND l_discount > 0.02 GROUP BY l_returnflag ORDER BY sum_qty DESC LIMIT 10"),
}

_AND = "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE (l_quantity >= 10 AND l_discount > 0.05) AND l_returnflag = 'A'"
_SINGLE = "SELECT l_returnflag, COUNT(*) AS n, SUM(CAST(l_linenumber AS DOUBLE)) AS s FROM lineitem GROUP BY l_returnflag"
_ZONE = "SELECT '{c}' AS column_name, CAST(MIN({c}) AS BIGINT) AS min_value, CAST(MAX({c}) AS BIGINT) AS max_value, COUNT(*) AS row_count FROM lineitem"

ORACLES: dict[str, str] = {
    "scan_all": "SELECT * FROM nation",
    "filter_eq_str": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "filter_eq_int": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber = 1",
    "filter_lt": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5",
    "filter_gt": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000",
    "filter_lte": "SELECT p_partkey, p_size FROM part WHERE p_size <= 5",
    "filter_gte": "SELECT p_partkey, p_size FROM part WHERE p_size >= 45",
    "filter_neq": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0",
    "filter_and_parens": _AND,
    "filter_and_api": _AND,
    "filter_int_col_float_lit": "SELECT p_partkey, p_size FROM part WHERE p_size > CAST(TRUNC(25.7) AS BIGINT)",
    "filter_int_col_str_lit": "SELECT p_partkey, p_size FROM part WHERE p_size <> 5 AND FALSE",
    "filter_str_col_num_lit": "SELECT p_partkey, p_brand FROM part WHERE p_brand > '5'",
    "filter_custom_predicate": "SELECT p_partkey, p_size FROM part WHERE p_size < 3 OR p_size > 48",
    "project_reorder_dup": "SELECT n_name AS n_name_1, n_nationkey, n_name AS n_name_2 FROM nation",
    "project_by_names": "SELECT n_name, n_nationkey FROM nation",
    "project_null_fill": "SELECT n_name, CAST(NULL AS VARCHAR) AS missing FROM nation",
    "agg_count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "agg_count_col": "SELECT COUNT(*) AS n FROM events",
    "agg_sum": "SELECT COALESCE(SUM(CAST(l_linenumber AS DOUBLE)), 0) AS s FROM lineitem",
    "agg_min_max": "SELECT CAST(MIN(p_size) AS DOUBLE) AS mn, CAST(MAX(p_size) AS DOUBLE) AS mx FROM part",
    "agg_avg": "SELECT SUM(CAST(l_linenumber AS DOUBLE)) / COUNT(*) AS a FROM lineitem",
    "agg_string_column": "SELECT CAST(0 AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS mn, CAST(NULL AS DOUBLE) AS mx, CAST(0 AS DOUBLE) AS a, COUNT(*) AS c FROM part",
    "agg_empty_input": "SELECT COUNT(*) AS c, COALESCE(SUM(l_quantity), 0) AS s, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx, AVG(l_quantity) AS a FROM lineitem WHERE l_quantity < 0",
    "agg_default_names": 'SELECT COUNT(*) AS "COUNT(*)", CAST(SUM(p_size) AS DOUBLE) AS "SUM(p_size)" FROM part',
    "groupby_single": _SINGLE,
    "groupby_by_names": _SINGLE,
    "groupby_multi_all_aggs": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, MIN(l_quantity) AS min_qty, MAX(l_quantity) AS max_qty, AVG(l_quantity) AS avg_qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "groupby_filtered": "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderpriority",
    "groupby_keys_only": "SELECT DISTINCT p_brand FROM part",
    "groupby_select_order_ignored": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand",
    "groupby_order_limit": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY p_brand LIMIT 5",
    "sort_asc_int": "SELECT * FROM customer ORDER BY c_custkey",
    "sort_desc_float": "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC",
    "sort_string": "SELECT c_name FROM customer ORDER BY c_name",
    "sort_by_name": "SELECT c_name FROM customer ORDER BY c_name",
    "topk_hidden_key": "SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 10",
    "limit_zero": "SELECT * FROM nation LIMIT 0",
    "limit_over_count": "SELECT * FROM region LIMIT 1000",
    "limit_offset": "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3",
    "zonemap_lineitem": " UNION ALL ".join(_ZONE.format(c=c) for c in ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")),
    "zonemap_pruned_scan": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_orderkey < 100",
    "csv_scan_roundtrip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "csv_type_inference": "SELECT * FROM (VALUES ('p_partkey', 'Int'), ('p_name', 'String'), ('p_brand', 'String'), ('p_type', 'String'), ('p_size', 'Int'), ('p_retailprice', 'Float')) t(column_name, kind)",
    "csv_parse_failure_zero": "SELECT p_partkey, COALESCE(TRY_CAST(CASE WHEN p_partkey % 3 = 2 THEN 'x' || p_size ELSE CAST(p_size AS VARCHAR) END AS BIGINT), 0) AS v FROM part",
    "flagship": "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, AVG(l_extendedprice) AS avg_price FROM lineitem WHERE l_quantity >= 10 AND l_discount > 0.02 GROUP BY l_returnflag ORDER BY sum_qty DESC LIMIT 10",
}
