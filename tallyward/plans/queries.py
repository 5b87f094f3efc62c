"""Registered queries of the engine's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.functions.sqltext import to_spark
from tallyward.operators import checks
from tallyward.operators.changelog import ChangeLog, step_rows
from tallyward.operators.checks import Replacement
from tallyward.plans import findings
from tallyward.plans.engine import Options, dataset_query, replacements, run_rules
from tallyward.plans.flags import FlagStore
from tallyward.plans.rules import Rule, RuleFile
from tallyward.report.model import review_cells
from tallyward.schema.digest import digest
from tallyward.schema.loader import build_schema_set
from tallyward.schema.run import cast_failures, cast_plan, row_findings, typed
from tallyward.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """A table with a unique key as its row id."""
    return df.withColumn(checks.ROW, F.col(key).cast("long"))


# Assertions


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE o_custkey IS NOT NULL AND n > 1")
def assert_unique(spark, d):
    return checks.assertion_rows(table(spark, d, "orders"), "unique", "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def assert_unique_composite(spark, d):
    hit = to_spark("COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
    rows = checks.matching(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), hit)
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE nullif(lang, 'fr') IS NULL")
def assert_no_nulls(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"))
    return checks.assertion_rows(docs, "no_nulls", "lang").select("doc_id")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '   ' WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS t FROM events) WHERE t IS NULL OR trim(t) = ''")
def assert_not_blank(spark, d):
    kind = F.when(F.col("event_id") % 7 == 0, "   ").when(F.col("event_id") % 11 == 0, None).otherwise(F.col("event_type"))
    return checks.assertion_rows(table(spark, d, "events").select("event_id", kind.alias("t")), "not_blank", "t").select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity IS NOT NULL AND (l_quantity < 5 OR l_quantity > 45.5)")
def assert_in_range(spark, d):
    return checks.assertion_rows(table(spark, d, "lineitem"), "in_range(5, 45.5)", "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')")
def assert_in_enum(spark, d):
    return checks.assertion_rows(table(spark, d, "orders"), "in_enum('F', 'O')", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query(r"SELECT c_custkey, c_name FROM customer WHERE c_name IS NOT NULL AND NOT regexp_full_match(c_name, 'Customer#0*[1-9]\d?\d?')")
def assert_match_regex(spark, d):
    return checks.assertion_rows(table(spark, d, "customer"), r"match_regex('Customer#0*[1-9]\d?\d?')", "c_name").select("c_custkey", "c_name")


def _monotonic(direction: str, cmp: str) -> None:
    def run(spark, d):
        tens = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") / 10).alias("tens"))  # has ties
        rows = checks.assertion_rows(tens, f"monotonic({direction}, order_by=event_id, partition_by=user_id)", "tens")
        return rows.select("event_id", "user_id")

    run.__name__ = f"assert_monotonic_{direction}"
    query(f"SELECT event_id, user_id FROM (SELECT *, lag(tens) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT *, floor(value / 10) AS tens FROM events)) WHERE tens {cmp} before")(run)


for _direction, _cmp in (("increasing", "<"), ("strict_increasing", "<="), ("decreasing", ">"), ("strict_decreasing", ">=")):
    _monotonic(_direction, _cmp)


@query("SELECT o_orderkey FROM (SELECT *, lag(o_totalprice) OVER (ORDER BY rn) AS before FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)) WHERE o_totalprice < before")
def assert_monotonic_by_row(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    keys = orders.orderBy("o_orderkey")
    from tallyward.sources.dataset import with_row_ids

    return checks.assertion_rows(with_row_ids(keys), "monotonic(increasing)", "o_totalprice").select("o_orderkey")


@query("SELECT count(DISTINCT p_brand) AS n FROM part")
def assert_count_distinct(spark, d):
    return checks.distinct_count(table(spark, d, "part"), "p_brand")


# Rules


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice - l_quantity * 1000) > greatest(500, 0.6 * l_extendedprice)")
def rule_row_tolerance(spark, d):
    condition = to_spark("ABS(l_extendedprice - l_quantity * 1000) > GREATEST(500, 0.6 * l_extendedprice)")
    return checks.matching(table(spark, d, "lineitem"), condition).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE ts - before > INTERVAL 1 DAY")
def rule_longitudinal_lag(spark, d):
    condition = to_spark("ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY event_id) > INTERVAL 1 DAY")
    return checks.matching(table(spark, d, "events").select("event_id", "user_id", "ts"), condition).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, quantile_cont(l_extendedprice, 0.995) OVER (PARTITION BY l_returnflag) AS q FROM lineitem) WHERE l_extendedprice > q")
def rule_percentile_outlier(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    condition = to_spark("l_extendedprice > quantile_cont(l_extendedprice, 0.995) OVER (PARTITION BY l_returnflag)")
    return checks.matching(rows, condition).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, user_id, quantile_cont(value, 0.9) OVER (PARTITION BY event_type) AS q, value FROM events) WHERE value > q")
def rule_percentile_window(spark, d):
    condition = to_spark("value > quantile_cont(value, 0.9) OVER (PARTITION BY event_type)")
    return checks.matching(table(spark, d, "events").select("event_id", "event_type", "value"), condition).select("event_id", "event_type")


@query("SELECT event_id FROM events JOIN (SELECT user_id AS u, count(DISTINCT hour(ts)) AS n FROM events GROUP BY ALL) ON user_id = u WHERE n <= (SELECT quantile_disc(n, 0.5) FROM (SELECT count(DISTINCT hour(ts)) AS n FROM events GROUP BY user_id))")
def rule_distinct_window(spark, d):
    """Events of users in the lower half by hours of the day that they are active in."""
    events = table(spark, d, "events").select("event_id", "user_id", F.hour("ts").alias("h"))
    middle = events.groupBy("user_id").agg(F.count_distinct("h").alias("n")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)")).first()[0]
    return checks.matching(events, to_spark(f"COUNT(DISTINCT h) OVER (PARTITION BY user_id) <= {int(middle)}")).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem)")
def rule_percentile_one_key(spark, d):
    """The percentile of a key that all rows have: ranges of values are counted, no task sees them all."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.lit("all").alias("k"))
    return checks.matching(rows, to_spark("l_extendedprice > quantile_cont(l_extendedprice, 0.99) OVER (PARTITION BY k)")).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (ORDER BY ts NULLS FIRST, event_id) AS b FROM events) WHERE value < b")
def assert_monotonic_order_by(spark, d):
    """An order of the whole table by another column."""
    events = numbered(table(spark, d, "events").select("event_id", "ts", "value"), "event_id")
    return checks.assertion_rows(events, "monotonic(increasing, order_by=ts)", "value").select("event_id")


@query("""SELECT event_id FROM (SELECT event_id, lead(event_id, 2) OVER w AS b, count(user_id) OVER (w ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER w AS r,
          max(event_id) OVER (w ROWS UNBOUNDED PRECEDING) AS m FROM events WINDOW w AS (ORDER BY value NULLS FIRST, event_id)) WHERE event_id > b AND c % 3 = 0 AND r % 2 = 0 AND m > event_id""")
def rule_windows_of_all_rows(spark, d):
    """LEAD, row numbers and running values over the whole table."""
    events = numbered(table(spark, d, "events").select("event_id", "user_id", "value"), "event_id")
    running = "OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    condition = f"event_id > LEAD(event_id, 2) OVER (ORDER BY value) AND COUNT(user_id) {running} % 3 = 0 AND ROW_NUMBER() OVER (ORDER BY value) % 2 = 0 AND MAX(event_id) {running} > event_id"
    return checks.matching(events, to_spark(condition)).select("event_id")


def _dataset_rule(data: DataFrame, sql: str) -> DataFrame:
    return dataset_query(data, Rule("Q", "validate", "dataset", (), sql))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def rule_dataset_group_having(spark, d):
    return _dataset_rule(table(spark, d, "orders"), "SELECT o_custkey, COUNT(*) AS n FROM data GROUP BY o_custkey HAVING COUNT(*) > 12;")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def rule_dataset_anti_join(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("kind"))
    data = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind")).unionByName(lines)
    return _dataset_rule(data, "SELECT a.k AS o_orderkey FROM data a WHERE a.kind = 'order' AND NOT EXISTS (SELECT 1 FROM data b WHERE b.kind = 'line' AND b.k = a.k)")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def rule_dataset_set_op(spark, d):
    data = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("kind"))
    data = data.unionByName(table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k"), F.lit(2).alias("kind")))
    return _dataset_rule(data, "SELECT k AS c_custkey FROM data WHERE kind = 1 EXCEPT SELECT k FROM data WHERE kind = 2")


@query("SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")
def rule_dataset_self_join(spark, d):
    return _dataset_rule(table(spark, d, "orders"), "SELECT a.o_orderkey, b.o_orderkey AS other FROM data a JOIN data b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")


@query("SELECT event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events WHERE value > 99 GROUP BY event_type")
def rule_dataset_string_agg(spark, d):
    return _dataset_rule(table(spark, d, "events"), "SELECT event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM data WHERE value > 99 GROUP BY event_type")


# Corrections


_SENTINELS = [
    Replacement("c_acctbal", "c_acctbal < 0", "CAST(NULL AS DOUBLE)"),
    Replacement("c_mktsegment", "c_acctbal < 0", "concat('?', c_mktsegment)"),
]
_SENTINELS_SQL = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN concat('?', c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer"


@query(_SENTINELS_SQL)
def correct_sentinel_multi(spark, d):
    return checks.correct(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), _SENTINELS)


@query("SELECT event_id, CASE WHEN value < 5 THEN lag(value) OVER (PARTITION BY user_id ORDER BY event_id) ELSE value END AS value FROM events")
def correct_window_carry_forward(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    carried = Replacement("value", "value < 5", to_spark("LAG(value) OVER (PARTITION BY user_id ORDER BY event_id)"))
    return checks.correct(events, [carried]).select("event_id", "value")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 1 ELSE p_size END AS p_size FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size * 2 ELSE p_size END AS p_size FROM part)")
def correct_order_dependent(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    first = checks.correct(parts, [Replacement("p_size", "p_size > 10", "p_size * 2")])
    return checks.correct(first, [Replacement("p_size", "p_size > 20", "1")])


@query(
    "SELECT c_custkey AS row, 0 AS target, 'c_name' AS column, c_name AS before, upper(c_name) AS after FROM customer WHERE c_custkey % 2 = 0 AND c_name IS DISTINCT FROM upper(c_name) "
    "UNION ALL SELECT c_custkey, 1, 'c_mktsegment', c_mktsegment, lower(c_mktsegment) FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment IS DISTINCT FROM lower(c_mktsegment)"
)
def correct_change_log(spark, d):
    own = [Replacement("c_name", "c_custkey % 2 = 0", "upper(c_name)"), Replacement("c_mktsegment", "c_custkey % 3 = 0", "lower(c_mktsegment)")]
    return checks.change_log(numbered(table(spark, d, "customer"), "c_custkey"), own)


@query("SELECT count(*) FILTER (WHERE c_acctbal < 0) AS n_0, count(*) FILTER (WHERE c_acctbal < 0) AS n_1 FROM customer")
def correct_change_counts(spark, d):
    return checks.change_counts(table(spark, d, "customer"), _SENTINELS).select("n_0", "n_1")


# Casting

_TEXTS = "CASE WHEN l_orderkey % 5 = 0 THEN '1e3' WHEN l_orderkey % 5 = 1 THEN '42.5' WHEN l_orderkey % 5 = 2 THEN 'n/a' WHEN l_orderkey % 5 = 3 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END"
_LADDER = "CASE WHEN TRY_CAST(t AS DOUBLE) IS NULL OR NOT isfinite(TRY_CAST(t AS DOUBLE)) OR TRY_CAST(t AS DOUBLE) <> trunc(TRY_CAST(t AS DOUBLE)) THEN NULL ELSE coalesce(TRY_CAST(t AS BIGINT), TRY_CAST(TRY_CAST(t AS DOUBLE) AS BIGINT)) END"


def _texts(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.expr(to_spark(_TEXTS)).alias("t"))


@query(f"SELECT t, {_LADDER} AS whole, count(*) AS n FROM (SELECT {_TEXTS} AS t FROM lineitem) GROUP BY ALL")
def cast_integer_ladder(spark, d):
    return _texts(spark, d).groupBy("t").agg(F.count("*").alias("n")).select("t", checks.integer_ladder("t").alias("whole"), "n")


def _one_column(text: str, name: str = "t"):
    doc = '{"type": "array", "items": {"type": "object", "properties": {"%s": %s}}}' % (name, text)
    schemas = build_schema_set([("root.json", doc, None)])
    return schemas, digest(schemas)


@query(f"SELECT t AS raw, count(*) AS n FROM (SELECT t, {_LADDER} AS whole FROM (SELECT {_TEXTS} AS t FROM lineitem)) WHERE t IS NOT NULL AND trim(t) <> '' AND whole IS NULL GROUP BY t")
def cast_failures_by_text(spark, d):
    _, found = _one_column('{"type": "integer"}')
    raw = _texts(spark, d).select(F.col("l_orderkey").alias(checks.ROW), "t")
    return cast_failures(raw, cast_plan(found.by_name, raw)).groupBy("raw").agg(F.count("*").alias("n"))


# Schema validation of rows

_ORDERS_SCHEMA = """
{"$id": "https://example.org/orders.json", "type": "array", "items": {"type": "object",
 "properties": {
   "o_orderkey": {"type": "integer"},
   "o_orderstatus": {"enum": ["F", "O", "P"]},
   "o_orderpriority": {"type": "string", "pattern": "^[1-4]-"},
   "o_totalprice": {"anyOf": [{"type": "number", "minimum": 1000, "maximum": 300000}, {"$ref": "#/$defs/unknown"}]}},
 "required": ["o_orderkey", "o_orderpriority"],
 "allOf": [{"if": {"required": ["o_orderstatus"], "properties": {"o_orderstatus": {"const": "P"}}},
            "then": {"properties": {"o_totalprice": {"maximum": 200000}}}}]},
 "$defs": {"unknown": {"const": -1, "title": "Unknown"}}}
"""
_ORDERS_SQL = "(SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)"


def _order_findings(spark, d):
    schemas = build_schema_set([("orders.json", _ORDERS_SCHEMA, None)])
    found = digest(schemas)
    priority = F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_orderpriority"))
    raw = numbered(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", priority.alias("o_orderpriority")), "o_orderkey")
    plan = cast_plan(found.by_name, raw)
    return row_findings(raw, cast_failures(raw, plan), schemas, found, plan)


_PRICE = r"regexp_replace(CAST(o_totalprice AS VARCHAR), '\.0$', '')"


@query(
    f"SELECT 'schema:prop:o_orderpriority:value' AS rule_id, o_orderkey AS row, '''' || o_orderpriority || ''' does not match the expected format (pattern ^[1-4]-).' AS message FROM {_ORDERS_SQL} WHERE o_orderpriority IS NOT NULL AND NOT regexp_matches(o_orderpriority, '^[1-4]-') "
    f"UNION ALL SELECT 'schema:prop:o_totalprice:value', o_orderkey, {_PRICE} || CASE WHEN o_totalprice < 1000 THEN ' is below the minimum 1,000' ELSE ' exceeds the maximum 300,000' END || ' — expected a number 1,000–300,000, or a missing-value code (-1 Unknown).' FROM {_ORDERS_SQL} WHERE o_totalprice <> -1 AND (o_totalprice < 1000 OR o_totalprice > 300000)"
)
def schema_value_flags(spark, d):
    return _order_findings(spark, d).filter("rule_id like 'schema:prop:%:value'").select("rule_id", "row", "message")


@query("SELECT 'schema:cond:0:o_totalprice' AS rule_id, o_orderkey AS row, 'when o_orderstatus = ''P'', o_totalprice must satisfy the conditional constraint (see schema).' AS text FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def schema_conditional_flags(spark, d):
    found = _order_findings(spark, d).filter("rule_id like 'schema:cond:%'")
    return found.select("rule_id", "row", F.substring_index("message", " Found", 1).alias("text"))


@query("SELECT 'schema:prop:o_orderpriority:required' AS rule_id, o_orderkey AS row, 'value is missing — this variable is required for every record.' AS message FROM orders WHERE o_orderkey % 10 = 0")
def schema_required_flags(spark, d):
    return _order_findings(spark, d).filter("rule_id like 'schema:prop:%:required'").select("rule_id", "row", "message")


# A schema of 265 columns over customers: whole numbers, codes, numbers and texts, and conditions between columns.

_WIDE = 265


def _wide_column(i):
    """(how column i is made of a customer, in both dialects, its schema, what breaks it in SQL)."""
    number = f"(c_custkey * {i + 3} + {i}) % {97 + i}"
    if i % 4 == 0:
        return number, {"type": "integer", "maximum": 93 + i}, f"v > {93 + i}"
    if i % 4 == 1:
        return number, {"anyOf": [{"type": "integer", "minimum": 4}, {"const": 1, "title": "Refused"}]}, "v < 4 AND v <> 1"
    if i % 4 == 2:
        return f"CASE WHEN {number} < 95 THEN 'x' || CAST({number} AS STRING) ELSE 'none' END", {"type": "string", "pattern": "^x[0-9]+$"}, "v = 'none'"
    return f"CASE WHEN {number} < 94 THEN 'a' ELSE 'z{i}' END", {"enum": ["a", "b", f"c{i}"]}, "v <> 'a'"


_WIDE_SQL = " UNION ALL ".join(
    f"SELECT c_custkey AS row, 'w{i}' AS \"column\" FROM (SELECT c_custkey, {_wide_column(i)[0]} AS v FROM customer) WHERE {_wide_column(i)[2]}" for i in range(_WIDE)
) + " UNION ALL SELECT c_custkey, 'w8' FROM customer WHERE (c_custkey * 7 + 4) % 101 = 2 AND (c_custkey * 11 + 8) % 105 > 50 AND (c_custkey * 11 + 8) % 105 <= 101"


@query(f"SELECT row, \"column\", count(*) AS n FROM ({_WIDE_SQL}) GROUP BY ALL")
def schema_wide_flags(spark, d):
    props = {f"w{i}": _wide_column(i)[1] for i in range(_WIDE)}
    rule = {"if": {"properties": {"w4": {"const": 2}}, "required": ["w4"]}, "then": {"properties": {"w8": {"not": {"minimum": 51, "maximum": 101}}}}}
    schema = {"type": "array", "items": {"type": "object", "properties": props, "allOf": [rule]}}
    schemas = build_schema_set([("wide.json", json.dumps(schema), None)])
    found = digest(schemas)
    raw = numbered(table(spark, d, "customer"), "c_custkey").selectExpr(checks.ROW, *[f"{_wide_column(i)[0]} AS w{i}" for i in range(_WIDE)])
    plan = cast_plan(found.by_name, raw)
    return row_findings(raw, cast_failures(raw, plan), schemas, found, plan).groupBy("row", "column").agg(F.count("*").alias("n"))


# The dataset as a whole


@query("WITH r AS (SELECT event_id, user_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) SELECT first, event_id AS other FROM r WHERE event_id <> first")
def dataset_duplicate_records(spark, d):
    events = numbered(table(spark, d, "events"), "event_id").select(checks.ROW, "user_id", "event_type")
    return checks.duplicate_records(events, ["user_id", "event_type"])


# Findings

_CUSTOMER_RULES = (("R1", "error", "c_acctbal", "c_acctbal < 0"), ("R2", "warning", "c_acctbal", "c_acctbal > 9000"), ("R3", "info", "c_mktsegment", "c_mktsegment = 'BUILDING'"))
_FINDINGS_SQL = "(" + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{s}' AS severity, {i} AS rank, c_custkey AS row, '{c}' AS column FROM customer WHERE {w}" for i, (r, s, c, w) in enumerate(_CUSTOMER_RULES)) + ")"


def _findings(spark, d):
    data = numbered(table(spark, d, "customer"), "c_custkey")
    out = None
    for rank, (rule, severity, column, condition) in enumerate(_CUSTOMER_RULES):
        rows = checks.matching(data, condition).select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(rank).alias("rank"), F.col(checks.ROW).alias("row"), F.lit(column).alias("column"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT rule_id, severity, count(*) AS n, count(DISTINCT row) AS rows FROM {_FINDINGS_SQL} GROUP BY ALL")
def flag_rollup_by_rule(spark, d):
    return _findings(spark, d).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("row").alias("rows"))


@query("SELECT c_custkey AS row, c_acctbal AS before, round(c_acctbal * 2, 2) AS after FROM customer WHERE c_acctbal < 0 AND round(c_acctbal * 2, 2) <> c_acctbal")
def correct_value_token(spark, d):
    """A correction whose text names its target by the value token, as the run of rules expands it."""
    data = numbered(table(spark, d, "customer"), "c_custkey")
    rule = Rule("V", "correct", "row", ("c_acctbal",), "__value__ < 0", update_expression="ROUND(__value__ * 2, 2)")
    [replacement] = replacements(rule)
    return checks.cell_changes(data, replacement)


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_acctbal < 0 THEN 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_acctbal < 0 THEN 1 ELSE c_acctbal END IN (0, 1) THEN 'set' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def run_rules_corrections(spark, d):
    """Three corrections in file order, each on what the one before left, through a whole run."""
    data = numbered(table(spark, d, "customer"), "c_custkey")
    steps = (("c_acctbal", "c_mktsegment = 'BUILDING'", "0"), ("c_acctbal", "c_acctbal < 0", "1"), ("c_mktsegment", "c_acctbal IN (0, 1)", "'set'"))
    rules = [Rule(f"C{i}", "correct", "row", (t,), c, update_expression=e) for i, (t, c, e) in enumerate(steps)]
    run = run_rules(data, [RuleFile("c.rules.csv", "c", rules)])
    return run.data.select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


_LOGGED = (
    Replacement("o_totalprice", "o_orderstatus = 'F'", "round(o_totalprice * 2, 2)"),
    Replacement("o_orderpriority", "o_totalprice > 400000", "'dear'"),
    Replacement("o_totalprice", "o_orderpriority = 'dear'", "400000D"),
)
_LOGGED_SQL = """(SELECT *, CASE WHEN p2 = 'dear' THEN 400000 ELSE t1 END AS t3 FROM (SELECT *, CASE WHEN t1 > 400000 THEN 'dear' ELSE p0 END AS p2 FROM (
SELECT o_orderkey AS row, o_totalprice AS t0, o_orderpriority AS p0, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS t1 FROM orders)))"""


def _change_log(spark, d):
    data = numbered(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey")
    log = ChangeLog(data, f"{shared_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}")
    for r in _LOGGED:
        log.record(repr(r), [r.column], lambda r=r: step_rows(log.merged(), [r]))
    return log


@query(f"SELECT row AS o_orderkey, t3 AS o_totalprice, p2 AS o_orderpriority FROM {_LOGGED_SQL}")
def change_log_replay(spark, d):
    """Three corrections, each on what those before left, as steps of a log; the table is one merge of all."""
    return _change_log(spark, d).merged().select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(f"""SELECT step, "column", count(*) AS n, min(row) AS first FROM (SELECT 0 AS step, 'o_totalprice' AS "column", row FROM {_LOGGED_SQL} WHERE t0 <> t1
UNION ALL SELECT 1, 'o_orderpriority', row FROM {_LOGGED_SQL} WHERE p0 <> p2 UNION ALL SELECT 2, 'o_totalprice', row FROM {_LOGGED_SQL} WHERE t1 <> t3) GROUP BY ALL""")
def change_log_history(spark, d):
    """What each step changed."""
    return _change_log(spark, d).history().groupBy("step", "column").agg(F.count("*").alias("n"), F.min("row").alias("first"))


@query(f"SELECT count(DISTINCT row) AS n FROM {_FINDINGS_SQL}")
def rows_affected(spark, d):
    return _findings(spark, d).agg(F.count_distinct("row").alias("n"))


@query(f"SELECT rule_id, n, row_number() OVER (ORDER BY n DESC, rule_id) AS place, round(100.0 * n / (SELECT count(*) FROM customer), 1)::DOUBLE AS percent FROM (SELECT rule_id, count(*) AS n FROM {_FINDINGS_SQL} GROUP BY rule_id)")
def repeat_offenders(spark, d):
    total = table(spark, d, "customer").agg(F.count("*").alias("total"))
    counts = _findings(spark, d).groupBy("rule_id").agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row
    place = F.row_number().over(Window.orderBy(F.desc("n"), "rule_id")).cast("long")  # a row for each rule
    return counts.select("rule_id", "n", place.alias("place"), F.round(100.0 * F.col("n") / F.col("total"), 1).cast("double").alias("percent"))


@query(f"SELECT rule_id, severity, row FROM {_FINDINGS_SQL} ORDER BY rank, row LIMIT 200")
def flag_severity_cap(spark, d):
    """Each finding came twice; the gravest 200 of the merged ones stay, the earliest first."""
    found = _findings(spark, d).select(F.lit("rules").alias("source"), "rule_id", F.lit("cell").alias("scope"), "row", "column", F.col("severity").alias("message"), "severity", F.col("row").alias("seq"))
    twice = found.unionByName(found.withColumn("seq", F.col("seq") + 10_000_000))
    return findings.gravest(findings.merged(twice), 200).where("times = 2").select("rule_id", "severity", "row")


_ORDER_CHECKS = (("dear", "o_totalprice > 300000"), ("done", "o_orderstatus = 'F'"), ("seventh", "o_custkey % 7 = 0"), ("none", "o_orderkey < 0"))


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS rule, o_orderkey AS row, o_totalprice AS price FROM orders WHERE {c} ORDER BY o_orderkey LIMIT 1000)" for k, c in _ORDER_CHECKS))
def findings_under_caps(spark, d):
    """The first thousand violations of each of several rules, from one pass that counts and one that fetches."""
    data = numbered(table(spark, d, "orders"), "o_orderkey")
    own = [findings.Check(k, c, ("o_totalprice",)) for k, c in _ORDER_CHECKS]
    rows = findings.capped(data, own, 1000, findings.extents(data, own, 1000))
    names = F.array(*[F.lit(c.key) for c in own])
    return rows.select(names[F.col("check")].alias("rule"), "row", F.col("cells.o_totalprice").alias("price"))


@query(" UNION ALL ".join(
    f"(SELECT '{k}' AS rule_id, 'cell' AS scope, o_orderkey AS row, 'o_totalprice' AS \"column\", 'Look.' AS message FROM orders WHERE {c} ORDER BY o_orderkey LIMIT 300) "
    f"UNION ALL SELECT '{k}', 'column', NULL, 'o_totalprice', '…and ' || format('{{:,}}', count(*) - 300) || ' more rows flagged by this rule' FROM orders WHERE {c} HAVING count(*) > 300" for k, c in _ORDER_CHECKS))
def run_rules_findings(spark, d):
    """A whole run of rules, with its caps and summaries, as the findings of its store."""
    data = numbered(table(spark, d, "orders"), "o_orderkey")
    rules = tuple(Rule(k, "validate", "row", ("o_totalprice",), c, severity="warning", comment="Look.") for k, c in _ORDER_CHECKS)
    store = FlagStore()
    store.add(run_rules(data, [RuleFile("orders.rules.csv", "orders", list(rules))], Options(row_cap=300)).flags)
    return store.to_dataframe(spark).select("rule_id", "scope", "row", "column", "message")


@query(f"""SELECT row, "column", string_agg(rule_id || ': ' || severity, '; ' ORDER BY rank) AS review FROM {_FINDINGS_SQL} GROUP BY row, "column" """)
def review_cell_texts(spark, d):
    found = _findings(spark, d).withColumn("seq", F.col("rank").cast("long")).withColumn("message", F.col("severity"))
    return review_cells(found)


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name")
def rule_dataset_star_join(spark, d):
    region, nation, customer = (table(spark, d, n) for n in ("region", "nation", "customer"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return _dataset_rule(joined.select("r_name"), "SELECT r_name, COUNT(*) AS n FROM data GROUP BY ALL")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
