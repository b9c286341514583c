"""Named queries over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.frame import Frame, Series
from tabwright.functions import categorical, masks
from tabwright.functions.aggregates import AggFunc
from tabwright.operators.grouping import GroupByOptions
from tabwright.streaming import live

FLAGSHIP = "flagship"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str, order_by: tuple[str, ...] = ()) -> Frame:
    return Frame.read_parquet(spark, f"{sf_dir}/{name}.parquet", order_by)


def _round(frame: Frame, *names: str) -> DataFrame:
    """Doubles to six places, as sums of floating point depend on their order."""
    return frame.to_spark().withColumns({n: F.round(n, 6) for n in names})


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """What an operator gave the driver, as a table."""
    return spark.createDataFrame(rows, schema)


# -- filters and masks ------------------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS l_quantity, round(sum(l_extendedprice * l_discount), 6) AS discount,
    round(avg(l_tax), 6) AS l_tax, count(l_orderkey) AS l_orderkey FROM lineitem WHERE l_quantity < 25 AND l_returnflag = 'R' GROUP BY 1, 2"""
)
def flagship(spark, sf_dir):
    """Filter, arithmetic and grouped aggregation in one plan."""
    items = table(spark, sf_dir, "lineitem")
    picked = items.where(items["l_quantity"].less_than(25.0, nan_free=True) & items["l_returnflag"].equals("R"))
    priced = picked.add_column(picked["l_extendedprice"].multiply(picked["l_discount"]).renamed("discount"))
    grouped = priced.group_by("l_returnflag", "l_linestatus")
    found = grouped.agg({"l_quantity": AggFunc.SUM, "discount": AggFunc.SUM, "l_tax": AggFunc.MEAN, "l_orderkey": AggFunc.COUNT})
    return _round(found, "l_quantity", "discount", "l_tax")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_gt(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.where(items["l_quantity"].greater_than(45.0)).select("l_orderkey", "l_linenumber", "l_quantity").to_spark()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderdate <= TIMESTAMP '1996-06-30'")
def filter_ge_le(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    late = orders["o_orderdate"].less_than_or_equal(dt.datetime(1996, 6, 30))
    return orders.where(orders["o_totalprice"].greater_than_or_equal(100000.0) & late).select("o_orderkey").to_spark()


@query("SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.04")
def filter_between(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.where(items["l_discount"].between(0.02, 0.04)).select("l_orderkey", "l_discount").to_spark()


@query("SELECT p_partkey FROM part WHERE p_size = 7")
def filter_eq(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.where(parts["p_size"].equal_to(7)).select("p_partkey").to_spark()


def _segment_or_null(spark, sf_dir) -> Frame:
    """Customers whose segment is null where it is BUILDING, and their balance null where it is negative."""
    customers = table(spark, sf_dir, "customer", ("c_custkey",))
    data = customers.data.withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING"))).withColumn("bal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return Frame(data)


_SEG = "(SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer)"


@query(f"SELECT c_custkey FROM {_SEG} WHERE bal IS NOT NULL AND bal <> 0")
def filter_ne_null(spark, sf_dir):
    f = _segment_or_null(spark, sf_dir)
    return f.where(f["bal"].not_equal_to(0.0)).select("c_custkey").to_spark()


@query(f"SELECT c_custkey FROM {_SEG} WHERE seg IS NULL OR bal IS NOT NULL")
def filter_null_masks(spark, sf_dir):
    f = _segment_or_null(spark, sf_dir)
    return f.where(f["seg"].is_null() | f["bal"].is_not_null()).select("c_custkey").to_spark()


@query(f"SELECT c_custkey FROM {_SEG} WHERE NOT coalesce(bal > 5000, false)")
def mask_not_selects_nulls(spark, sf_dir):
    f = _segment_or_null(spark, sf_dir)
    return f.where(~f["bal"].greater_than(5000.0)).select("c_custkey").to_spark()


@query(f"SELECT c_custkey FROM {_SEG} WHERE coalesce(bal > 5000, false) <> coalesce(seg = 'MACHINERY', false)")
def mask_xor(spark, sf_dir):
    f = _segment_or_null(spark, sf_dir)
    return f.where(f["bal"].greater_than(5000.0) ^ f["seg"].equals("MACHINERY")).select("c_custkey").to_spark()


@query(
    """SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 40 AND p_retailprice >= 1000
    UNION SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 50"""
)
def mask_all_any(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    every = masks.all_(p["p_size"].greater_than(10), p["p_size"].less_than(40), p["p_retailprice"].greater_than_or_equal(1000.0))
    some = masks.any_(p["p_size"].equal_to(1), p["p_size"].equal_to(50))
    return p.where(every | some).select("p_partkey").to_spark()


@query(f"SELECT c_custkey FROM {_SEG} WHERE seg IS NULL")
def string_equals_null(spark, sf_dir):
    f = _segment_or_null(spark, sf_dir)
    return f.where(f["seg"].equals(None)).select("c_custkey").to_spark()


@query(f"SELECT c_custkey FROM {_SEG} WHERE seg IN ('MACHINERY', 'HOUSEHOLD')")
def string_is_in(spark, sf_dir):
    f = _segment_or_null(spark, sf_dir)
    return f.where(f["seg"].is_in("MACHINERY", None, "HOUSEHOLD")).select("c_custkey").to_spark()


@query(f"SELECT c_custkey FROM {_SEG} WHERE seg IN ('MACHINERY', 'HOUSEHOLD') OR seg IS NULL")
def categorical_is_in(spark, sf_dir):
    f = categorical.to_categorical(_segment_or_null(spark, sf_dir), "seg")
    return f.where(f["seg"].is_in_categories("MACHINERY", None, "HOUSEHOLD")).select("c_custkey").to_spark()


@query("SELECT count(*) FILTER (WHERE l_quantity > 45) AS selected FROM lineitem")
def mask_count_true(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return _rows(spark, "selected long", [(items.count_true(items["l_quantity"].greater_than(45.0)),)])


@query("SELECT position FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, c_acctbal FROM customer) WHERE c_acctbal > 9000")
def mask_true_positions(spark, sf_dir):
    customers = table(spark, sf_dir, "customer", ("c_custkey",))
    return customers.true_positions(customers["c_acctbal"].greater_than(9000.0))


def _balance_or_nan(spark, sf_dir) -> Frame:
    """Customers whose balance is NaN where it is negative."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return Frame(customers.data.withColumn("x", F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))))


_NAN = "(SELECT *, CASE WHEN c_acctbal < 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS x FROM customer)"


@query(f"SELECT c_custkey FROM {_NAN} WHERE isnan(x) OR x < 1000")
def filter_nan_is_least(spark, sf_dir):
    f = _balance_or_nan(spark, sf_dir)
    return f.where(f["x"].less_than(1000.0)).select("c_custkey").to_spark()


@query(f"SELECT c_custkey FROM {_NAN} WHERE NOT isnan(x) AND x >= 9000")
def filter_nan_not_above(spark, sf_dir):
    f = _balance_or_nan(spark, sf_dir)
    return f.where(f["x"].greater_than_or_equal(9000.0)).select("c_custkey").to_spark()


@query(f"SELECT c_mktsegment, min(x) FILTER (WHERE NOT isnan(x)) AS x, max(c_acctbal) AS c_acctbal FROM {_NAN} GROUP BY 1")
def agg_min_passes_over_nan(spark, sf_dir):
    return _balance_or_nan(spark, sf_dir).group_by("c_mktsegment").agg({"x": AggFunc.MIN, "c_acctbal": AggFunc.MAX}).to_spark()


# -- arithmetic and reductions ------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS "l_extendedprice+l_tax", l_extendedprice - l_tax AS "l_extendedprice-l_tax",
    l_extendedprice * l_tax AS "l_extendedprice*l_tax", l_extendedprice / nullif(l_tax, 0) AS "l_extendedprice/l_tax" FROM lineitem"""
)
def vector_double_columns(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    a, b = items["l_extendedprice"], items["l_tax"]
    out = items.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    for made in (a + b, a - b, a * b, a / b):
        out = out.add_column(made)
    return out.to_spark().drop("l_extendedprice", "l_tax")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 - 0.5 AS l_quantity, l_extendedprice / 4 AS l_extendedprice FROM lineitem")
def vector_double_scalar(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    out = items.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return out.add_column(out["l_quantity"].multiply(2).add(1).subtract(0.5)).add_column(out["l_extendedprice"].divide(4)).to_spark()


@query(
    """SELECT p_partkey, CAST(p_size + p_size AS INTEGER) AS "p_size+p_size", CAST(p_size * p_size AS INTEGER) AS "p_size*p_size",
    CAST(p_size - p_size AS INTEGER) AS "p_size-p_size", p_size / nullif(p_size - 10, 0)::DOUBLE AS ratio FROM part"""
)
def vector_int_columns(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    n = parts["p_size"]
    out = parts.select("p_partkey", "p_size")
    for made in (n + n, n * n, n - n, n.divide(n.subtract(10)).renamed("ratio")):
        out = out.add_column(made)
    return out.to_spark().drop("p_size")


@query("SELECT p_partkey, CAST(p_size + 7 AS INTEGER) AS p_size, CAST(p_size - 2147483648 - 1 + 4294967296 AS INTEGER) AS wrapped FROM part WHERE p_size < 1 UNION ALL SELECT p_partkey, CAST(p_size + 7 AS INTEGER), CAST(p_size - 2147483640 AS INTEGER) FROM part WHERE p_size >= 1")
def vector_int_plus_minus_scalar(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    less = parts["p_size"].subtract(2147483640).renamed("wrapped")
    return parts.add_column(less).add_column(parts["p_size"].add(7)).to_spark()


@query(
    """SELECT p_partkey, CAST(CASE WHEN p > 2147483647 THEN p - 4294967296 ELSE p END AS INTEGER) AS p_size, half
    FROM (SELECT p_partkey, (p_size::BIGINT * 100000000) % 4294967296 AS p, p_size / 2.0::DOUBLE AS half FROM part)"""
)
def vector_int_scalar_wraps(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return parts.add_column(parts["p_size"].divide(2).renamed("half")).add_column(parts["p_size"].multiply(100000000)).to_spark()


@query(
    """SELECT round(sum(o_totalprice), 4) AS o_totalprice_sum, round(avg(o_totalprice), 6) AS o_totalprice_mean, min(o_totalprice) AS o_totalprice_min,
    max(o_totalprice) AS o_totalprice_max, round(stddev_samp(o_totalprice), 6) AS o_totalprice_std, count(o_totalprice) AS o_totalprice_count FROM orders"""
)
def reduce_stats(spark, sf_dir):
    found = table(spark, sf_dir, "orders").reduce({"o_totalprice": ["sum", "mean", "min", "max", "std", "count"]})
    return found.withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 4), "o_totalprice_mean": F.round("o_totalprice_mean", 6), "o_totalprice_std": F.round("o_totalprice_std", 6)})


# -- grouping -------------------------------------------------------------------------


def _agg_query(func: AggFunc, sql: str):
    name = f"agg_{func.value}"

    def run(spark, sf_dir):
        orders = table(spark, sf_dir, "orders", ("o_orderkey",))
        found = orders.group_by("o_orderpriority", "o_orderstatus").agg({"o_totalprice": func})
        if func is AggFunc.VAR:  # of 1e10, so six places are beyond a double
            return found.to_spark().withColumn("o_totalprice", F.round("o_totalprice", 2))
        return found.to_spark() if func in (AggFunc.COUNT, AggFunc.NUNIQUE) else _round(found, "o_totalprice")

    run.__name__, run.__doc__ = name, f"The aggregate {func.value} by two keys."
    QUERIES[name] = run
    ORACLES[name] = f"SELECT o_orderpriority, o_orderstatus, {sql} AS o_totalprice FROM orders GROUP BY 1, 2"


_agg_query(AggFunc.SUM, "round(sum(o_totalprice), 6)")
_agg_query(AggFunc.MEAN, "round(avg(o_totalprice), 6)")
_agg_query(AggFunc.MIN, "round(min(o_totalprice), 6)")
_agg_query(AggFunc.MAX, "round(max(o_totalprice), 6)")
_agg_query(AggFunc.MEDIAN, "round(median(o_totalprice), 6)")
_agg_query(AggFunc.VAR, "round(var_samp(o_totalprice), 2)")
_agg_query(AggFunc.STD, "round(stddev_samp(o_totalprice), 6)")
_agg_query(AggFunc.COUNT, "count(o_totalprice)")
_agg_query(AggFunc.NUNIQUE, "count(DISTINCT o_totalprice)::DOUBLE")
_agg_query(AggFunc.FIRST, "round(arg_min(o_totalprice, o_orderkey), 6)")
_agg_query(AggFunc.LAST, "round(arg_max(o_totalprice, o_orderkey), 6)")


@query("SELECT l_orderkey, round(product(1 + l_discount), 6) AS factor FROM lineitem GROUP BY 1")
def agg_prod(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    items = items.add_column(items["l_discount"].add(1).renamed("factor"))
    return _round(items.group_by("l_orderkey").agg({"factor": AggFunc.PROD}), "factor")


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, max(l_extendedprice) AS l_extendedprice,
    count(DISTINCT l_suppkey)::DOUBLE AS l_suppkey, count(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2"""
)
def groupby_multi_key(spark, sf_dir):
    spec = {"l_quantity": AggFunc.SUM, "l_discount": AggFunc.MEAN, "l_extendedprice": AggFunc.MAX, "l_suppkey": AggFunc.NUNIQUE, "l_shipdate": AggFunc.COUNT}
    return _round(table(spark, sf_dir, "lineitem").group_by("l_returnflag", "l_linestatus").agg(spec), "l_quantity", "l_discount")


@query(f"SELECT seg, round(avg(bal), 6) AS bal, count(c_custkey) AS c_custkey FROM {_SEG} GROUP BY 1")
def groupby_null_key(spark, sf_dir):
    return _round(_segment_or_null(spark, sf_dir).group_by("seg").agg({"bal": AggFunc.MEAN, "c_custkey": AggFunc.COUNT}), "bal")


@query(f"SELECT seg, count(*)::DOUBLE AS count FROM {_SEG} GROUP BY 1")
def group_count(spark, sf_dir):
    return _segment_or_null(spark, sf_dir).group_by("seg").count().to_spark()


@query("SELECT o_orderstatus || '|' || o_orderpriority AS \"group\", count(*) AS size FROM orders GROUP BY 1")
def group_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").group_by("o_orderstatus", "o_orderpriority", options=GroupByOptions("|")).group_sizes().to_spark()


@query(f"SELECT count(*) AS groups FROM (SELECT DISTINCT seg, c_nationkey FROM {_SEG})")
def group_number(spark, sf_dir):
    return _rows(spark, "groups long", [(_segment_or_null(spark, sf_dir).group_by("seg", "c_nationkey").group_count(),)])


@query("SELECT CAST(p_size AS VARCHAR) AS p_size, round(sum(p_retailprice), 6) AS p_retailprice FROM part GROUP BY 1")
def group_keys_as_string(spark, sf_dir):
    grouped = table(spark, sf_dir, "part").group_by("p_size", options=GroupByOptions(keys_as_string=True))
    return _round(grouped.agg({"p_retailprice": AggFunc.SUM}), "p_retailprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 160000 AND max(o_totalprice) < 400000)")
def group_filter_having(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    mean = orders.add_column(orders["o_totalprice"].renamed("price"))
    tests = {"o_totalprice": (AggFunc.MEAN, lambda x: x > 160000), "price": (AggFunc.MAX, lambda x: x < 400000)}
    return mean.group_by("o_custkey").filter(tests).select("o_orderkey", "o_custkey", "o_totalprice").to_spark()


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 15)")
def group_filter_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").group_by("o_custkey").filter_size(lambda n: n > 15).select("o_orderkey").to_spark()


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING max(p_size) - min(p_size) >= 49)")
def group_filter_callable(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return parts.group_by("p_brand").filter(lambda rows: rows["p_size"].max() - rows["p_size"].min() >= 49).select("p_partkey", "p_brand").to_spark()


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS o_totalprice_mean FROM orders")
def transform_mean(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return _round(orders.group_by("o_custkey").transform("o_totalprice", AggFunc.MEAN).select("o_orderkey", "o_totalprice_mean"), "o_totalprice_mean")


@query("SELECT o_orderkey, round(stddev_samp(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS o_totalprice_std FROM orders")
def transform_std_window(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return _round(orders.group_by("o_custkey").transform("o_totalprice", AggFunc.STD, window=True).select("o_orderkey", "o_totalprice_std"), "o_totalprice_std")


@query("SELECT o_orderkey, n AS o_orderpriority_nunique FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) USING (o_custkey)")
def transform_nunique(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return orders.group_by("o_custkey").transform("o_orderpriority", AggFunc.NUNIQUE).select("o_orderkey", "o_orderpriority_nunique").to_spark()


@query(
    """SELECT o_orderkey, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o_orderpriority_first,
    count(*) OVER (PARTITION BY o_custkey) AS o_orderpriority_count FROM orders"""
)
def transform_first_count(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders", ("o_orderkey",)).group_by("o_custkey").transform("o_orderpriority", AggFunc.FIRST)
    return grouped.group_by("o_custkey").transform("o_orderpriority", AggFunc.COUNT).select("o_orderkey", "o_orderpriority_first", "o_orderpriority_count").to_spark()


@query("SELECT p_partkey, p_brand, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 6) AS p_retailprice FROM part")
def apply_normalize(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    shares = parts.group_by("p_brand").apply(lambda rows: rows.assign(p_retailprice=rows["p_retailprice"] / rows["p_retailprice"].sum()))
    return _round(shares, "p_retailprice")


# -- joins -------------------------------------------------------------------------------


def _sides(spark, sf_dir) -> tuple[Frame, Frame]:
    """Customers of six nations, and orders of some days with some customers: neither side matches wholly."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return customers.where(customers["c_nationkey"].less_than(6)), orders.where(orders["o_totalprice"].greater_than(150000.0))


def _merge_query(how: str, sql_join: str):
    name = f"merge_{how}"

    def run(spark, sf_dir):
        customers, orders = _sides(spark, sf_dir)
        return customers.merge(orders, left_on=["c_custkey"], right_on=["o_custkey"], how=how).to_spark()

    run.__name__, run.__doc__ = name, f"A {how} join on keys of different names."
    QUERIES[name] = run
    ORACLES[name] = f"""SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_nationkey, c_acctbal, o_orderkey, o_totalprice
        FROM (SELECT * FROM customer WHERE c_nationkey < 6) {sql_join} JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey"""


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    _merge_query(_how, _sql)


@query(
    """SELECT a.l_orderkey, a.l_linenumber, a.qty AS qty_x, b.qty AS qty_y FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) a
    JOIN (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"""
)
def merge_multi_key_suffixes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")

    def side(flag: str) -> Frame:
        found = items.where(items["l_returnflag"].equals(flag)).group_by("l_orderkey", "l_linenumber").agg({"l_quantity": AggFunc.SUM})
        return found.add_column(found["l_quantity"].renamed("qty")).select("l_orderkey", "l_linenumber", "qty")

    return side("R").merge(side("N"), on=["l_orderkey", "l_linenumber"]).to_spark()


@query(f"SELECT a.seg, a.c_custkey, b.n FROM {_SEG} a LEFT JOIN (SELECT seg, count(*)::DOUBLE AS n FROM {_SEG} GROUP BY 1) b ON a.seg = b.seg")
def merge_null_keys(spark, sf_dir):
    f = _segment_or_null(spark, sf_dir)
    counts = f.group_by("seg").count()
    counts = counts.add_column(counts["count"].renamed("n")).select("seg", "n")
    return f.select("seg", "c_custkey").merge(counts, on="seg", how="left").to_spark()


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def merge_documents_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").merge(table(spark, sf_dir, "labels"), on="doc_id", how="left").to_spark()


# -- frame management ------------------------------------------------------------------------


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 7")
def head(spark, sf_dir):
    return table(spark, sf_dir, "orders", ("o_orderkey",)).head(7).to_spark()


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail(spark, sf_dir):
    return table(spark, sf_dir, "orders", ("o_orderkey",)).tail(7).to_spark()


@query("SELECT p_size, p_partkey FROM part")
def select_columns(spark, sf_dir):
    return table(spark, sf_dir, "part").select("P_SIZE", "p_partkey", "p_size").to_spark()


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size::DOUBLE AS p_size FROM part")
def add_and_remove_columns(spark, sf_dir):
    parts, removed = table(spark, sf_dir, "part").try_remove_column("P_RETAILPRICE")
    parts, missing = parts.try_remove_column("no_such_column")
    assert removed and not missing
    return parts.add_column(parts["p_size"].as_double()).to_spark()


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer")
def positions(spark, sf_dir):
    return table(spark, sf_dir, "customer", ("c_custkey",)).with_position().select("c_custkey", "position").to_spark()


@query("SELECT c_custkey, c_acctbal, c_name, true AS refused FROM customer")
def typed_columns(spark, sf_dir):
    """Columns by their exact types; another type is refused."""
    f = table(spark, sf_dir, "customer")
    balance, name = f.column("c_acctbal", T.DoubleType()), f.string_column("c_name")
    refused = 0
    for wrong in (lambda: f.column("c_custkey", T.DoubleType()), lambda: f.string_column("c_acctbal")):
        try:
            wrong()
        except TypeError:
            refused += 1
    return f.data.select("c_custkey", balance.expr.alias("c_acctbal"), name.expr.alias("c_name"), F.lit(refused == 2).alias("refused"))


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS position, r_name, r_name AS cell FROM region")
def cell_access(spark, sf_dir):
    """Rows by their position, and a column's cells in order."""
    f = table(spark, sf_dir, "region", ("r_regionkey",)).select("r_regionkey", "r_name")
    return _rows(spark, "position long, r_name string, cell string", [(i, f.row_at(i)[1], c) for i, c in enumerate(f.cells("r_name"))])


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey >= 3 AND n_nationkey < 9")
def memory_columns(spark, sf_dir):
    """Columns in memory made a frame; one that comes again replaces the first one's cells."""
    cells = table(spark, sf_dir, "nation", ("n_nationkey",)).to_spark().filter("n_nationkey >= 3 AND n_nationkey < 9").collect()
    kind = table(spark, sf_dir, "nation").type_of("n_regionkey")
    columns = [("n_name", "string", [None] * len(cells)), ("n_regionkey", kind, [r["n_regionkey"] for r in cells]), ("N_NAME", "string", [r["n_name"] for r in cells])]
    return Frame.from_columns(spark, columns).to_spark()


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 4")
def memory_rows(spark, sf_dir):
    """Rows in memory made a frame, whose order is theirs."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = sorted(map(tuple, nations.to_spark().collect()))
    return Frame.from_rows(spark, rows, nations.visible_schema()).head(4).to_spark()


@query("VALUES ('no key', true), ('blank key', true), ('missing key', true), ('two for one', true), ('other type', true), ('name twice', true)")
def merge_refusals(spark, sf_dir):
    """Joins that are errors before any row is read."""
    customers, orders = _sides(spark, sf_dir)
    cases = {
        "no key": lambda: customers.merge(orders, left_on=[], right_on=[]),
        "blank key": lambda: customers.merge(orders, left_on=[" "], right_on=["o_custkey"]),
        "missing key": lambda: customers.merge(orders, on="c_custkey"),
        "two for one": lambda: customers.merge(orders, left_on=["c_custkey", "c_nationkey"], right_on=["o_custkey"]),
        "other type": lambda: customers.merge(orders, left_on=["c_acctbal"], right_on=["o_custkey"]),
        "name twice": lambda: customers.add_column(customers["c_acctbal"].renamed("o_totalprice_x")).add_column(customers["c_acctbal"].renamed("o_totalprice")).merge(orders, left_on=["c_custkey"], right_on=["o_custkey"]),
    }
    found = []
    for name, case in cases.items():
        try:
            case()
            found.append((name, False))
        except (ValueError, TypeError):
            found.append((name, True))
    return _rows(spark, "col0 string, col1 boolean", found)


@query(
    """SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS position, o_orderpriority, total FROM
    (SELECT o_orderpriority, min(o_orderkey) AS first, count(*)::DOUBLE AS total FROM orders GROUP BY 1)"""
)
def groups_in_order(spark, sf_dir):
    """Groups in the order in which they first appear."""
    counts = table(spark, sf_dir, "orders", ("o_orderkey",)).group_by("o_orderpriority").count(ordered=True)
    return counts.with_position().to_spark().withColumnRenamed("count", "total").select("position", "o_orderpriority", "total")


@query(
    """SELECT CAST(row_number() OVER (ORDER BY c_custkey NULLS LAST, o_orderkey) - 1 AS BIGINT) AS position, coalesce(c_custkey, o_custkey) AS c_custkey, o_orderkey
    FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 6) FULL JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey"""
)
def merge_in_order(spark, sf_dir):
    """A join in the order of the left rows, their right rows, and last the right rows alone."""
    customers, orders = _sides(spark, sf_dir)
    joined = customers.ordered_by("c_custkey").merge(orders.ordered_by("o_orderkey"), left_on=["c_custkey"], right_on=["o_custkey"], how="outer", ordered=True)
    return joined.with_position().select("position", "c_custkey", "o_orderkey").to_spark()


@query(
    """SELECT CAST(row_number() OVER (ORDER BY first, o_orderkey) - 1 AS BIGINT) AS position, o_orderkey FROM
    (SELECT o_orderkey, min(o_orderkey) OVER w AS first, max(o_totalprice) OVER w AS most FROM orders WINDOW w AS (PARTITION BY o_custkey)) WHERE most > 300000"""
)
def group_filter_regrouped(spark, sf_dir):
    """The rows of passing groups, group by group."""
    orders = table(spark, sf_dir, "orders", ("o_orderkey",)).select("o_orderkey", "o_custkey", "o_totalprice")
    kept = orders.group_by("o_custkey").filter({"o_totalprice": (AggFunc.MAX, lambda x: x > 300000)}, regrouped=True)
    return kept.with_position().select("position", "o_orderkey").to_spark()


@query(
    """SELECT * FROM (VALUES (0, '       n_name           size  ok   '), (1, '───────────────────────────────────'), (2, '     0 NATION_0          1.5  True '),
    (3, '   ...      ...          ...    ...'), (4, '     2 NaN       1.23457E+06  False'), (5, ''),
    (6, '[3 rows × 3 columns]'), (7, 'dtypes:'), (8, '  n_name: object'), (9, '  size: float64'), (10, '  ok: bool'), (11, '')) AS t(line, text)"""
)
def display_lines(spark, sf_dir):
    """A frame as text: first and last rows, shape and types."""
    first = table(spark, sf_dir, "nation", ("n_nationkey",)).head(1).to_spark().first()["n_name"]
    f = Frame.from_rows(spark, [(first, 1.5, True), ("x", 2.0, None), (None, 1234567.25, False)], "n_name string, size double, ok boolean")
    return _rows(spark, "line int, text string", list(enumerate(f.display_string(max_rows=2).split("\n"))))


# -- categorical -----------------------------------------------------------------------------


@query(
    """SELECT c_custkey, CAST(coalesce(code, -1) AS INTEGER) AS code FROM customer LEFT JOIN
    (SELECT v, row_number() OVER (ORDER BY first) - 1 AS code FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS v, min(c_custkey) AS first FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1))
    ON nullif(c_mktsegment, 'BUILDING') = v"""
)
def categorical_codes(spark, sf_dir):
    f = categorical.to_categorical(_segment_or_null(spark, sf_dir), "seg")
    return categorical.with_codes(f, "seg").select("c_custkey", "code").to_spark()


@query("SELECT c_mktsegment AS value, CAST(count(*) FILTER (WHERE c_mktsegment <> 'MACHINERY') AS BIGINT) AS count FROM customer GROUP BY 1")
def value_counts(spark, sf_dir):
    f = categorical.to_categorical(table(spark, sf_dir, "customer", ("c_custkey",)), "c_mktsegment")
    return categorical.value_counts(f.where(f["c_mktsegment"].is_in("BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE")), "c_mktsegment")


@query("SELECT count(DISTINCT c_mktsegment) / count(*)::DOUBLE AS ratio FROM customer")
def cardinality_ratio(spark, sf_dir):
    f = categorical.to_categorical(table(spark, sf_dir, "customer", ("c_custkey",)), "c_mktsegment")
    return _rows(spark, "ratio double", [(categorical.cardinality_ratio(f, "c_mktsegment"),)])


@query(
    """WITH d AS (SELECT v, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS code FROM (SELECT c_mktsegment AS v, min(c_custkey) AS first FROM customer GROUP BY 1))
    SELECT v AS value, true AS known, code, v AS decoded FROM d UNION ALL VALUES (NULL, true, -1, NULL), ('no such segment', false, -1, NULL)"""
)
def categorical_lookup(spark, sf_dir):
    """Codes of values, and values of codes."""
    f = categorical.to_categorical(table(spark, sf_dir, "customer", ("c_custkey",)), "c_mktsegment")
    wanted = [*categorical.categories(f, "c_mktsegment"), None, "no such segment"]
    found = [(v, *categorical.try_get_code(f, "c_mktsegment", v)) for v in wanted]
    return _rows(spark, "value string, known boolean, code int, decoded string", [(*row, categorical.decode_category(f, "c_mktsegment", row[2])) for row in found])


@query(f"SELECT c_custkey FROM {_SEG} WHERE seg = 'MACHINERY' OR seg IS NULL")
def categorical_equals(spark, sf_dir):
    f = categorical.to_categorical(_segment_or_null(spark, sf_dir), "seg")
    known, seg = categorical.categories(f, "seg"), f["seg"]
    every = [categorical.equals(seg, known, v) for v in ("MACHINERY", None, "no such segment")]
    return f.where(masks.any_(*every)).select("c_custkey").to_spark()


# -- files and streams (the same rows after a round trip) --------------------------------------


def _scratch(spark) -> str:
    from tabwright.storage import scratch_root

    return f"{scratch_root(spark)}/io-{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    from tabwright.sources.csv import load_csv, write_csv

    path = f"{_scratch(spark)}.csv"
    write_csv(table(spark, sf_dir, "customer", ("c_custkey",)), path)
    return load_csv(spark, path).to_spark()


def _lines(spark: SparkSession, lines: list[str], ending: str) -> str:
    """A text file of some lines."""
    from tabwright.sources.files import write_bytes

    path = f"{_scratch(spark)}.{ending}"
    write_bytes(spark, path, bytearray("\n".join(lines).encode()))
    return path


@query("VALUES (0, 'id', 'int'), (1, 'Column1', 'int'), (2, 'ID_1', 'string'), (3, 'a.b', 'double'), (4, 'id_2', 'timestamp_ntz')")
def csv_headers(spark, sf_dir):
    """Names from a header: trimmed, blank ones by place, ones that come again numbered."""
    from tabwright.sources.csv import load_csv

    f = load_csv(spark, _lines(spark, [' id ,,ID,a.b,"id"', "1,2,x,1.5,2024-01-31", "3,4,y,2,2024-02-01"], "csv"))
    return _rows(spark, "col0 int, col1 string, col2 string", [(i, n, f.type_of(n).simpleString()) for i, n in enumerate(f.column_names)])


@query("SELECT CAST(s_suppkey AS INTEGER) AS \"Column0\", s_name AS \"Column1\", s_acctbal AS \"Column2\" FROM supplier")
def csv_european_without_header(spark, sf_dir):
    """A preset's delimiter, and names by place where there is no header."""
    import dataclasses

    from tabwright.sources.csv import load_csv, write_csv
    from tabwright.sources.options import CsvOptions

    options = dataclasses.replace(CsvOptions.european(), has_header=False)
    path = f"{_scratch(spark)}.csv"
    write_csv(table(spark, sf_dir, "supplier", ("s_suppkey",)).select("s_suppkey", "s_name", "s_acctbal"), path, options)
    return load_csv(spark, path, options).to_spark()


@query("SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_orderdate FROM orders")
def csv_dates(spark, sf_dir):
    """Times written as text and inferred again."""
    from tabwright.sources.csv import load_csv, write_csv

    path = f"{_scratch(spark)}.csv"
    write_csv(table(spark, sf_dir, "orders", ("o_orderkey",)).select("o_orderkey", "o_orderdate"), path)
    return load_csv(spark, path).to_spark()


@query("VALUES (0.0, false), (0.25, false), (0.5, true), (1.0, false)")
def load_option_thresholds(spark, sf_dir):
    """Which thresholds make two values in six rows categorical; thresholds beyond 0 and 1 are refused."""
    from tabwright.sources.csv import load_csv
    from tabwright.sources.options import LoadOptions

    path = _lines(spark, ["k", "a", "b", "a", "b", "a", "b"], "csv")
    found = [(t, load_csv(spark, path, LoadOptions(categorical_threshold=t)).is_categorical("k")) for t in (0.0, 0.25, 0.5, 1.0)]
    for wrong in (-0.1, 1.1):
        try:
            LoadOptions(categorical_threshold=wrong)
            found.append((wrong, False))
        except ValueError:
            pass
    return _rows(spark, "col0 double, col1 boolean", found)


@query("SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) AS p_brand, p_name FROM part")
def inferrers_in_front(spark, sf_dir):
    """Types from cells, with a type of one's own tried first."""
    from tabwright.operators.position import with_scan_position
    from tabwright.sources.inference import INFERRERS, Cell, infer

    data = with_scan_position(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name"))
    brand = ("int_of_brand", lambda c: F.regexp_extract(F.when(F.regexp_like(c.text, F.lit("^Brand#[0-9]+$")), c.text), "([0-9]+)", 1).try_cast("int"))
    cells = {"p_brand": Cell(F.col("p_brand")), "p_name": Cell(F.col("p_name")), "p_partkey": Cell(F.col("p_partkey").cast("string"))}
    f = infer(data, cells, 1.0, inferrers=[brand, *INFERRERS])
    return f.select("p_partkey", "p_brand", "p_name").to_spark().withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("""VALUES ('['), ('  {"x":1.5,"t":"2024-01-31T10:20:30.0000000","s":"a\\"b"}'), (','), ('  {"x":null,"t":null,"s":null}'), (','), ('  {"x":null,"t":null,"s":""}'), (''), (']')""")
def json_values(spark, sf_dir):
    """Cells as JSON: NaN and infinities null, times in round-trip form."""
    from tabwright.sources.json import write_json

    rows = [(1.5, dt.datetime(2024, 1, 31, 10, 20, 30), 'a"b'), (float("nan"), None, None), (float("inf"), None, "")]
    path = f"{_scratch(spark)}.json"
    write_json(Frame.from_rows(spark, rows, "x double, t timestamp_ntz, s string"), path)
    return spark.read.text(path).toDF("col0")


def _json_round_trip(orientation: str):
    name = f"json_{orientation}_round_trip"

    def run(spark, sf_dir):
        from tabwright.sources.json import load_json, write_json
        from tabwright.sources.options import JsonOrientation

        path = f"{_scratch(spark)}.json"
        write_json(table(spark, sf_dir, "supplier", ("s_suppkey",)), path, JsonOrientation(orientation))
        return load_json(spark, path).to_spark()

    run.__name__, run.__doc__ = name, f"Suppliers written and read as JSON {orientation}."
    QUERIES[name] = run
    ORACLES[name] = "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


for _orientation in ("records", "columns", "split"):
    _json_round_trip(_orientation)


@query("SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def excel_round_trip(spark, sf_dir):
    from tabwright.sources.excel import load_excel, write_excel

    path = f"{_scratch(spark)}.xlsx"
    write_excel(table(spark, sf_dir, "supplier", ("s_suppkey",)), path)
    return load_excel(spark, path).to_spark()


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE value > 0 GROUP BY 1")
def stream_event_totals(spark, sf_dir):
    """The events as a stream of files: a running aggregate in memory, read when the stream has caught up."""
    totals = live.running_totals(spark, f"{sf_dir}/events.parquet", "event_type", "value")
    return totals.withColumn("total", F.round("total", 6))


__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "Series"]
