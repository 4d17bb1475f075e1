"""Postings presented from order/line-item star tables (Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.functions.columns import choose
from paylens.model import RAW_COLUMNS, SIZE_LEVELS

JOIN_KEYS = {
    "nation": ["n_nationkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "part": ["p_partkey"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
}

# The columns read. A given schema spares a job per table that would infer it.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
}

# How the star tables are read as postings.
TITLE_PREFIX = {
    "1-URGENT": "Senior ",
    "2-HIGH": "Lead ",
    "3-MEDIUM": "",
    "4-NOT SPECIFIED": "Jr. ",
    "5-LOW": "Associate ",
}
TITLE_BASE = [
    "Data Scientist",
    "Data Engineer",
    "Data Analyst",
    "Machine Learning Engineer",
    "Director of Analytics",
    "Analytics Manager",
    "Statistician",
    "VP, Data Science",
]
# Expressions of one table are evaluated there, once per row of the small table.
COLUMNS = {
    "nation": {"job_state": "concat(' ', n_name, ' ')"},
    "customer": {
        "ownership": "CASE c_custkey % 7 WHEN 0 THEN '-1' WHEN 1 THEN 'Unknown' ELSE c_mktsegment END",
    },
    "orders": {
        "title_prefix": choose("o_orderpriority", TITLE_PREFIX),
    },
    "part": {
        "title_base": choose("p_size % 8", dict(enumerate(TITLE_BASE))),
        "sector": "CASE WHEN p_brand = 'Brand#1' THEN '-1' ELSE p_brand END",
        "spark": "CAST(p_size % 4 = 0 AS int)",
    },
    "supplier": {
        "company_name": "s_name",
        "size": choose("CAST(s_suppkey % 9 AS int)", dict(enumerate([*SIZE_LEVELS, "Unknown", "-1"]))),
    },
    "lineitem": {
        "min_salary": "l_extendedprice / 400 * (1 - l_discount)",
        "max_salary": "l_extendedprice / 400 * (1 + l_tax + 0.05D)",
        "rating": "CASE WHEN l_linenumber = 7 THEN -1D ELSE 1 + CAST(l_partkey % 41 AS double) / 10 END",
        "age": "CAST(CASE WHEN l_linenumber = 6 THEN -1 ELSE l_partkey * 7 % 121 END AS double)",
        "python_yn": "CAST(l_quantity >= 25 AS int)",
        "r_yn": "CAST(l_quantity % 20 = 0 AS int)",
        "aws": "CAST(l_linenumber <= 2 AS int)",
        "excel": "CAST(l_discount >= 0.05D AS int)",
        "employer_provided": "CAST(l_returnflag = 'A' AS int)",
        "hourly": "CAST(l_linestatus = 'F' AS int)",
    },
}


def postings_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw posting per line item.

    The order side is joined to its customer first, so the line items, by far
    the largest table, are shuffled once per large key and never carry the
    customer lookup. Orders and line items both grow with the data and are
    always merge joined. ``nation`` has one row per country and is marked for
    broadcast. The other sides are broadcast by Spark only when their size is
    below its threshold, else merge joined; adaptive execution splits hot keys.
    """

    def table(name):
        rows = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
        return rows.selectExpr(*JOIN_KEYS[name], *[f"{expr} AS {col}" for col, expr in COLUMNS[name].items()])

    customer = table("customer").join(F.broadcast(table("nation")), F.expr("c_nationkey = n_nationkey"))
    orders = table("orders").join(customer, F.expr("o_custkey = c_custkey"))
    rows = (
        table("lineitem")
        .join(orders.hint("merge"), F.expr("l_orderkey = o_orderkey"))
        .join(table("part"), F.expr("l_partkey = p_partkey"))
        .join(table("supplier"), F.expr("l_suppkey = s_suppkey"))
    )
    return rows.selectExpr(
        "*",
        "concat(title_prefix, title_base) AS job_title",
        "(min_salary + max_salary) / 2 AS avg_salary",
        "CAST(s_nationkey = c_nationkey AS int) AS same_state",
    ).select(*RAW_COLUMNS)
