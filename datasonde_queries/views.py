"""Views over the given tables that add the dirt the tables lack.

A view is a list of select expressions read by Spark and by the SQL side alike.
All rows of the table are kept; only values are changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

# name: (table, expressions for both engines)
VIEWS: dict[str, tuple[str, list[str]]] = {
    # values missing in two columns, sometimes together
    "orders_gaps": (
        "orders",
        [
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice",
            "o_orderdate",
            "case when o_orderkey % 11 = 0 or (o_orderstatus = 'F' and o_orderkey % 3 = 0) then null "
            "else o_orderpriority end as o_orderpriority",
        ],
    ),
    # only the two columns with gaps, so that some rows are empty
    "orders_sparse": (
        "orders",
        [
            "case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice",
            "case when o_orderkey % 11 = 0 or (o_orderstatus = 'F' and o_orderkey % 3 = 0) then null "
            "else o_orderpriority end as o_orderpriority",
            "case when o_orderkey % 2 = 0 then null else o_orderstatus end as o_orderstatus",
        ],
    ),
    "orders_flags": (
        "orders",
        [
            "o_orderkey",
            "o_totalprice",
            "o_totalprice > 250000 as is_large",
            "case when o_orderkey % 10 = 0 then 'web' else 'store' end as channel",
            "o_orderkey % 9 = 0 as is_gift",
        ],
    ),
    "lineitem_sentinel": (
        "lineitem",
        [
            "l_orderkey",
            "case when l_orderkey % 13 = 0 then cast(-999 as double) else l_quantity end as l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_returnflag",
        ],
    ),
    # columns that move together, one of them not along a line
    "lineitem_money": (
        "lineitem",
        [
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_extendedprice * (1 - l_discount) as revenue",
            "l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge",
            "power(l_quantity / 50, 100) as peak",
        ],
    ),
    # the same with missing values in two of them
    "lineitem_money_gaps": (
        "lineitem",
        [
            "l_quantity",
            "case when l_orderkey % 6 = 0 then null else l_extendedprice end as l_extendedprice",
            "l_discount",
            "case when l_orderkey % 5 = 0 then null else l_extendedprice * (1 - l_discount) end as revenue",
            "power(l_quantity / 50, 100) as peak",
        ],
    ),
    # categories that say something about the numbers and about each other
    "lineitem_bands": (
        "lineitem",
        [
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_returnflag",
            "l_linestatus",
            "case when l_quantity <= 10 then 'small' when l_quantity <= 30 then 'medium' else 'large' end as band",
            "case when l_quantity <= 25 then 'low' else 'high' end as half",
            "case when l_quantity <= 25 then 'L' else 'H' end as side",
            "case when l_orderkey % 8 = 0 then null when l_extendedprice < 30000 then 'cheap' else 'dear' end as price_band",
        ],
    ),
    "customer_const": (
        "customer",
        ["c_custkey", "c_name", "c_acctbal", "'fixed' as c_constant", "cast(null as string) as c_empty"],
    ),
    "customer_pii": (
        "customer",
        [
            "c_custkey",
            "concat('user', c_custkey, '@example.com') as email",
            "concat(lpad(cast(c_custkey % 900 + 100 as string), 3, '0'), '-', lpad(cast(c_custkey % 90 + 10 as string), 2, '0'), "
            "'-', lpad(cast(c_custkey % 9000 + 1000 as string), 4, '0')) as ssn",
            "concat('4000-1234-', lpad(cast(c_custkey % 10000 as string), 4, '0'), '-5678') as card",
            "concat('10.', c_custkey % 256, '.', c_nationkey, '.', c_custkey % 300) as ip",
            "concat('(212) 555-', lpad(cast(c_custkey % 10000 as string), 4, '0')) as phone",
            "case when c_custkey % 2 = 0 then concat('user', c_custkey, '@example.com') else c_name end as half_email",
            "c_mktsegment",
        ],
    ),
}

# Numbers, dates and categories written as untidy text; the two engines format differently.
CUSTOMER_TEXT_SPARK = [
    "c_custkey",
    "case when c_custkey % 9 = 0 then 'n/a' else format_number(c_acctbal, 2) end as balance_text",
    "case when c_custkey % 5 = 0 then concat(' ', c_mktsegment, ' ') when c_custkey % 3 = 0 then lower(c_mktsegment) "
    "else c_mktsegment end as segment",
    "date_format(date_add(date'2020-01-01', cast(c_custkey % 700 as int)), 'yyyy-MM-dd') as joined",
    "c_name",
]
CUSTOMER_TEXT_SQL = (
    "select c_custkey, case when c_custkey % 9 = 0 then 'n/a' else format('{:,.2f}', c_acctbal) end as balance_text, "
    "case when c_custkey % 5 = 0 then concat(' ', c_mktsegment, ' ') when c_custkey % 3 = 0 then lower(c_mktsegment) "
    "else c_mktsegment end as segment, "
    "strftime(date '2020-01-01' + cast(c_custkey % 700 as integer), '%Y-%m-%d') as joined, c_name from customer"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table or a view over one."""
    if name in VIEWS:
        source, expressions = VIEWS[name]
        return spark.read.parquet(f"{sf}/{source}.parquet").selectExpr(*expressions)
    if name == "customer_text":
        return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(*CUSTOMER_TEXT_SPARK)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view_sql(name: str) -> str:
    if name == "customer_text":
        return CUSTOMER_TEXT_SQL
    if name in VIEWS:
        source, expressions = VIEWS[name]
        return f"select {', '.join(expressions)} from {source}"
    return f"select * from {name}"


def over(name: str, sql: str) -> str:
    """``sql`` with ``v`` standing for the table or view."""
    return f"with v as ({view_sql(name)})\n{sql}" if not sql.lstrip().startswith("with ") else (
        f"with v as ({view_sql(name)}),\n{sql.lstrip()[5:]}"
    )
