"""The driver's tables seen as the three record kinds of the library.

Each function joins only what the requested columns need, so a query reads the
tables and columns it uses. ``VIEWS`` says the same in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmart import schemas as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submissions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One submission per line item; its event is the nation of the supplier."""
    wanted = list(columns) or [
        S.ORG, S.TITLE, S.PROJECT, S.URL, S.CREATED, S.BUILT_WITH, S.EXTRA_MEMBERS,
    ]
    line = table(spark, sf_dir, "lineitem")
    if {S.TITLE, S.URL} & set(wanted):
        supplier = table(spark, sf_dir, "supplier")
        nation = table(spark, sf_dir, "nation")
        line = line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        line = line.join(nation, line.s_nationkey == nation.n_nationkey)
    if {S.ORG, S.BUILT_WITH} & set(wanted):
        part = table(spark, sf_dir, "part")
        line = line.join(part, line.l_partkey == part.p_partkey)
    number = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")
    )
    build = {
        S.ORG: lambda: F.when(F.col("l_orderkey") % 3 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")),
        S.TITLE: lambda: F.col("n_name"),
        S.PROJECT: lambda: F.concat(F.lit("Project "), number),
        S.URL: lambda: F.concat(
            F.lit("https://"), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))),
            F.lit(".devpost.com/submissions/"), number,
        ),
        S.CREATED: lambda: F.col("l_shipdate"),
        S.BUILT_WITH: lambda: F.concat(
            F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(" ,,("), F.col("p_type"), F.lit(")")
        ),
        S.EXTRA_MEMBERS: lambda: F.when(F.col("l_quantity") <= 45, F.col("l_quantity") % 7),
    }
    return line.select(*[build[c]().alias(c) for c in wanted])


def registrants(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One registrant per customer."""
    wanted = list(columns) or [
        S.EVENT, S.USER, S.COUNTRY, S.EXPERIENCE, S.SKILLS, S.OCCUPATION, S.SPECIALTY,
    ]
    person = table(spark, sf_dir, "customer")
    if {S.EVENT, S.COUNTRY} & set(wanted):
        nation = table(spark, sf_dir, "nation")
        person = person.join(nation, person.c_nationkey == nation.n_nationkey)
    if {S.EXPERIENCE, S.SKILLS} & set(wanted):
        part = table(spark, sf_dir, "part")
        person = person.join(part, person.c_custkey == part.p_partkey, "left")
    key = F.col("c_custkey")
    build = {
        S.EVENT: lambda: F.col("n_name"),
        S.USER: lambda: key.cast("string"),
        S.COUNTRY: lambda: F.when(key % 10 == 0, F.lit("")).otherwise(F.col("n_name")),
        S.EXPERIENCE: lambda: F.when(key % 7 != 0, F.col("p_size") * 1.25 - 1),
        S.SKILLS: lambda: F.concat_ws(";", "p_name", "p_type", "p_brand"),
        S.OCCUPATION: lambda: F.col("c_mktsegment"),
        S.SPECIALTY: lambda: F.when(key % 3 == 0, F.lit("Student"))
        .when(key % 3 == 1, F.lit("Professional"))
        .otherwise(F.lit("Post Grad")),
    }
    return person.select(*[build[c]().alias(c) for c in wanted])


def event_list(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One event per order, with organizer names in several spellings."""
    wanted = list(columns) or [
        S.SRC_NAME, S.SRC_ORG, S.SRC_URL, S.SRC_DATE, S.SRC_PARTICIPANTS, S.SRC_SUBMISSIONS, S.SRC_MODE,
    ]
    order = table(spark, sf_dir, "orders")
    if S.SRC_ORG in wanted:
        customer = table(spark, sf_dir, "customer")
        order = order.join(customer, order.o_custkey == customer.c_custkey)
    key, name = F.col("o_orderkey"), F.col("c_mktsegment")
    build = {
        S.SRC_NAME: lambda: F.concat(F.lit("Event "), key),
        S.SRC_ORG: lambda: F.when(key % 3 == 0, F.lower(name))
        .when(key % 5 == 0, F.concat(F.lit(" "), name, F.lit(" ")))
        .otherwise(name),
        S.SRC_URL: lambda: F.concat(F.lit("https://event-"), key, F.lit(".devpost.com")),
        S.SRC_DATE: lambda: F.col("o_orderdate"),
        S.SRC_PARTICIPANTS: lambda: F.floor(F.col("o_totalprice") / 1000).cast("long"),
        S.SRC_SUBMISSIONS: lambda: F.col("o_custkey") % 50,
        S.SRC_MODE: lambda: F.when(key % 4 == 0, F.lit("In person")).otherwise(F.lit("Virtual")),
    }
    return order.select(*[build[c]().alias(c) for c in wanted])


def nation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authoritative list for the events of :func:`submissions`, one per nation.

    The counts are moved so that every reconciliation outcome occurs: NATION_24 has
    records but no entry, Ghost Event the reverse, and NATION_5 is spelled differently.
    """
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    supplier = table(spark, sf_dir, "supplier")
    subs = (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .groupBy("s_nationkey")
        .agg(F.sum("n").alias("subs"))
    )
    regs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("regs"))
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    rows = (
        nation.filter(key != 24)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .join(subs, key == F.col("s_nationkey"), "left")
        .join(regs, key == F.col("c_nationkey"), "left")
        .select(
            F.when(key == 5, F.lower("n_name")).otherwise(F.col("n_name")).alias(S.SRC_NAME),
            F.col("r_name").alias(S.SRC_ORG),
            F.concat(F.lit("https://"), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))), F.lit(".devpost.com")).alias(S.SRC_URL),
            F.make_timestamp_ntz(F.lit(2024), key % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias(S.SRC_DATE),
            F.when(key % 4 == 0, F.coalesce("regs", F.lit(0)) - 1)
            .otherwise(F.coalesce("regs", F.lit(0)) + 5)
            .alias(S.SRC_PARTICIPANTS),
            F.when(key % 3 == 0, F.coalesce("subs", F.lit(0)) - 1)
            .when(key % 3 == 1, F.coalesce("subs", F.lit(0)) * 2)
            .otherwise(F.coalesce("subs", F.lit(0)))
            .alias(S.SRC_SUBMISSIONS),
            F.lit("Virtual").alias(S.SRC_MODE),
        )
    )
    ghost = nation.filter(key == 0).select(
        F.lit("Ghost Event").alias(S.SRC_NAME), F.lit("NOWHERE").alias(S.SRC_ORG),
        F.lit(None).cast("string").alias(S.SRC_URL), F.lit(None).cast("timestamp_ntz").alias(S.SRC_DATE),
        F.lit(10).cast("long").alias(S.SRC_PARTICIPANTS), F.lit(10).cast("long").alias(S.SRC_SUBMISSIONS),
        F.lit("Virtual").alias(S.SRC_MODE),
    )
    return rows.unionByName(ghost)


# ---- the same in DuckDB SQL ----------------------------------------------------

VIEWS = {
    "sub": """
select case when l_orderkey % 3 = 0 then lower(p_brand) else p_brand end as org,
       n_name as title,
       concat('Project ', concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))) as project,
       concat('https://', lower(replace(n_name, '_', '-')), '.devpost.com/submissions/',
              concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))) as url,
       l_shipdate as created,
       concat(replace(p_name, ' ', ', '), ' ,,(', p_type, ')') as built_with,
       case when l_quantity <= 45 then l_quantity % 7 end as extra
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
join part on l_partkey = p_partkey""",
    "reg": """
select n_name as event, cast(c_custkey as varchar) as user_id,
       case when c_custkey % 10 = 0 then '' else n_name end as country,
       case when c_custkey % 7 <> 0 then p_size * 1.25 - 1 end::double as experience,
       concat_ws(';', p_name, p_type, p_brand) as skills, c_mktsegment as occupation,
       case c_custkey % 3 when 0 then 'Student' when 1 then 'Professional' else 'Post Grad' end as specialty
from customer join nation on c_nationkey = n_nationkey left join part on p_partkey = c_custkey""",
    "src": """
select concat('Event ', o_orderkey) as name,
       case when o_orderkey % 3 = 0 then lower(c_mktsegment)
            when o_orderkey % 5 = 0 then concat(' ', c_mktsegment, ' ') else c_mktsegment end as org,
       concat('https://event-', o_orderkey, '.devpost.com') as url, o_orderdate as published,
       cast(floor(o_totalprice / 1000) as bigint) as participants, o_custkey % 50 as subs,
       case when o_orderkey % 4 = 0 then 'In person' else 'Virtual' end as mode
from orders join customer on o_custkey = c_custkey""",
    "srcn": "select * replace (trim(org) as org) from src",
    "nat": """
select case when n_nationkey = 5 then lower(n_name) else n_name end as name, r_name as org,
       concat('https://', lower(replace(n_name, '_', '-')), '.devpost.com') as url,
       make_timestamp(2024, n_nationkey % 12 + 1, 1, 0, 0, 0) as published,
       case when n_nationkey % 4 = 0 then coalesce(g.n, 0) - 1 else coalesce(g.n, 0) + 5 end as participants,
       case n_nationkey % 3 when 0 then coalesce(s.n, 0) - 1 when 1 then coalesce(s.n, 0) * 2
            else coalesce(s.n, 0) end as subs
from nation join region on n_regionkey = r_regionkey
left join (select s_nationkey k, count(*) n from lineitem join supplier on l_suppkey = s_suppkey group by 1) s
       on s.k = n_nationkey
left join (select c_nationkey k, count(*) n from customer group by 1) g on g.k = n_nationkey
where n_nationkey <> 24
union all select 'Ghost Event', 'NOWHERE', null, null, 10, 10""",
}
# Views a view is built on.
_NEEDS = {"srcn": ["src"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the views it uses."""
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in _NEEDS.get(name, []) + [name] if n not in ordered]
    head = ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"
