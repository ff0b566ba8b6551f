"""Cleaning, classification, deduplication, ledger views."""

from __future__ import annotations

from adapters import registrants, submissions, table
from eventmart import schemas as S
from eventmart.functions.text import clean_text
from eventmart.functions.synonyms import read_synonyms
from eventmart.operators import clean, dedup, filters, ledger
from eventmart.session import run_dir
from eventmart.sources.text_exports import classify
from pyspark.sql import functions as F

from .registry import SPACE, query


@query("clean_documents", f"select doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) as text from documents")
def clean_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


@query(
    "clean_registrants",
    """select event, user_id, country, case when experience <= 50 then experience end as experience,
 skills, occupation, specialty from (select event, user_id, country, experience,
 coalesce(skills, '') as skills, occupation, specialty from reg)""",
    ("reg",),
)
def clean_registrants(spark, sf_dir):
    rows = registrants(spark, sf_dir)
    messy = rows.withColumns({
        S.USER: F.concat(F.col(f"`{S.USER}`"), F.lit(".0")),
        S.OCCUPATION: F.concat(F.lit(" \t"), S.OCCUPATION, F.lit("  ")),
        S.EXPERIENCE: F.col(f"`{S.EXPERIENCE}`").cast("string"),
        S.INTERESTS: F.lit("x"),
    })
    cleaned = clean.clean_registrants(messy)
    return cleaned.toDF("event", "user_id", "country", "experience", "skills", "occupation", "specialty")


@query(
    "merge_duplicate_columns",
    """select o_orderkey as key, case when o_orderkey % 4 = 0 then 'a' || o_custkey when o_orderkey % 3 = 0 then 'b' || o_custkey
 else 'c' || o_custkey end as "Created At" from orders""",
)
def merge_duplicate_columns(spark, sf_dir):
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    gap = F.when(key % 2 == 0, F.lit("")).otherwise(F.lit("None"))
    rows = table(spark, sf_dir, "orders").select(
        key.alias("key"),
        F.when(key % 4 == 0, F.concat(F.lit("a"), who)).otherwise(gap).alias("Created At"),
        F.when(key % 3 == 0, F.concat(F.lit("b"), who)).alias("Created At.1"),
        F.concat(F.lit("c"), who).alias("Created At.2"),
    )
    return clean.merge_repeated_columns(rows, "Created At")


@query(
    "coerce_types",
    """select o_orderkey as key, case o_orderkey % 5 when 3 then null when 2 then o_orderdate - interval 2 hour else o_orderdate end as moment,
 case when o_orderkey % 4 <> 1 then o_totalprice end as price from orders""",
)
def coerce_types(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("key"),
        F.when(key % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 5 == 1, F.date_format(day, "M/d/yyyy"))
        .when(key % 5 == 2, F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(key % 5 == 3, F.lit("bad"))
        .otherwise(F.date_format(day, "MMM d, yyyy")).alias("moment"),
        F.when(key % 4 != 1, F.col("o_totalprice").cast("string")).otherwise("n/a").alias("price"),
    )
    return clean.coerce_numbers(clean.coerce_dates(rows, ["moment"]), ["price"])


_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "dedup_keep_first",
    f"""select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(_LINE)}) = 1""",
)
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE)


@query(
    "dedup_keys",
    """select url as key, 'submission' as kind from sub union all select concat(event, '|', user_id), 'registrant' from reg""",
    ("sub", "reg"),
)
def dedup_keys(spark, sf_dir):
    subs = clean.with_dedup_key(submissions(spark, sf_dir, S.URL), "submission")
    people = registrants(spark, sf_dir, S.EVENT, S.USER)
    people = clean.with_dedup_key(people.withColumn(S.USER, F.col(f"`{S.USER}`").cast("double")), "registrant")
    return subs.select(F.col(S.DEDUP_KEY).alias("key"), F.lit("submission").alias("kind")).unionByName(
        people.select(F.col(S.DEDUP_KEY).alias("key"), F.lit("registrant").alias("kind"))
    )


# ---- headers: one file per customer -------------------------------------------------


@query(
    "repair_headers",
    """select c_custkey as key, case c_custkey % 4 when 0 then concat(c_name, '|', c_mktsegment, '|', c_mktsegment, '.1')
 when 1 then concat(c_name, '|nan|', c_mktsegment) when 2 then concat(c_name, '|a b|', c_name, '.1|', c_name, '.2')
 else concat(c_name, '|', c_mktsegment) end as names from customer""",
)
def repair_headers(spark, sf_dir):
    key, name, other = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    pad = F.concat(F.lit("﻿  "), name, F.lit(" "))
    nothing = F.lit(None).cast("array<string>")
    first = (
        F.when(key % 4 == 0, F.array(name, other, F.concat(other, F.lit("  "))))
        .when(key % 4 == 1, F.array(F.lit("Unnamed: 0"), F.lit("x"), F.lit("y")))
        .when(key % 4 == 2, F.array(pad, F.lit("a \t b"), name, name))
        .otherwise(F.array(F.lit(" "), F.lit("y")))
    )
    second = (
        F.when(key % 4 == 1, F.array(name, F.lit(None), other)).when(key % 4 == 3, F.array(name, other)).otherwise(nothing)
    )
    rows = table(spark, sf_dir, "customer").select(key.alias("key"), clean.repaired_header(first, second).alias("n"))
    return rows.select("key", F.array_join("n", "|").alias("names"))


_KINDS = """['Organization Name', 'challenge title', 'Project  Title']
['Submission Url', 'Organization Name', 'Built With', 'Hackathon Name', 'User ID', 'Country']
['User ID', 'Country', 'Skills']
['user id', 'x']
['x', 'submission url']
['x', 'y']""".split("\n")


@query(
    "classify_files",
    """select c_custkey as key, case c_custkey % 6 when 0 then 'submission' when 1 then 'submission' when 2 then 'registrant'
 when 3 then 'registrant' when 4 then 'submission' else case c_custkey % 4 when 0 then 'registrant' when 1 then 'submission' else 'unknown' end
 end as kind from customer""",
)
def classify_files(spark, sf_dir):
    key = F.col("c_custkey")
    names = F
    for position, text in enumerate(_KINDS):
        names = names.when(key % 6 == position, F.expr(f"array{text.replace('[', '(').replace(']', ')')}"))
    file_name = F.concat(
        F.when(key % 4 == 0, "My-Registrants-").when(key % 4 == 1, "SUBMISSION ").otherwise("other"), F.col("c_name")
    )
    return table(spark, sf_dir, "customer").select(key.alias("key"), classify(names, file_name).alias("kind"))


# ---- ledger: one file per user of the event stream ------------------------------------

LEDGER_SQL = """ev as (select sha256(cast(user_id as varchar)) as file_hash, concat('File-', user_id, '.csv') as file_name,
 case when user_id % 2 = 0 then 'submission' else 'registrant' end as file_type,
 case when event_type = 'signup' and event_id % 50 = 0 then 'deleted' when event_type in ('click', 'purchase') then 'processing'
  when event_type = 'error' then 'failed' else 'completed' end as status,
 cast(floor(value) as bigint) as row_count, concat('E', event_id) as error_message, ts as event_ts, event_id as event_seq,
 concat('/in/', event_id, '/File-', user_id, '.csv') as path from events),
cut as (select file_hash, max((event_ts, event_seq)) as c from ev where status = 'deleted' group by 1),
live as (select ev.*, (event_ts, event_seq) as o from ev left join cut using (file_hash)
 where status <> 'deleted' and (c is null or (event_ts, event_seq) > c)),
jobs as (select cast(('0x' || substr(file_hash, 1, 15)) as bigint) as id, file_hash, arg_min(file_name, o) as file_name,
 arg_min(file_type, o) as file_type, arg_max(status, o) as status,
 coalesce(arg_max(row_count, o) filter (status = 'completed'), 0) as row_count,
 case when arg_max(status, o) = 'failed' then arg_max(error_message, o) end as error_message, min(event_ts) as created_at,
 max(event_ts) filter (status in ('completed', 'failed')) as completed_at,
 coalesce(arg_max(path, o) filter (status = 'processing'), arg_max(path, o)) as retry_path,
 greatest(count(*) filter (status = 'processing'), 1) as attempts from live group by file_hash)"""


def events_of(spark, sf_dir):
    """File events made of the event stream."""
    user, kind, number = F.col("user_id"), F.col("event_type"), F.col("event_id")
    name = F.concat(F.lit("File-"), user, F.lit(".csv"))
    return table(spark, sf_dir, "events").select(
        F.sha2(user.cast("string").cast("binary"), 256).alias("file_hash"),
        name.alias("file_name"),
        F.when(user % 2 == 0, "submission").otherwise("registrant").alias("file_type"),
        F.when((kind == "signup") & (number % 50 == 0), "deleted")
        .when(kind.isin("click", "purchase"), "processing")
        .when(kind == "error", "failed").otherwise("completed").alias("status"),
        F.floor("value").alias("row_count"),
        F.concat(F.lit("E"), number).alias("error_message"),
        F.col("ts").alias("event_ts"),
        number.alias("event_seq"),
        F.concat(F.lit("/in/"), number, F.lit("/"), name).alias("path"),
    )


def jobs(spark, sf_dir):
    return ledger.state(events_of(spark, sf_dir))


@query("ledger_state", f"with {LEDGER_SQL} select * from jobs")
def ledger_state(spark, sf_dir):
    return jobs(spark, sf_dir)


@query(
    "ledger_stats",
    f"""with {LEDGER_SQL} select count(*) as total_jobs, count(*) filter (status = 'completed') as completed_jobs,
 count(*) filter (status = 'failed') as failed_jobs, count(*) filter (status = 'processing') as processing_jobs,
 cast(coalesce(sum(row_count), 0) as bigint) as total_rows from jobs""",
)
def ledger_stats(spark, sf_dir):
    return ledger.statistics(jobs(spark, sf_dir))


@query(
    "ledger_by_type",
    f"""with {LEDGER_SQL} select file_type, count(*) filter (status = 'completed') as completed,
 count(*) filter (status = 'failed') as failed, count(*) filter (status = 'processing') as processing from jobs group by 1""",
)
def ledger_by_type(spark, sf_dir):
    return ledger.by_type(jobs(spark, sf_dir))


@query(
    "ledger_delete",
    f"""with {LEDGER_SQL} select status, count(*) as n, cast(sum(row_count) as bigint) as row_total from jobs
 where status <> 'failed' group by 1""",
)
def ledger_delete(spark, sf_dir):
    """All failed jobs deleted by tombstones in a stored ledger, which is then read again."""
    path = f"{run_dir(spark, 'ledger')}/events"
    every = events_of(spark, sf_dir)
    ledger.append(every, path)
    last = every.agg(F.max("event_seq")).first()[0]
    ledger.append(ledger.deletions(ledger.state(ledger.read(spark, path)), last + 1, status="failed"), path)
    left = ledger.state(ledger.read(spark, path))
    return left.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("row_total"))


@query(
    "synonym_file",
    """select 'technologies' as domain, lower(p_brand) as alias, min(lower(p_type)) as canonical from part group by 2
 union all select 'skills', lower(p_type), min(lower(p_brand)) from part group by 2""",
)
def synonym_file(spark, sf_dir):
    """A dictionary file made of parts, read as rows."""
    part = table(spark, sf_dir, "part")

    def aliases(alias, canonical):
        pairs = part.groupBy(F.lower(alias).alias("a")).agg(F.min(F.lower(canonical)).alias("c"))
        return pairs.agg(F.map_from_entries(F.collect_list(F.struct("a", "c"))).alias("m")).select("m")

    both = aliases("p_brand", "p_type").withColumnRenamed("m", "technologies").crossJoin(aliases("p_type", "p_brand").withColumnRenamed("m", "skills"))
    folder = run_dir(spark, "synonyms")
    both.select(F.to_json(F.struct("technologies", "skills"))).coalesce(1).write.text(folder)
    return read_synonyms(spark, folder)


@query(
    "ledger_history",
    f"""with {LEDGER_SQL} select * from jobs where status in ('failed', 'completed') and file_type in ('submission')
 and contains(lower(file_name), 'file-1') order by created_at desc, id desc""",
)
def ledger_history(spark, sf_dir):
    found = filters.history(jobs(spark, sf_dir), ["failed", "completed"], ["submission"], "FILE-1")
    return ledger.newest_first(found)


@query(
    "ledger_history_regex",
    f"""with {LEDGER_SQL} select * from jobs where status = 'failed' and regexp_matches(file_name, '(?i)^FILE-[0-9]*[05]\\b')
 order by created_at desc, id desc""",
)
def ledger_history_regex(spark, sf_dir):
    return ledger.newest_first(filters.history(jobs(spark, sf_dir), ["failed"], search=r"^FILE-[0-9]*[05]\b", regex=True))


@query("ledger_recent", f"with {LEDGER_SQL} select * from jobs order by created_at desc, id desc limit 10")
def ledger_recent(spark, sf_dir):
    return ledger.newest_first(jobs(spark, sf_dir), 10)


@query(
    "retry_candidates",
    f"""with {LEDGER_SQL} select * from jobs where status = 'failed' and file_hash in
 (select sha256(cast(c_custkey as varchar)) from customer where c_acctbal > 0)""",
)
def retry_candidates(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    hashes = wanted.select(F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256).alias("file_hash"))
    return ledger.retry_candidates(jobs(spark, sf_dir), hashes)


@query(
    "files_to_process",
    f"""with {LEDGER_SQL} select c_custkey as key from customer where sha256(cast(c_custkey as varchar)) not in
 (select file_hash from jobs where status = 'completed')""",
)
def files_to_process(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256).alias("file_hash")
    )
    return ledger.unprocessed(files, jobs(spark, sf_dir)).select("key")
