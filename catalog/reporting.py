"""Report bundles: written to the shared folder, listed by table and rows."""

from __future__ import annotations

from adapters import nation_events, registrants, submissions
from eventmart import schemas as S
from eventmart.operators import entities, reconcile, samples
from eventmart.plans import reports
from eventmart.session import materialise, run_dir
from eventmart.sinks.bundles import export_history, write_bundle
from pyspark.sql import functions as F

from .counting import EXPERIENCE_SQL, LISTING_SQL, TEAM_SQL
from .entities import LOOKUP_SQL, SHORT_SQL, dimension, short_entries
from .registry import SYNONYMS, distribution_sql, query, tokens_sql, top_tokens_sql


def tables(spark, sf_dir):
    subs = submissions(spark, sf_dir, S.ORG, S.TITLE, S.PROJECT, S.CREATED, S.BUILT_WITH, S.EXTRA_MEMBERS)
    people = registrants(spark, sf_dir, S.COUNTRY, S.EXPERIENCE, S.SKILLS, S.OCCUPATION, S.SPECIALTY)
    return reports.Tables(subs, people, SYNONYMS, SYNONYMS)


def listing(spark, bundle, name):
    manifest = write_bundle(spark, bundle, f"{run_dir(spark, 'bundles')}/{name}")
    return manifest.select("table", F.col("rows").alias("n"))


def _rows(limit, days, tech=None, skill=None):
    def cut(count, n):
        return f"least({count}, {n})" if n else count

    return {
        "Top Technologies": cut("tech.n", tech or limit),
        "Top Skills": cut("skill.n", skill or limit),
        "Submissions by Hackathon": "(select count(distinct title) from sub)",
        "Team Size Distribution": "(select count(distinct coalesce(extra, 0)) from sub)",
        "Country Distribution": cut("(select count(distinct country) from reg)", limit),
        "Occupation Breakdown": cut("(select count(distinct occupation) from reg)", limit),
        "Specialty Distribution": "(select count(distinct specialty) from reg)",
        "Work Experience": "4",
        "Time Trends": days,
        "Summary Statistics": "10",
    }


def _listing_sql(rows: dict) -> str:
    body = " union all ".join(f"select '{t}' as \"table\", cast({n} as bigint) as n from tech, skill" for t, n in rows.items())
    return f"""with tech as (select count(distinct token) as n from {tokens_sql('sub', 'built_with', ',')}),
skill as (select count(distinct token) as n from {tokens_sql('reg', 'skills', ';')}) {body}"""


_DAYS = "(select count(distinct cast(created as date)) from sub)"
_WEEKS = "(select count(distinct date_trunc('week', created)) from sub)"
_COMBINED = _rows(50, _DAYS)
_SUBMISSION = {k: v for k, v in _rows(None, _DAYS).items() if k in ("Top Technologies", "Submissions by Hackathon", "Team Size Distribution", "Time Trends")} | {"Summary Statistics": "7"}
_REGISTRANT = {k: v for k, v in _rows(None, _DAYS).items() if k in ("Top Skills", "Country Distribution", "Occupation Breakdown", "Specialty Distribution", "Work Experience")} | {"Summary Statistics": "3"}
_PREVIEW = _rows(10, f"least({_WEEKS}, 10)") | {"Submissions by Hackathon": "least((select count(distinct title) from sub), 10)"}
_DASHBOARD = _rows(20, _WEEKS) | {"Submissions by Hackathon": "least((select count(distinct title) from sub), 20)"}

for _key, _build, _expected in (
    ("report_combined", reports.combined, _COMBINED),
    ("report_submission", reports.submission_report, _SUBMISSION),
    ("report_registrant", reports.registrant_report, _REGISTRANT),
    ("report_preview", reports.preview, _PREVIEW),
    ("dashboard_tables", reports.dashboard, _DASHBOARD),
):
    query(_key, _listing_sql(_expected), ("sub", "reg"))(
        lambda spark, sf_dir, key=_key, build=_build: listing(spark, build(tables(spark, sf_dir)), key)
    )


#: Columns of each table of the combined report that hold a row's name and its two figures.
_CELLS = {
    "Top Technologies": ("Technology", "Count", "Percentage"),
    "Top Skills": ("Skill", "Count", "Percentage"),
    "Submissions by Hackathon": ("Hackathon", "Submissions", "Organizations"),
    "Team Size Distribution": ("Team Size", "Count", "Percentage"),
    "Country Distribution": (S.COUNTRY, "Count", "Percentage"),
    "Occupation Breakdown": (S.OCCUPATION, "Count", "Percentage"),
    "Specialty Distribution": (S.SPECIALTY, "Count", "Percentage"),
    "Work Experience": ("Experience Range", "Count", "Percentage"),
    "Time Trends": ("Date", "Submissions", "Cumulative"),
}
_CELLS_SQL = {
    "Top Technologies": top_tokens_sql("sub", "built_with", ",", "v", 50),
    "Top Skills": top_tokens_sql("reg", "skills", ";", "v", 50),
    "Submissions by Hackathon": 'select title as v, count(project) as "Count", count(distinct org) as "Percentage" from sub where title is not null group by 1',
    "Team Size Distribution": TEAM_SQL.replace('"Team Size"', "v"),
    "Country Distribution": distribution_sql("reg", "country", "v", 50),
    "Occupation Breakdown": distribution_sql("reg", "occupation", "v", 50),
    "Specialty Distribution": distribution_sql("reg", "specialty", "v", None),
    "Work Experience": EXPERIENCE_SQL.replace('"Experience Range"', "v"),
    "Time Trends": """select strftime(d, '%Y-%m-%d') as v, n as "Count", sum(n) over (order by d) as "Percentage"
 from (select cast(created as date) as d, count(*) as n from sub where created is not null group by 1)""",
}


@query(
    "report_combined_cells",
    " union all ".join(
        f"""select '{name}' as "table", cast(v as varchar) as name, cast("Count" as bigint) as n, cast("Percentage" as double) as figure, null as text from ({sql})"""
        for name, sql in _CELLS_SQL.items()
    )
    + f""" union all select 'Summary Statistics', "Metric", null, null, "Value" from ({LISTING_SQL})""",
    ("sub", "reg"),
)
def report_combined_cells(spark, sf_dir):
    """The combined report written, read back and compared cell by cell."""
    manifest = write_bundle(spark, reports.combined(tables(spark, sf_dir)), f"{run_dir(spark, 'bundles')}/cells")
    every = None
    for row in manifest.collect():
        written = spark.read.parquet(row["path"])
        if row["table"] in _CELLS:
            name, n, figure = (F.col(f"`{c}`") for c in _CELLS[row["table"]])
            text = F.lit(None).cast("string")
        else:
            name, n, figure, text = F.col("Metric"), F.lit(None), F.lit(None), F.col("Value")
        part = written.select(
            F.lit(row["table"]).alias("table"), name.cast("string").alias("name"), n.cast("long").alias("n"),
            figure.cast("double").alias("figure"), text.alias("text"),
        )
        every = part if every is None else every.unionByName(part)
    return every


def event_tables(spark, sf_dir):
    subs = submissions(spark, sf_dir, S.TITLE, S.PROJECT, S.URL)
    return subs, registrants(spark, sf_dir, S.EVENT, S.USER), nation_events(spark, sf_dir)


@query(
    "event_filter_bundle",
    """select * from (select 'Source Data' as "table", (select count(*) from nat where name = 'nation_5') as n
 union all select 'Submissions', count(*) from sub where title = 'NATION_5'
 union all select 'Registrants', count(*) from reg where event = 'NATION_5' union all select 'Data Attribution', 7) where n > 0""",
    ("sub", "reg", "nat"),
)
def event_filter_bundle(spark, sf_dir):
    return listing(spark, reconcile.event_report("NATION_5", *event_tables(spark, sf_dir)), "event")


@query(
    "organizer_bundle",
    """select 'Organizer Summary' as "table", 1 as n union all select 'Hackathons', count(*) from nat where org = 'AFRICA'""",
    ("nat",),
)
def organizer_bundle(spark, sf_dir):
    return listing(spark, reconcile.organizer_report("Africa ", *event_tables(spark, sf_dir)), "organizer")


@query(
    "sample_bundles",
    f"""with {SHORT_SQL}, {LOOKUP_SQL} select 'All Samples' as "table", cast(sum(least(submission_count, 30)) as bigint) as n
 from asked join found using (identifier) union all select 'Summary', count(*) from asked union all select 'Statistics', 1
 union all select 'Random Sample', least(submission_count, 30) from found where identifier = 'https://nation-6.devpost.com/x'
 union all select 'Metadata', 1""",
    ("sub",),
)
def sample_bundles(spark, sf_dir):
    subs = submissions(spark, sf_dir, S.ORG, S.TITLE, S.PROJECT, S.URL, S.CREATED)
    entries = short_entries(spark, sf_dir)
    # all four look events up in it: counted once
    events = materialise(dimension(spark, sf_dir))
    drawn = samples.sample_events(entries, subs, 30, 7, dimension=events)
    batch = reports.batch_bundle(drawn, samples.batch_summary(entries, events, 30))
    one = spark.range(1).select(F.col("id").alias("idx"), F.lit("https://nation-6.devpost.com/x").alias("url"))
    figures = entities.lookup(one.select(F.col("url").alias("identifier")), events)
    single = reports.sample_bundle(samples.sample_events(one, subs, 30, 7, dimension=events), figures, 30, 7)
    return listing(spark, batch | single, "samples")


@query(
    "export_manifest",
    """select 'countries' as "Filename", cast(1 as bigint) as "Tables", count(distinct country) as "Rows", true as sized, true as dated from reg
 union all select 'teams', 1, (select count(distinct coalesce(extra, 0)) from sub), true, true""",
    ("sub", "reg"),
)
def export_manifest(spark, sf_dir):
    """Two bundles written, then listed from the log of the writes."""
    base = run_dir(spark, "exports")
    t = tables(spark, sf_dir)
    write_bundle(spark, {"Country Distribution": t.values(S.COUNTRY)}, f"{base}/countries")
    write_bundle(spark, {"Team Size Distribution": t.team_sizes()}, f"{base}/teams", "csv")
    done = export_history(spark, base)
    return done.select("Filename", "Tables", "Rows", (F.col("Size (KB)") > 0).alias("sized"), F.col("Created At").isNotNull().alias("dated"))
