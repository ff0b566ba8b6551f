"""Event list, organizers, matching and reconciliation."""

from __future__ import annotations

from adapters import event_list, nation_events, registrants, submissions
from eventmart import schemas as S
from eventmart.operators import filters, organizers, reconcile
from eventmart.operators.clean import quoted
from eventmart.session import run_dir
from eventmart.sources.event_list import normalise_events, read_events
from pyspark.sql import functions as F

from .registry import query


def source(spark, sf_dir, *columns):
    return normalise_events(event_list(spark, sf_dir, *columns))


@query(
    "source_normalised",
    """select name, org, url, published, participants, subs, mode, year(published) as year, month(published) as month,
 quarter(published) as quarter from srcn""",
    ("srcn",),
)
def source_normalised(spark, sf_dir):
    names = ["name", "org", "url", "published", "participants", "subs", "mode", "year", "month", "quarter"]
    return source(spark, sf_dir).toDF(*names)


@query(
    "event_list_csv",
    """select name, org, url, published, participants, subs, mode, year(published) as year, month(published) as month,
 quarter(published) as quarter from srcn""",
    ("srcn",),
)
def event_list_csv(spark, sf_dir):
    """The list written as CSV with blanks around its headers, and read back."""
    folder = run_dir(spark, "events")
    rows = event_list(spark, sf_dir)
    rows.toDF(*[f" {c} " for c in rows.columns]).write.option("header", True).option("escape", '"').csv(folder)
    found = read_events(spark, folder, "csv")
    wanted = source(spark, sf_dir).columns
    return found.select(*[quoted(c) for c in wanted]).toDF("name", "org", "url", "published", "participants", "subs", "mode", "year", "month", "quarter")


@query(
    "source_listing",
    """select strftime(published, '%Y-%m-%d') as "Date", name as "Hackathon", org as "Organizer", participants as "Participants",
 subs as "Submissions", mode as "Event Type" from srcn""",
    ("srcn",),
)
def source_listing(spark, sf_dir):
    from eventmart.sources.event_list import display_events

    return display_events(source(spark, sf_dir))


@query("event_names", "select distinct trim(name) as name from src", ("src",))
def event_names(spark, sf_dir):
    return organizers.event_names(source(spark, sf_dir, S.SRC_NAME))


_MAPPING = """with sp as (select lower(trim(org)) as norm, org as spelling, count(*) as n from srcn where org is not null group by 1, 2),
mapping as (select norm, (select spelling from sp s where s.norm = sp.norm order by n desc, spelling limit 1) as canonical,
 string_agg(spelling, ', ' order by spelling) as variations, count(*) as variation_count, cast(sum(n) as bigint) as n
 from sp group by norm)"""


@query("organizer_mapping", _MAPPING + " select norm, canonical, variations, n as count from mapping", ("srcn",))
def organizer_mapping(spark, sf_dir):
    mapping = organizers.organizer_mapping(source(spark, sf_dir, S.SRC_NAME, S.SRC_ORG))
    return mapping.withColumn("variations", F.array_join("variations", ", "))


@query(
    "organizer_ranking",
    _MAPPING + " select canonical as canonical_name, variations, variation_count, n as hackathon_count from mapping",
    ("srcn",),
)
def organizer_ranking(spark, sf_dir):
    mapping = organizers.organizer_mapping(source(spark, sf_dir, S.SRC_NAME, S.SRC_ORG))
    return organizers.organizer_ranking(mapping).withColumn("variations", F.array_join("variations", ", "))


@query(
    "canonical_organizers",
    _MAPPING + """, asked as (select distinct case when length(org) > 9 then concat('New ', org) else upper(org) end as name from src)
 select asked.name, coalesce(m.canonical, asked.name) as canonical, coalesce(m.variations, asked.name) as variations
 from asked left join mapping m on m.norm = lower(trim(asked.name))""",
    ("srcn",),
)
def canonical_organizers(spark, sf_dir):
    mapping = organizers.organizer_mapping(source(spark, sf_dir, S.SRC_NAME, S.SRC_ORG))
    org = F.col(f"`{S.SRC_ORG}`")
    name = F.when(F.length(org) > 9, F.concat(F.lit("New "), org)).otherwise(F.upper(org))
    asked = event_list(spark, sf_dir, S.SRC_ORG).select(name.alias("name")).distinct()
    return organizers.canonical_names(asked, "name", mapping).withColumn("variations", F.array_join("variations", ", "))


@query(
    "organizer_timeline",
    """select published as "Date", name as "Hackathon", participants as "Participants", subs as "Submissions",
 mode as "Event Type" from srcn where lower(org) = 'building'""",
    ("srcn",),
)
def organizer_timeline(spark, sf_dir):
    return organizers.organizer_timeline(source(spark, sf_dir), "Building ")


@query(
    "organizer_timeline_totals",
    """select count(*) as "Hackathons", cast(coalesce(sum(participants), 0) as bigint) as "Total Participants",
 cast(coalesce(sum(subs), 0) as bigint) as "Total Submissions" from srcn where lower(org) = 'building'""",
    ("srcn",),
)
def organizer_timeline_totals(spark, sf_dir):
    return organizers.timeline_totals(source(spark, sf_dir), "Building ")


@query(
    "events_by_names",
    """select name, org from srcn where org in (select org from srcn group by 1 order by count(*) desc, 1 limit 3)""",
    ("srcn",),
)
def events_by_names(spark, sf_dir):
    events = source(spark, sf_dir, S.SRC_NAME, S.SRC_ORG)
    names = events.groupBy(f"`{S.SRC_ORG}`").count().orderBy(F.desc("count"), F.col(f"`{S.SRC_ORG}`")).limit(3)
    return filters.name_in(events, names, S.SRC_ORG, S.SRC_ORG).toDF("name", "org")


for _key, _name in (("exact", "Brand#1"), ("ci", "BRAND#1")):
    query(
        f"event_filter_{_key}",
        f"""select org, url from sub where case when exists (select 1 from sub where org = '{_name}')
 then org = '{_name}' else lower(org) = lower('{_name}') end""",
        ("sub",),
    )(
        lambda spark, sf_dir, name=_name: filters.exact_else_folded(
            submissions(spark, sf_dir, S.ORG, S.URL), S.ORG, name
        ).toDF("org", "url")
    )


# ---- reconciliation -----------------------------------------------------------------


def records(spark, sf_dir):
    return submissions(spark, sf_dir, S.TITLE), registrants(spark, sf_dir, S.EVENT)


_COUNTS = """sc as (select title as event, count(*) as n from sub group by 1),
rc as (select event, count(*) as n from reg group by 1),
fsc as (select lower(event) as event, sum(n) as n from sc group by 1), frc as (select lower(event) as event, sum(n) as n from rc group by 1)"""


def _checked(names: str) -> str:
    return f"""counted as (select names.*, cast(coalesce(sc.n, fsc.n, 0) as bigint) as submission_count,
  cast(coalesce(rc.n, frc.n, 0) as bigint) as registrant_count, coalesce(e.name, f.name) is not null as valid,
  case when e.name is not null then e.subs else f.subs end as listed_submissions,
  case when e.name is not null then e.participants else f.participants end as listed_participants
 from ({names}) names left join sc on sc.event = names.event left join fsc on fsc.event = lower(names.event)
 left join rc on rc.event = names.event left join frc on frc.event = lower(names.event)
 left join nat e on e.name = names.event left join nat f on lower(f.name) = lower(names.event)),
checked as (select *, case when not valid then concat('Hackathon ''', event, ''' not found in source data') end as error,
 concat_ws(chr(10), case when submission_count > listed_submissions then concat('Submission count (', submission_count,
   ') exceeds source data (', listed_submissions, '). This may be due to spam filtering.')
  when submission_count < listed_submissions * 0.8 then concat('Submission count (', submission_count,
   ') is significantly lower than source data (', listed_submissions, '). Data may be incomplete.') end,
  case when registrant_count > listed_participants then concat('Registrant count (', registrant_count,
   ') exceeds source participant count (', listed_participants, '). This is unusual.') end) as warnings from counted)"""


@query(
    "reconcile_all",
    f"with {_COUNTS}, {_checked('select event from sc union select event from rc union select name from nat')} select * from checked",
    ("sub", "reg", "nat"),
)
def reconcile_all(spark, sf_dir):
    result = reconcile.reconcile_all(*records(spark, sf_dir), nation_events(spark, sf_dir))
    return result.withColumn("warnings", F.array_join("warnings", "\n"))


_PER_EVENT = _checked("select org as organizer, name as event from nat")


@query(
    "organizer_events",
    f"with {_COUNTS}, {_PER_EVENT} select *, case when valid then 'ok' else 'warning' end as status from checked",
    ("sub", "reg", "nat"),
)
def organizer_events(spark, sf_dir):
    result = reconcile.organizer_events(*records(spark, sf_dir), nation_events(spark, sf_dir))
    return result.withColumn("warnings", F.array_join("warnings", "\n"))


@query(
    "organizer_rollup",
    f"""with {_COUNTS}, {_PER_EVENT} select lower(organizer) as norm, organizer as canonical, organizer as variations,
 count(*) as hackathon_count, cast(sum(submission_count) as bigint) as total_submissions,
 cast(sum(registrant_count) as bigint) as total_registrants from checked group by organizer""",
    ("sub", "reg", "nat"),
)
def organizer_rollup(spark, sf_dir):
    result = reconcile.organizer_rollup(*records(spark, sf_dir), nation_events(spark, sf_dir))
    return result.withColumn("variations", F.array_join("variations", ", "))


_ORG_TABLE = """select case when valid then 'ok' else 'warning' end as "Status", event as "Hackathon Name",
 submission_count as "Submissions", registrant_count as "Registrants",
 coalesce(cast(listed_submissions as varchar), 'N/A') as "Source Submissions",
 coalesce(cast(listed_participants as varchar), 'N/A') as "Source Participants", warnings as "Warnings"
 from checked where lower(organizer) = 'asia'"""


@query("organizer_report", f"with {_COUNTS}, {_PER_EVENT} {_ORG_TABLE}", ("sub", "reg", "nat"))
def organizer_report(spark, sf_dir):
    return reconcile.organizer_report("Asia", *records(spark, sf_dir), nation_events(spark, sf_dir))["Hackathons"]


@query(
    "organizer_summary",
    f"""with {_COUNTS}, {_PER_EVENT} select 'ASIA' as "Canonical Name", 'ASIA' as "Name Variations", count(*) as "Hackathon Count",
 cast(sum(submission_count) as bigint) as "Total Submissions", cast(sum(registrant_count) as bigint) as "Total Registrants"
 from checked where lower(organizer) = 'asia'""",
    ("sub", "reg", "nat"),
)
def organizer_summary(spark, sf_dir):
    return reconcile.organizer_report("Asia", *records(spark, sf_dir), nation_events(spark, sf_dir))["Organizer Summary"]


@query(
    "event_attribution",
    """with e as (select * from nat where lower(name) = 'nation_5')
select 'Organization Name' as field, org as value, 'Source of Truth' as source from e
union all select 'Hackathon URL', url, 'Source of Truth' from e
union all select 'Published Date', strftime(published, '%Y-%m-%d %H:%M:%S'), 'Source of Truth' from e
union all select 'Total Participants (Source)', cast(participants as varchar), 'Source of Truth' from e
union all select 'Valid Submissions (Source)', cast(subs as varchar), 'Source of Truth' from e
union all select 'Processed Submissions', cast(count(*) as varchar), 'Processed Data Files' from sub where title = 'NATION_5'
union all select 'Processed Registrants', cast(count(*) as varchar), 'Processed Data Files' from reg where event = 'NATION_5'""",
    ("sub", "reg", "nat"),
)
def event_attribution(spark, sf_dir):
    return reconcile.attribution("NATION_5", *records(spark, sf_dir), nation_events(spark, sf_dir))
