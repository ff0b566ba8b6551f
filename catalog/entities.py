"""Slugs, catalogue, tiered lookup, samples."""

from __future__ import annotations

from adapters import event_list, nation_events, submissions, table
from eventmart import schemas as S
from eventmart.functions import numbers, urls
from eventmart.operators import entities, samples
from eventmart.sources import lists
from pyspark.sql import functions as F

from .registry import query, strip_sql

SLUG = r"nullif(regexp_extract(url, 'https://([^.]+)\.devpost\.com', 1), '')"
BUCKET = """case when {n} >= 300 then 'Bucket E (Mega)' when {n} >= 100 then 'Bucket D (Large)'
 when {n} >= 25 then 'Bucket C (Mid-Size)' when {n} >= 10 then 'Bucket B (Small)' else 'Bucket A (Micro)' end"""


def typed_slug(expression: str, host: str = r"devpost\.com") -> str:
    text = strip_sql(expression)
    return f"lower(coalesce(nullif(regexp_extract({text}, '^(?:https?://)?([A-Za-z0-9-]+)\\.{host}', 1), ''), {text}))"


@query("slug_from_input", f"select page_id, {typed_slug('url', 'example[.]com')} as slug from pages")
def slug_from_input(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", urls.slug_from_input(F.col("url"), "example.com").alias("slug"))


@query("slug_from_url", f"select url, {SLUG} as slug, concat('https://', {SLUG}, '.devpost.com') as event_url from sub", ("sub",))
def slug_from_url(spark, sf_dir):
    rows = submissions(spark, sf_dir, S.URL).withColumnRenamed(S.URL, "url")
    slug = urls.slug_from_url(F.col("url"))
    return rows.select("url", slug.alias("slug"), urls.event_url(slug).alias("event_url"))


def dimension(spark, sf_dir):
    return entities.event_dimension(submissions(spark, sf_dir, S.URL, S.TITLE, S.ORG, S.PROJECT, S.CREATED))


_CATALOGUE = f"""with s as (select *, {SLUG} as slug from sub),
cat as (select slug, arg_min(title, url) as challenge_title, arg_min(org, url) as organization,
 count(project) as submission_count, concat('https://', slug, '.devpost.com') as url from s where slug is not null group by slug)"""


@query("event_catalogue", _CATALOGUE + " select * from cat", ("sub",))
def event_catalogue(spark, sf_dir):
    return entities.catalogue(dimension(spark, sf_dir))


@query(
    "catalogue_search",
    _CATALOGUE
    + """, scored as (select *, case when lower(slug) = 'nation-1' then 100 when starts_with(lower(slug), 'nation-1') then 80
 when contains(lower(slug), 'nation-1') then 60 when contains(lower(challenge_title), 'nation-1') then 40 end as score from cat)
 select * from scored where score is not null order by score desc, submission_count desc, slug limit 5""",
    ("sub",),
)
def catalogue_search(spark, sf_dir):
    return entities.search(entities.catalogue(dimension(spark, sf_dir)), "Nation-1", 5)


@query(
    "size_buckets",
    f"""select p_name as name, count(*) as n, {BUCKET.format(n='count(*)')} as bucket from lineitem
 join part on l_partkey = p_partkey group by 1""",
)
def size_buckets(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    sizes = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("p_name").alias("name"))
    return sizes.agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", numbers.size_bucket(F.col("n")))


# ---- list of identifiers, one per customer -----------------------------------------

_KEY = "c_custkey % 25"
ENTRIES_SQL = f"""entries as (select row_number() over (order by c_custkey, url) - 1 as idx, url from (
 select c_custkey, case when c_custkey % 11 = 0 then null when c_custkey % 6 = 0 then concat(' https://nation-', {_KEY}, '.devpost.com/x ')
  when c_custkey % 6 = 1 then concat('Nation-', {_KEY}, '.devpost.com') when c_custkey % 6 = 2 then concat('nation_', {_KEY})
  when c_custkey % 6 = 3 then concat('tion_', {_KEY}) when c_custkey % 6 = 4 then '   '
  else concat('missing-', c_custkey) end as url from customer) where url is not null)"""


def entries(spark, sf_dir):
    key = F.col("c_custkey")
    nation = (key % 25).cast("string")
    url = (
        F.when(key % 11 == 0, F.lit(None))
        .when(key % 6 == 0, F.concat(F.lit(" https://nation-"), nation, F.lit(".devpost.com/x ")))
        .when(key % 6 == 1, F.concat(F.lit("Nation-"), nation, F.lit(".devpost.com")))
        .when(key % 6 == 2, F.concat(F.lit("nation_"), nation))
        .when(key % 6 == 3, F.concat(F.lit("tion_"), nation))
        .when(key % 6 == 4, F.lit("   "))
        .otherwise(F.concat(F.lit("missing-"), key))
    )
    return lists.indexed(table(spark, sf_dir, "customer").withColumn("url", url), "url", ["c_custkey"])


LOOKUP_SQL = f"""asked as (select idx, {strip_sql('url')} as identifier from entries where {strip_sql('url')} <> ''),
s as (select *, {SLUG} as slug from sub),
names as (select distinct slug, title from s),
hits as (select distinct identifier, slug, title, case when lower(slug) = needle then 1
   when lower(title) = lower(identifier) then 2 when contains(lower(title), needle) then 3 end as tier
 from (select distinct identifier, {typed_slug('identifier')} as needle from asked), names),
best as (select * from hits where tier is not null qualify tier = min(tier) over (partition by identifier)),
mrows as (select b.identifier, b.tier, s.* from best b join s on s.slug is not distinct from b.slug and s.title is not distinct from b.title),
years as (select identifier, year(created) as y, count(*) as n from mrows group by 1, 2),
modal as (select identifier, y from years qualify row_number() over (partition by identifier order by n desc, y) = 1),
found as (select identifier, arg_min(slug, url) as slug, arg_min(title, url) as challenge_title,
  arg_min(org, url) as organization, count(*) as submission_count,
  concat('https://', arg_min(slug, url), '.devpost.com') as url, {BUCKET.format(n='count(*)')} as submission_bucket,
  any_value(modal.y) as hackathon_year from mrows join modal using (identifier) group by identifier)"""


@query("entity_lookup_batch", f"with {ENTRIES_SQL}, {LOOKUP_SQL} select * from found", ("sub",))
def entity_lookup_batch(spark, sf_dir):
    asked = entries(spark, sf_dir).selectExpr("url as identifier")
    return entities.lookup(asked, dimension(spark, sf_dir))


@query(
    "batch_preview",
    f"""with {ENTRIES_SQL}, {LOOKUP_SQL}, head as (select * from entries order by idx limit 40)
 select head.idx, a.identifier as url, {typed_slug('a.identifier')} as slug, f.identifier is not null as found,
 f.challenge_title as hackathon_name, coalesce(f.submission_count, 0) as submission_count,
 (select count(*) from entries) as list_total
 from head join asked a on a.idx = head.idx left join found f on f.identifier = a.identifier""",
    ("sub",),
)
def batch_preview(spark, sf_dir):
    return entities.preview(entries(spark, sf_dir), dimension(spark, sf_dir), 40)


_BATCH = f"""summary as (select a.idx, a.identifier as "Hackathon URL", {typed_slug('a.identifier')} as "Hackathon Slug",
 coalesce(f.challenge_title, '') as "Hackathon Name", coalesce(f.organization, '') as "Organization",
 coalesce(f.submission_count, 0) as "Total Submissions", least(coalesce(f.submission_count, 0), 30) as "Exported Count",
 coalesce(f.submission_bucket, '') as "Submission Bucket", f.hackathon_year as "Hackathon Year",
 case when f.identifier is not null then 'success' else 'not_found' end as "Status",
 case when f.identifier is not null then '' else concat('No submissions found for hackathon: ', a.identifier) end as "Error"
 from asked a left join found f using (identifier))"""


def curated_summary(spark, sf_dir):
    return samples.batch_summary(entries(spark, sf_dir), dimension(spark, sf_dir), 30, curated=True)


@query("batch_summary", f"with {ENTRIES_SQL}, {LOOKUP_SQL}, {_BATCH} select * from summary", ("sub",))
def batch_summary(spark, sf_dir):
    return curated_summary(spark, sf_dir)


@query(
    "batch_statistics",
    f"""with {ENTRIES_SQL}, {LOOKUP_SQL}, {_BATCH} select count(*) as "Total Hackathons Processed",
 count(*) filter ("Status" = 'success') as "Hackathons Found", count(*) filter ("Status" = 'not_found') as "Hackathons Not Found",
 cast(sum("Exported Count") as bigint) as "Total Samples Collected" from summary""",
    ("sub",),
)
def batch_statistics(spark, sf_dir):
    return samples.batch_statistics(curated_summary(spark, sf_dir))


# ---- samples: a list with one entry per nation ----------------------------------------

SHORT_SQL = ENTRIES_SQL.replace("customer", "(select n_nationkey as c_custkey from nation)")


def short_entries(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_custkey")
    key = F.col("c_custkey")
    text = (key % 25).cast("string")
    url = (
        F.when(key % 11 == 0, F.lit(None))
        .when(key % 6 == 0, F.concat(F.lit(" https://nation-"), text, F.lit(".devpost.com/x ")))
        .when(key % 6 == 1, F.concat(F.lit("Nation-"), text, F.lit(".devpost.com")))
        .when(key % 6 == 2, F.concat(F.lit("nation_"), text))
        .when(key % 6 == 3, F.concat(F.lit("tion_"), text))
        .when(key % 6 == 4, F.lit("   "))
        .otherwise(F.concat(F.lit("missing-"), key))
    )
    return lists.indexed(nation.withColumn("url", url), "url", ["c_custkey"])


METADATA_SQL = """meta as (select url, case when participants % 2 = 0 then 'Company' else 'School' end as kind,
 case when subs % 2 = 0 then 'Public' else 'Private' end as category from nat where url is not null)"""


def metadata(spark, sf_dir):
    events = nation_events(spark, sf_dir)
    return events.select(
        F.col(f"`{S.SRC_URL}`"),
        F.when(F.col(f"`{S.SRC_PARTICIPANTS}`") % 2 == 0, "Company").otherwise("School").alias("Organization Type"),
        F.when(F.col(f"`{S.SRC_SUBMISSIONS}`") % 2 == 0, "Public").otherwise("Private").alias("Organization Category"),
    )


def _sample_sql(n: int | None, seed: int = 7) -> str:
    cut = f"qualify row_number() over (partition by idx order by md5(concat({seed} + idx, ':', url))) <= {n}" if n else ""
    return f"""with {SHORT_SQL}, {LOOKUP_SQL}, {METADATA_SQL},
drawn as (select a.idx, a.identifier, m.* exclude (identifier, tier, slug) from asked a join mrows m using (identifier) {cut})
select d.idx, org as "Organization Name", title as "Challenge Title", project as "Project Title", d.url as "Submission Url",
 created as "Project Created At", year(created) as "Year", f.submission_bucket as "Submission Bucket",
 f.hackathon_year as "Hackathon Year", d.identifier as "Hackathon URL", {typed_slug('d.identifier')} as "Hackathon Slug",
 meta.kind as "Organization Type", meta.category as "Organization Category"
from drawn d join found f using (identifier) left join meta on meta.url = f.url"""


def drawn(spark, sf_dir, n, export_all=False):
    subs = submissions(spark, sf_dir, S.ORG, S.TITLE, S.PROJECT, S.URL, S.CREATED)
    return samples.sample_events(
        short_entries(spark, sf_dir), subs, n, 7, export_all, metadata(spark, sf_dir)
    )


@query("sample_batch", _sample_sql(30), ("sub", "nat"))
def sample_batch(spark, sf_dir):
    return drawn(spark, sf_dir, 30)


@query("sample_batch_large", _sample_sql(1500), ("sub", "nat"))
def sample_batch_large(spark, sf_dir):
    return drawn(spark, sf_dir, 1500)


@query("sample_export_all", _sample_sql(None), ("sub", "nat"))
def sample_export_all(spark, sf_dir):
    return drawn(spark, sf_dir, 30, export_all=True)


_ONE_SQL = """with s as (select * from sub where title = 'NATION_3')
select org as "Organization Name", title as "Challenge Title", url as "Submission Url", created as "Project Created At",
 year(created) as "Year", 0 as idx, 'https://nation-3.devpost.com' as "Hackathon URL", 'nation-3' as "Hackathon Slug",
 (select case when count(*) >= 300 then 'Bucket E (Mega)' when count(*) >= 100 then 'Bucket D (Large)'
   when count(*) >= 25 then 'Bucket C (Mid-Size)' when count(*) >= 10 then 'Bucket B (Small)' else 'Bucket A (Micro)' end from s) as "Submission Bucket",
 (select year(created) from s group by 1 order by count(*) desc, 1 limit 1) as "Hackathon Year"
from s qualify row_number() over (order by md5(concat('11:', url))) <= 30"""


@query("sample_one", _ONE_SQL, ("sub",))
def sample_one(spark, sf_dir):
    subs = submissions(spark, sf_dir, S.ORG, S.TITLE, S.URL, S.CREATED).withColumn(S.PROJECT, F.col(f"`{S.URL}`"))
    one = spark.range(1).select(F.col("id").alias("idx"), F.lit("https://nation-3.devpost.com").alias("url"))
    return samples.sample_events(one, subs, 30, 11).drop(S.PROJECT)


# ---- lists --------------------------------------------------------------------------


def flagged_list(spark, sf_dir):
    events = event_list(spark, sf_dir, S.SRC_NAME, S.SRC_URL, S.SRC_MODE, S.SRC_DATE)
    flag = F.when(F.col(f"`{S.SRC_MODE}`") == "Virtual", "YES").otherwise("NO")
    return events.withColumn("Include_in_Sample", flag)


@query(
    "load_url_list",
    """select row_number() over (order by published, name, url) - 1 as idx, url from src where mode = 'Virtual'""",
    ("src",),
)
def load_url_list(spark, sf_dir):
    rows, column = lists.prepare_list(flagged_list(spark, sf_dir), "Include_in_Sample", "YES")
    return lists.indexed(rows, column, [S.SRC_DATE, S.SRC_NAME])


@query("find_url_column", "select count(*) as n, count(url) as urls, 'Address' as column_name from src", ("src",))
def find_url_column(spark, sf_dir):
    rows = event_list(spark, sf_dir, S.SRC_NAME, S.SRC_URL).withColumnRenamed(S.SRC_URL, "Address")
    rows, column = lists.prepare_list(rows)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(column)).alias("urls")).withColumn("column_name", F.lit(column))


@query(
    "curated_list",
    """select url as "Hackathon url", year(published) as "Year", mode as "In person vs virtual",
 (select count(url) from src) as size from src""",
    ("src",),
)
def curated_list(spark, sf_dir):
    rows = event_list(spark, sf_dir, S.SRC_NAME, S.SRC_URL, S.SRC_MODE, S.SRC_DATE)
    rows = rows.withColumn("Year", F.year(F.col(f"`{S.SRC_DATE}`")))
    return lists.curated_metadata(rows).withColumn("size", lists.curated_size(rows).scalar())
