"""Registration of queries and the SQL fragments they share."""

from __future__ import annotations

from adapters import with_views
from eventmart.functions.text import _SPACES, SPACE_CLASS

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Aliases used by the token queries; they hit words of the driver's tables.
SYNONYMS = {"widget": "gadget", "economy": "budget", "small": "compact", "red": "crimson"}

PUNCT = r"[^\p{L}\p{N}_" + SPACE_CLASS + "]+"
SPACE = f"[{SPACE_CLASS}]+"
SYN_SQL = "(values " + ", ".join(f"('{a}', '{c}')" for a, c in SYNONYMS.items()) + ") as syn(alias, canonical)"


def query(key: str, sql: str | None = None, views: tuple = ()):
    """Register a function (spark, sf_dir) -> DataFrame and its oracle."""

    def register(function):
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = with_views(sql, *views) if views else sql.strip()
        return function

    return register


def strip_sql(expression: str) -> str:
    return f"trim({expression}, '{_SPACES}')"


def tokens_sql(table: str, column: str, separator: str, extra: str = "", synonyms: bool = True) -> str:
    """Normalised tokens of a delimited column as (extra..., token)."""
    lead = f"{extra}, " if extra else ""
    names = ", ".join(part.split(" as ")[-1].strip() for part in extra.split(",")) if extra else ""
    keep = f"{names}, " if names else ""
    join = f"left join {SYN_SQL} on syn.alias = t" if synonyms else ""
    token = "coalesce(syn.canonical, t)" if synonyms else "t"
    return f"""(select {keep}{token} as token from (
  select {keep}regexp_replace(lower({strip_sql('t')}), '^{PUNCT}|{PUNCT}$', '', 'g') as t
  from (select {lead}unnest(string_split({column}, '{separator}')) as t from {table})) {join} where t <> '')"""


def percent_sql(part: str, total: str) -> str:
    return f"coalesce(round_even({part}::double / nullif({total}, 0) * 100, 2), 0)"


def nearest_percent_sql(part: str, total: str) -> str:
    return f"coalesce(cast(format('{{:.2f}}', {part}::double / nullif({total}, 0) * 100) as double), 0)"


def top_tokens_sql(table: str, column: str, separator: str, name: str, limit: int | None, synonyms: bool = True) -> str:
    cut = f"limit {limit}" if limit else ""
    return f"""with counts as (select token, count(*) as n from {tokens_sql(table, column, separator, '', synonyms)} group by 1)
select row_number() over (order by n desc, token) as "Rank", token as "{name}", n as "Count",
       {nearest_percent_sql('n', '(select sum(n) from counts)')} as "Percentage"
from counts order by n desc, token {cut}"""


def distribution_sql(table: str, column: str, name: str, limit: int | None) -> str:
    cut = f"limit {limit}" if limit else ""
    return f"""with counts as (select {column} as v, count(*) as n from {table} where {column} is not null group by 1)
select v as "{name}", n as "Count", {percent_sql('n', '(select sum(n) from counts)')} as "Percentage"
from counts order by n desc, v {cut}"""
