"""Personal data: patterns that always count, and bootstrapped contexts that find what they miss.

The base finds four kinds by regular expressions. Its findings are seeds: the words around them are
patterns, patterns and instances form a graph, and both are scored in turns. A pattern is as
sure of a kind as the share of its distinct instances that have it; a token that only looks
like an identifier takes the score of its surest pattern, if enough instances support that. Found
tokens count as instances in the next turn. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, quoted, saved

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, possessive where nothing can be given back and started only where a run of
#: characters begins, so that long runs take linear time; matches are those of the plain forms.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: with a digit or an at sign.
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TURNS, SUPPORT, SURE = 3, 5, 0.8


def _digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda s, k: s + _doubled(F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)),
    )
    return total % 10 == 0


def _doubled(x: Column) -> Column:
    return F.when(x > 9, x - 9).otherwise(x)


def _valid(kind: Column, surface: Column) -> Column:
    digits = _digits(surface)
    size = F.length(digits)
    return (
        F.when(kind == "ip", surface.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", F.when(size.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", size.between(9, 15))
        .otherwise(True)
    )


def _plausible(kind: Column, surface: Column) -> Column:
    """Whether a token has the look of a kind, loosely."""
    size = F.length(_digits(surface))
    return (
        F.when(kind == "email", F.lower(surface).rlike(r"[a-z0-9].*(@|\(at\)|\[at\]).*[a-z0-9]"))
        .when(kind == "ip", size.between(4, 12) & surface.rlike(r"^[\[(]?[0-9]+([.:,][0-9]+){3}\D*$"))
        .when(kind == "card", size.between(12, 19) & ~surface.rlike("[A-Za-z]"))
        .when(kind == "phone", size.between(7, 15) & ~surface.rlike("[A-Za-z]"))
    )


def _key(docs: DataFrame) -> Column:
    """Rows with the same id and text are one."""
    return F.md5(F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"], F.lit(""))).cast("binary"))


def _matches(docs: DataFrame) -> DataFrame:
    """One row per match of a base pattern or a token: key, kind, start, end, surface, left, right."""
    text = F.col("text")
    named = {**PATTERNS, "token": _TOKEN}
    where = {"email": text.contains("@"), "phone": text.contains("+")}
    columns = []
    for kind, pattern in named.items():
        present = where.get(kind, F.lit(True))
        none = F.array().cast("array<string>")
        columns.append(F.when(present, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m_{kind}"))
        columns.append(F.when(present, F.split(text, pattern, -1)).otherwise(none).alias(f"p_{kind}"))
    cut = docs.filter(text.rlike("[0-9@]")).select("key", *columns)
    space = "\t\n\x0b\x0c\r"
    words = lambda piece: F.translate(piece, space, " " * len(space))

    def described(kind: str):
        return lambda x, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("at"), x["m"].alias("surface"), F.length(x["before"]).alias("gap"),
            F.substring_index(F.trim(words(x["before"])), " ", -2).alias("left"),
            F.substring_index(F.trim(words(x["after"])), " ", 1).alias("right"),
        )

    parts = [
        F.transform(
            F.arrays_zip(F.col(f"m_{kind}").alias("m"), F.slice(f"p_{kind}", F.lit(1), F.size(f"m_{kind}")).alias("before"), F.slice(f"p_{kind}", 2, F.size(f"m_{kind}")).alias("after")),
            described(kind),
        )
        for kind in named
    ]
    each = cut.select("key", F.explode(F.concat(*parts)).alias("x")).select("key", "x.*")
    upto = Window.partitionBy("key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("surface")).over(upto))
    return each.select("key", "kind", (F.col("end") - F.length("surface")).cast("long").alias("start"), F.col("end").cast("long").alias("end"), "surface", "left", "right")


def _normal(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), "[0-9]", "0")


def _patterns(found: DataFrame) -> DataFrame:
    """Each match with its contexts, exploded: instance and pattern, distinct."""
    last = F.substring_index("left", " ", -1)
    each = F.array(
        F.concat(F.lit("2 "), _normal(F.col("left"))),
        F.concat(F.lit("1 "), _normal(last)),
        F.concat(F.lit("r "), _normal(F.col("right"))),
        F.concat(F.lit("b "), _normal(last), F.lit(" _ "), _normal(F.col("right"))),
    )
    return found.select("instance", F.explode(each).alias("pattern")).distinct()


def discover(base: DataFrame, tokens: DataFrame) -> DataFrame:
    """(instance, kind) of tokens that patterns learned from ``base`` identify."""
    instance = F.lower(F.col("surface")).alias("instance")
    seeds = base.select(instance, "kind").distinct().withColumn("score", F.lit(1.0))
    graph = saved(_patterns(base.select(instance, "left", "right").unionByName(tokens.select(instance, "left", "right"))), "pii-graph")
    sizes = saved(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT), "pii-sizes")
    scores = saved(seeds, "pii-scores")
    seeded = scores.select("instance").distinct()
    looks = saved(tokens.select(instance).distinct().join(seeded, "instance", "left_anti"), "pii-tokens")
    found = None
    for _ in range(TURNS):
        known = scores if found is None else scores.unionByName(found)
        patterns = (
            graph.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
            .join(sizes, "pattern").withColumn("sure", F.col("s") / F.col("n"))
            .filter((F.col("s") >= SUPPORT) & (F.col("sure") >= SURE)).select("pattern", "kind", "sure")
        )
        found = saved(
            graph.join(looks, "instance", "left_semi").join(patterns, "pattern").filter(_plausible(F.col("kind"), F.col("instance")))
            .groupBy("instance").agg(F.max_by("kind", F.struct("sure", "kind")).alias("kind"), F.max("sure").alias("score")),
            "pii-found",
        )
    return found.select("instance", "kind")


def spans(docs: DataFrame) -> DataFrame:
    """Spans of ``docs`` (key, text): key, kind, start, end, base (whether a base pattern found it)."""
    every = saved(_matches(docs.dropDuplicates(["key"])), "pii-matches")
    base = saved(every.filter((F.col("kind") != "token") & _valid(F.col("kind"), F.col("surface"))), "pii-base")
    # tokens that do not touch a base span of their text
    # nearest base spans on both sides; each frame runs from the first row, so that it grows by a row at a time
    token = F.col("surface").isNotNull()
    forth = Window.partitionBy("key").orderBy("start", "end", token).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("end"), token).rowsBetween(Window.unboundedPreceding, 0)
    marks = base.select("key", "start", "end", F.col("end").alias("base_end"), F.col("start").alias("base_start"), F.lit(None).cast("string").alias("surface"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))
    tokens = every.filter("kind = 'token'").select("key", "start", "end", F.lit(None).cast("long").alias("base_end"), F.lit(None).cast("long").alias("base_start"), "surface", "left", "right")
    beside = (
        marks.unionByName(tokens)
        .withColumn("before", F.max("base_end").over(forth))
        .withColumn("after", F.min("base_start").over(back))
    )
    free = saved(
        beside.filter("surface is not null and coalesce(before, 0) <= start and coalesce(after, end) >= end")
        .withColumn("surface", F.regexp_extract("surface", r"^(.*?)[.,;:!?]*$", 1)).filter("surface <> ''")
        .select("key", "start", (F.col("start") + F.length("surface")).alias("end"), "surface", "left", "right"),
        "pii-free",
    )
    more = free.withColumn("instance", F.lower("surface")).join(discover(base, free), "instance")
    return (
        base.select("key", "kind", "start", "end", F.lit(True).alias("base"))
        .unionByName(more.select("key", "kind", "start", "end", F.lit(False).alias("base")))
    )


def _listed(kept: Column) -> Column:
    """kind:start:end of the collected spans that are ``kept``, by kind and start, joined with commas."""
    number = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])[F.col("kind")]
    one = F.when(kept, F.struct(number.alias("number"), F.col("start"), F.col("end"), F.col("kind")))
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def find(docs: DataFrame) -> DataFrame:
    """doc_id, numbers and hash of the base spans, and all spans, for every row of ``docs``.

    NULL text is empty and has no spans. Rows that repeat an id with another text are told apart;
    positions are code points, ends exclusive.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keyed = slim.withColumn("key", _key(slim))
    per_key = spans(keyed).groupBy("key").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        _listed(F.col("base")).alias("base_spans"),
        _listed(F.lit(True)).alias("spans"),
    )
    out = keyed.select("doc_id", "key").join(per_key, "key", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars`` follows if there is one.

    Spans that overlap become one, named after the kind that starts first. Other columns stay, whatever their names.
    """
    own, found = free_names(docs, "key", "spans")
    keyed = docs.withColumn(own, _key(docs))
    every = spans(keyed.select(F.col(own).alias("key"), "text"))
    ordered = Window.partitionBy("key").orderBy("start", "end", "kind")
    upto = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        every.withColumn("new", (F.coalesce(upto, F.lit(-1)) <= F.col("start")).cast("int"))
        .withColumn("group", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
        .groupBy(F.col("key").alias(own)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(found))
    )
    size = F.size(found)
    pieces = F.transform(
        F.sequence(F.lit(1), size + 1),
        lambda k: F.concat(
            F.substring(
                F.col("text"),
                (F.when(k == 1, F.lit(0)).otherwise(F.get(F.col(found), k - 2)["end"]) + 1).cast("int"),
                (F.when(k <= size, F.get(F.col(found), k - 1)["start"]).otherwise(F.length("text").cast("long")) - F.when(k == 1, F.lit(0)).otherwise(F.get(F.col(found), k - 2)["end"])).cast("int"),
            ),
            F.when(k <= size, F.concat(F.lit("<"), F.upper(F.get(F.col(found), k - 1)["kind"]), F.lit(">"))).otherwise(F.lit("")),
        ),
    )
    out = keyed.join(merged, own, "left").withColumn("text", F.when(F.col(found).isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(quoted(c)) for c in docs.columns])
