"""Delimited text exports: listing, profiling and reading (SRC-02, SRC-04, VAL-05..07, FN-19)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.text import collapse, strip
from ..operators.clean import header_is_broken, quoted, repaired_header
from ..session import materialise
from .files import LINE, decoded, looked_at

# Delimiters looked for, in order of preference on ties.
DELIMITERS = [",", ";", "\t", "|"]
# Cell texts that table readers take for a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Start of the message for a file of neither kind; such a file can still be loaded.
UNKNOWN_KIND = "Unknown file type"
_RECORD = r'^([^"\r\n]*+(?:"[^"]*+"[^"\r\n]*+)*+)'

# Number of cells of a record with more cells than the header.
CELLS = "_cells"

def scan_files(spark: SparkSession, *folders: str, recursive: bool = False) -> DataFrame:
    """Exports in the drop folders as (uri, path, length, file_name); no content is read.

    Sub-folders are left out unless ``recursive``. The scan skips files without any
    byte, so those are added from the file index, to be reported as unreadable.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]")
    raw = reader.option("recursiveFileLookup", recursive).load(list(folders))
    full = raw.select(F.col("_metadata.file_path").alias("uri"), "path", "length")
    listed = spark.createDataFrame([(u,) for u in raw.inputFiles()], "uri string")
    seen = full.select(_plain_uri(F.col("uri")).alias("_seen"))
    empty = listed.withColumn("_plain", _plain_uri(F.col("uri"))).join(seen, F.col("_plain") == F.col("_seen"), "left_anti")
    path = F.url_decode(F.replace("_plain", F.lit("+"), F.lit("%2B")))
    empty = empty.select("uri", path.alias("path"), F.lit(0).cast("long").alias("length"))
    return named_files(full.unionByName(empty))


def _plain_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file:/+", "file:/")


def named_files(raw: DataFrame) -> DataFrame:
    """Add the file name and drop temporary files, whose names start with a tilde."""
    named = raw.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return named.filter(~F.col("file_name").startswith("~"))


# ---- profile: everything known about a file before it is read ------------------------


def _cells(record: Column, delimiter: str) -> Column:
    outside_quotes = re.escape(delimiter) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    def unquoted(cell):
        bare = F.regexp_extract(cell, r'^\s*"((?s).*)"\s*$', 1)
        return F.when(cell.rlike(r'^\s*"'), F.replace(bare, F.lit('""'), F.lit('"'))).otherwise(cell)
    return F.transform(F.split(record, outside_quotes, -1), unquoted)


def _delimiter(record: Column, delimiters: list[str]) -> Column:
    bare = F.regexp_replace(record, '"[^"]*"', "")
    counted = [
        F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("d"))
        for i, d in enumerate(delimiters)
    ]
    return F.array_max(F.array(*counted)).getField("d")


def classify(names: Column, file_name: Column) -> Column:
    """submission, registrant or unknown, from the headers and then the file name (VAL-05)."""
    known = F.transform(names, lambda n: F.lower(collapse(n)))
    def score(markers):
        return F.size(F.array_intersect(known, F.array(*[F.lit(m) for m in markers])))
    subs, regs = score(S.SUBMISSION_MARKERS), score(S.REGISTRANT_MARKERS)
    low = F.lower(file_name)
    return (
        F.when((subs >= 3) & (subs >= regs), "submission")
        .when(regs >= 3, "registrant")
        .when(F.array_contains(known, "submission url"), "submission")
        .when(F.array_contains(known, "user id"), "registrant")
        .when(F.contains(low, F.lit("registrant")), "registrant")
        .when(F.contains(low, F.lit("submission")), "submission")
        .otherwise("unknown")
    )


def profile(files: DataFrame, delimiters: list[str] = DELIMITERS) -> DataFrame:
    """One row per file: hash, encoding, delimiter, headers, kind, and what is wrong with it.

    Each file is read once as a stream, whatever its size. ``whole_lines`` says that every line break
    ends a record, so that the file can be read in several tasks.
    """
    opened = looked_at(files).withColumns({
        "encoding": F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1"),
        "_text": decoded(F.coalesce("head", F.lit(b"")), F.col("utf8")),
    })
    opened = opened.withColumn("_first", F.regexp_extract("_text", _RECORD, 1))
    rest = F.regexp_replace(F.substr("_text", F.length("_first") + 1), r"^[\r\n]+", "")
    opened = opened.withColumn("_second", F.regexp_extract(rest, _RECORD, 1))
    split = opened.withColumn("delimiter", _delimiter(F.col("_first"), delimiters))
    def cells(record):
        chosen = _cells(F.col(record), delimiters[0])
        for d in delimiters[1:]:
            chosen = F.when(F.col("delimiter") == d, _cells(F.col(record), d)).otherwise(chosen)
        return chosen
    split = split.withColumns({"_c1": cells("_first"), "_c2": F.when(strip(F.col("_second")) != "", cells("_second"))})
    # A header cell beyond the second row's width would shift names; pad the shorter row.
    width = F.size("_c1")
    padded = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.get("_c2", i))
    second = F.when(F.col("_c2").isNotNull(), padded)
    broken = header_is_broken(F.col("_c1")) & F.col("_c2").isNotNull()
    shaped = split.withColumns({
        "names": repaired_header(F.col("_c1"), F.transform(second, lambda c: F.nullif(c, F.lit("")))),
        "header_rows": F.when(broken, 2).otherwise(1),
    })
    shaped = shaped.withColumn("file_type", classify(F.col("names"), F.col("file_name")))
    problem = (
        F.when(F.col("head").isNull(), F.lit("The first records do not end"))
        .when(F.col("longest") > LINE, F.lit(f"A line is longer than {LINE} bytes"))
        .when(F.col("_c2").isNull(), F.lit("Empty or unreadable file"))
        .when(
            F.col("file_type") == "unknown",
            F.concat(F.lit(f"{UNKNOWN_KIND}. Columns found: "), F.array_join("names", ", ")),
        )
    )
    return shaped.select(
        "uri", "path", "file_name", "length", "file_hash", "encoding", "delimiter", "names",
        "header_rows", "file_type", "whole_lines", problem.alias("problem"),
    )


# ---- reading ------------------------------------------------------------------------


def read_layout(
    spark: SparkSession, paths: list[str], names: list[str], delimiter: str, encoding: str, whole_lines: bool = False
) -> DataFrame:
    """Files that share one layout, every column as text, with their origin.

    ``_uri`` is the file; ``_block`` and then ``_row_no`` grow along each file. Files of ``whole_lines`` are
    read line by line, so large ones are cut into several tasks; in others quoted line breaks
    make a file one task. ``_cells`` is the number of cells of a record that has more of them than the
    header, which no column holds. A second header line is the first record; the caller leaves it out.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    schema = schema.add("_raw", T.StringType())
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("multiLine", not whole_lines)
        .option("columnNameOfCorruptRecord", "_raw")
        .option("columnPruning", False)
        .option("quote", '"')
        .option("escape", '"')
        .csv(paths)
    )
    cells = [
        F.when(~quoted(f"c{i}").isin(*MISSING), quoted(f"c{i}")).alias(name) for i, name in enumerate(names)
    ]
    found = F.size(_cells(F.col("_raw"), delimiter))
    return raw.select(
        *cells,
        F.when(F.col("_raw").isNotNull() & (found > len(names)), found).alias(CELLS),
        F.col("_metadata.file_path").alias("_uri"),
        F.col("_metadata.file_block_start").alias(S.BLOCK),
        F.monotonically_increasing_id().alias(S.ROW_NO),
    )


def file_figures(rows: DataFrame, file: str) -> DataFrame:
    """Per file: rows, its first record (_block, _row_no), records wider than the header and their most cells."""
    # a least pair of two columns would sort all records, so the pairs are those of blocks
    blocks = rows.groupBy(file, S.BLOCK).agg(
        F.count(F.lit(1)).alias("rows"), F.min(S.ROW_NO).alias(S.ROW_NO), F.count(CELLS).alias("wide"), F.max(CELLS).alias("most")
    )
    return blocks.groupBy(file).agg(
        F.sum("rows").alias("rows"), F.min(F.struct(S.BLOCK, S.ROW_NO)).alias("first"), F.sum("wide").alias("wide"), F.max("most").alias("most")
    )


def wide_problem(width: int, most: int, wide: int) -> str:
    return f"Rows wider than the header: expected {width} cells, saw up to {most} ({wide} rows)"


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """One export as text columns under its repaired headers (SRC-02)."""
    info = profile(scan_files(spark, path)).first()
    if info is None:
        raise ValueError(f"{path}: no such export")
    if info.problem and not info.problem.startswith(UNKNOWN_KIND):
        raise ValueError(f"{path}: {info.problem}")
    rows = materialise(read_layout(spark, [info.path], info.names, info.delimiter, info.encoding, info.whole_lines))
    seen = file_figures(rows, "_uri").first()
    if seen is not None and seen.wide:
        raise ValueError(f"{path}: {wide_problem(len(info.names), seen.most, seen.wide)}")
    if seen is not None and info.header_rows > 1:
        rows = rows.filter(F.struct(S.BLOCK, S.ROW_NO) > F.struct(F.lit(seen["first"][0]), F.lit(seen["first"][1])))
    return rows.drop("_uri", S.BLOCK, S.ROW_NO, CELLS)
