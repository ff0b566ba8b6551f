"""Ingest of messy exports end to end."""

import hashlib
import random
import zipfile

import pytest
from conftest import column, rows
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from eventmart import schemas as S
from eventmart.operators import ledger
from eventmart.plans import ingest
from eventmart.session import maybe_among
from eventmart.sinks import bundles
from eventmart.sinks import store as sink
from eventmart.sources import files, store, text_exports
from eventmart.sources.archives import unpack_archives
from eventmart.streaming.drop_folder import pick_up

SUBS = (
    "﻿Organization Name,Challenge Title,Project Title,Submission Url,Built With,Created At,Created  At,"
    "Project Created At,Additional Team Member Count\n"
    'Org A,Ev 1,"P, ""one""\nline",https://ev1.devpost.com/s/1,"JS, React.js",,2024-05-01,2024-05-01T10:00:00+02:00,2\n'
    "Org  B ,Ev 1,P2,https://ev1.devpost.com/s/2,None,2024-01-01,,bad,x\n"
).encode()
PEOPLE = "Hackathon Name;User ID;Country;Work Experience;Skills;Interests\nEv 1;12.0;España;60;ai;x\nEv 1;13;N/A;3;;y\n".encode("latin-1")
PROMOTED = b"Unnamed: 0\tUnnamed: 1\tz\nUser ID\tCountry\tSkills\n5\tFR\tml\n6\tDE\tml;ai\n"


@pytest.fixture
def drop(tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    files = {
        "a subs+1.csv": SUBS, "b.csv": PEOPLE, "copy.csv": PEOPLE, "c.CSV": PROMOTED, "~t.csv": b"User ID,b\n1,2\n",
        "empty.csv": b"", "unknown.csv": b"foo,bar\n1,2\n", "header.csv": b"User ID,Country\n", "notes.txt": b"x",
    }
    for name, content in files.items():
        (folder / name).write_bytes(content)
    return folder


def test_folder(spark, tmp_path, drop):
    where = (str(tmp_path / "store"), str(tmp_path / "ledger"))
    assert not store.data_exists(spark, where[0])
    report = ingest.ingest_folder(spark, str(drop), *where)
    by_name = {r.file_name: r for r in report.collect()}
    assert {n: r.status for n, r in by_name.items()} == {
        "a subs+1.csv": "processed", "b.csv": "processed", "copy.csv": "skipped", "c.CSV": "processed",
        "empty.csv": "failed", "unknown.csv": "failed", "header.csv": "failed",
    }
    assert by_name["unknown.csv"].error == "Unknown file type. Columns found: foo, bar"
    assert by_name["empty.csv"].error == "Empty or unreadable file"
    assert rows(ingest.run_totals(report)) == [(7, 3, 1, 3)]

    subs = {r[S.URL]: r for r in store.read_store(spark, where[0], "submission").collect()}
    one, two = subs["https://ev1.devpost.com/s/1"], subs["https://ev1.devpost.com/s/2"]
    assert one[S.PROJECT] == 'P, "one" line' and one[S.CREATED].hour == 8 and one["Created At"].month == 5
    assert two[S.ORG] == "Org B" and two[S.BUILT_WITH] == "" and two[S.CREATED] is None and two[S.EXTRA_MEMBERS] is None
    assert "Created At.1" not in one.asDict()
    people = {r[S.USER]: r for r in store.read_store(spark, where[0], "registrant").collect()}
    assert set(people) == {"12", "13", "5", "6"}
    assert people["12"][S.COUNTRY] == "España" and people["12"][S.EXPERIENCE] is None
    assert people["13"][S.COUNTRY] == "" and people["13"][S.EXPERIENCE] == 3.0
    assert people["12"][S.DEDUP_KEY] == "Ev 1|12" and S.INTERESTS not in people["12"].asDict()
    # a file without the identity columns keeps all its rows
    assert people["5"][S.DEDUP_KEY] != people["6"][S.DEDUP_KEY]

    before = sorted(map(str, people.values()))
    again = ingest.run_totals(ingest.ingest_folder(spark, str(drop), *where)).first()
    assert (again.processed_files, again.skipped_files, again.failed_files) == (0, 4, 3)
    assert sorted(map(str, store.read_store(spark, where[0], "registrant").collect())) == before
    jobs = ledger.state(ledger.read(spark, where[1]))
    assert rows(ledger.statistics(jobs))[0] == (6, 3, 3, 0, 6)
    assert store.data_exists(spark, where[0])
    assert column(store.store_summary(spark, where[0]), "row_count") == [2, 4]


def test_retry(spark, tmp_path, drop):
    where = (str(tmp_path / "store"), str(tmp_path / "ledger"))
    ingest.ingest_folder(spark, str(drop), *where)
    jobs = ledger.state(ledger.read(spark, where[1]))
    ledger.append(ledger.event(jobs.filter("file_name = 'b.csv'").withColumn("path", F.col("retry_path")), "failed", 2**60, error=F.lit("x")), where[1])
    (drop / "unknown.csv").unlink()
    names = spark.createDataFrame([("b.csv",), ("unknown.csv",)], "file_name string")
    report = {r.file_name: r for r in ingest.retry_failed(spark, *where, names=names).collect()}
    assert report["b.csv"].status == "processed" and report["b.csv"].row_count == 2
    assert report["unknown.csv"].error.startswith("Retry file not found")
    assert ledger.state(ledger.read(spark, where[1])).filter("file_name = 'b.csv'").first().attempts == 2


def test_archives(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    with zipfile.ZipFile(folder / "x.zip", "w") as archive:
        archive.writestr("sub/a.csv", "User ID,Hackathon Name,Country,Skills\n99,Ev 9,IT,go\n")
        archive.writestr("../evil.csv", "User ID,Country\n1,X\n")
        archive.writestr("b.CSV", "User ID,Hackathon Name,Country,Skills\n98,Ev 9,IT,go\n")
        for skipped in ("__MACOSX/a.csv", "sub/~q.csv", "readme.txt"):
            archive.writestr(skipped, "x")
    members = unpack_archives(spark, str(folder), f"file://{tmp_path}/out").collect()
    assert sorted(m.member for m in members) == ["../evil.csv", "b.CSV", "sub/a.csv"]
    assert all(m.path.startswith(f"{tmp_path}/out/") for m in members)
    report = ingest.ingest_archives(spark, str(folder), str(tmp_path / "store"), str(tmp_path / "ledger"))
    assert {r.file_name: r.status for r in report.collect()} == {"a.csv": "processed", "b.CSV": "processed", "evil.csv": "processed"}


def test_stream_picks_up_new_files_only(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    where = [str(tmp_path / n) for n in ("store", "ledger", "checkpoint")]
    (folder / "one.csv").write_bytes(PEOPLE)
    pick_up(spark, str(folder), *where)
    (folder / "two.csv").write_bytes(PROMOTED)
    pick_up(spark, str(folder), *where)
    jobs = ledger.state(ledger.read(spark, where[1]))
    assert sorted(column(jobs, "attempts")) == [1, 1]
    assert store.read_store(spark, where[0], "registrant").count() == 4


def test_store_skips_unreadable_parts_and_puts_legacy_last(spark, tmp_path):
    root = tmp_path / "store"
    parts = root / "submissions" / "parts" / "_file_hash=h1"
    data = [("u1", "new", 1, 1), ("u2", "new", 1, 2)]
    spark.createDataFrame(data, "_dedup_key string, v string, _ingest_seq long, _row_no long").coalesce(1).write.parquet(str(parts))
    (parts / "broken.parquet").write_bytes(b"not parquet")
    legacy = str(tmp_path / "legacy")
    spark.createDataFrame([("u1", "old", "x"), ("u3", "old", "x")], "_dedup_key string, v string, extra string").write.parquet(legacy)
    got = store.read_store(spark, str(root), "submission", legacy)
    assert sorted((r._dedup_key, r.v) for r in got.collect()) == [("u1", "new"), ("u2", "new"), ("u3", "old")]
    assert store.read_store(spark, str(tmp_path / "nothing"), "submission") is None


def test_store_names_skipped_parts_and_raises_on_others(spark, tmp_path):
    root = tmp_path / "a store+1"
    parts = root / "submissions" / "parts"
    for name in ("h1", "h2"):
        data = [(name, "v" * 50, k, 1) for k in range(50)]
        spark.createDataFrame(data, "_dedup_key string, v string, _row_no long, _ingest_seq long").coalesce(1).write.parquet(str(parts / f"_file_hash={name}"))
    assert store.skipped_parts(spark, str(root), "submission").count() == 0
    (parts / "_file_hash=h1" / "broken.parquet").write_bytes(b"not parquet")
    with pytest.warns(UserWarning, match="broken.parquet"):
        got = store.read_store(spark, str(root), "submission", deduplicate=False)
    assert got.count() == 100 and {r[0] for r in got.select("_file_hash").distinct().collect()} == {"h1", "h2"}
    assert [r.path.split("/")[-1] for r in store.skipped_parts(spark, str(root), "submission").collect()] == ["broken.parquet"]
    # a part whose footer is whole and whose pages are not
    hurt = next((parts / "_file_hash=h2").glob("*.parquet"))
    content = bytearray(hurt.read_bytes())
    content[4:200] = b"\xff" * 196
    hurt.write_bytes(bytes(content))
    (hurt.parent / f".{hurt.name}.crc").unlink()
    with pytest.warns(UserWarning), pytest.raises(Exception):
        store.read_store(spark, str(root), "submission", deduplicate=False).collect()


def test_single_file(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b"a|b\n1|\"x|y\"\n")
    got = text_exports.load_file(spark, str(path))
    assert got.columns == ["a", "b"] and rows(got) == [("1", "x|y")]
    (tmp_path / "e.csv").write_bytes(b"")
    with pytest.raises(ValueError):
        text_exports.load_file(spark, str(tmp_path / "e.csv"))


def test_line_no_value_can_hold_is_reported(spark, tmp_path, drop):
    with open(drop / "large.csv", "wb") as out:  # sparse
        out.write(b"User ID,Country,Skills\n1,FR,ml\n")
        out.truncate(2_200_000_000)
    report = ingest.ingest_folder(spark, str(drop), str(tmp_path / "store"), str(tmp_path / "ledger"))
    by_name = {r.file_name: r for r in report.collect()}
    assert by_name["large.csv"].status == "failed" and by_name["large.csv"].error.startswith("A line is longer than")
    assert {n for n, r in by_name.items() if r.status == "processed"} == {"a subs+1.csv", "b.csv", "c.CSV"}
    state = {r.file_name: r.status for r in ledger.state(ledger.read(spark, str(tmp_path / "ledger"))).collect()}
    assert state["large.csv"] == "failed" and state["b.csv"] == "completed"


def test_file_of_three_gigabytes(spark, tmp_path):
    folder, count, hole = tmp_path / "drop", 100_000, 1 << 15
    folder.mkdir()
    with open(folder / "large.csv", "wb") as out:  # sparse
        out.write(b"User ID,Hackathon Name,Country,Skills\n")
        for k in range(count):
            out.write(b"%d,Ev,FR,x" % k)
            out.seek(hole, 1)
            out.write(b"y\n")
    assert (folder / "large.csv").stat().st_size > 3_000_000_000
    info = text_exports.profile(text_exports.scan_files(spark, str(folder))).first()
    assert info.whole_lines and info.problem is None and info.length > 3_000_000_000
    digest = hashlib.sha256()
    with open(folder / "large.csv", "rb") as source:
        while chunk := source.read(1 << 24):
            digest.update(chunk)
    assert info.file_hash == digest.hexdigest()
    parts = text_exports.read_layout(spark, [info.path], info.names, info.delimiter, info.encoding, True)
    assert parts.rdd.getNumPartitions() > 8
    report = ingest.ingest_folder(spark, str(folder), str(tmp_path / "store"), str(tmp_path / "ledger")).collect()
    assert [(r.status, r.row_count) for r in report] == [("processed", count)]
    people = store.read_store(spark, str(tmp_path / "store"), "registrant")
    assert people.select(S.USER).distinct().count() == count


def plain_lines(content):
    """Whether both ways of reading must agree: judged by splitting at quotes one by one."""
    inside, cell_start, sure = False, True, True
    for k, c in enumerate(content):
        if c == '"':
            if not inside and not (cell_start or content[k - 1] == '"'):
                sure = False
            inside, cell_start = not inside, False
        else:
            if inside and c in "\r\n":
                sure = False
            cell_start = not inside and c in ",;\t|\n\r"
    lines = content.replace("\r\n", "\n").split("\n")
    return sure and not inside and "\r" not in content.replace("\r\n", "") and not any(x and not x.strip() for x in lines)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_line_test_in_chunks(size):
    rng = random.Random(size)
    seen = set()
    for _ in range(1500):
        content = "".join(rng.choice(["a", "b,", '"', '"x",', '""', "\n", "\r\n", "\r" if rng.random() < 0.1 else "c", " ", "\t"]) for _ in range(rng.randrange(12)))
        test = files.LineTest()
        for at in range(0, len(content), size):
            test.add(content[at : at + size].encode())
        got = test.result()
        seen.add(got)
        if got:  # it may doubt more than it must, never less
            assert plain_lines(content), repr(content)
        assert max(test.longest, test.line) >= max(map(len, content.split("\n")))
    assert seen == {True, False}


def test_lines_in_several_tasks_give_the_same_rows(spark, tmp_path):
    rng = random.Random(3)
    lines = [f'{k},"Ev, ""{k % 7}""",{rng.choice(["FR", "N/A", "", " x "])},{"s" * (k % 50)}' for k in range(5000)]
    lines[100] += ",more,cells"
    text = "User ID,Hackathon Name,Country,Skills\n\n" + "\n".join(lines) + "\n"
    path = tmp_path / "x.csv"
    path.write_bytes(text.replace("\n", "\r\n").encode())
    names = ["User ID", "Hackathon Name", "Country", "Skills"]
    assert files.look(str(path))["whole_lines"]
    def shown(whole):
        rows = text_exports.read_layout(spark, [str(path)], names, ",", "UTF-8", whole)
        return rows.rdd.getNumPartitions(), [tuple(r) for r in rows.orderBy(S.BLOCK, S.ROW_NO).select(*[f"`{n}`" for n in names], text_exports.CELLS).collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        tasks, split = shown(True)
        one, whole = shown(False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 5 and one == 1 and split == whole and len(split) == 5000
    assert [r[-1] for r in split if r[-1]] == [6]


def test_stream_with_a_file_above_the_readers_limit(spark, tmp_path, drop):
    with open(drop / "large.csv", "wb") as out:  # sparse
        out.truncate(2_200_000_000)
    (drop / "d[1].csv").write_bytes(PEOPLE.replace(b"13;", b"14;"))
    where = (str(tmp_path / "store"), str(tmp_path / "ledger"))
    pick_up(spark, str(drop), *where, str(tmp_path / "checkpoint"))
    state = {r.file_name: r.status for r in ledger.state(ledger.read(spark, where[1])).collect()}
    assert state["large.csv"] == "failed" and state["c.CSV"] == "completed"
    assert "d[1].csv" in state


def test_bundles(spark, tmp_path):
    full = spark.range(10).select("id", F.array(F.lit("a"), F.lit("b")).alias("names"))
    manifest = bundles.write_bundle(spark, {"My Table": full, "Empty": full.limit(0), "None": None}, str(tmp_path / "out" / "b1"), "csv")
    assert [(r.table, r.rows) for r in manifest.collect()] == [("My Table", 10)]
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "b1" / "my_table"))
    assert back.count() == 10 and back.first().names == "a, b"
    history = bundles.export_history(spark, str(tmp_path / "out")).first()
    assert (history.Filename, history.Tables, history.Rows) == ("b1", 1, 10) and history["Size (KB)"] > 0
    assert not (tmp_path / "out" / "b1" / "empty").exists()
    # what turns out empty while it runs, a table written again, a bundle without tables
    late = full.groupBy("id").agg(F.sum("id").alias("n")).filter("n < 0")
    again = bundles.write_bundle(spark, {"My Table": full.limit(3), "Late": late}, str(tmp_path / "out" / "b1"))
    assert [(r.table, r.rows) for r in again.collect()] == [("My Table", 3)]
    bundles.write_bundle(spark, {"Late": late}, str(tmp_path / "out" / "b2"))
    found = {r.Filename: (r.Tables, r.Rows) for r in bundles.export_history(spark, str(tmp_path / "out")).collect()}
    assert found == {"b1": (1, 3), "b2": (0, 0)}
    assert bundles.export_history(spark, str(tmp_path / "none")).count() == 0
    assert bundles.raw_export(full, str(tmp_path / "raw"), "parquet") == {"rows": 10, "columns": 2}
    with pytest.raises(ValueError):
        bundles.raw_export(full, str(tmp_path / "raw"), "xlsx")


def test_nothing_is_lost_and_one_file_stops_no_other(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    head = "Submission Url,Project Title,Built With"
    long = ",".join(f"note {k} " + "x" * 2000 for k in range(50))
    files = {
        "good.csv": f"{head}\nhttps://a.b/1,P,js\n", "case.csv": f"{head},Skills,skills\nhttps://a.b/2,P,js,1,2\n",
        "long.csv": f"{head},{long}\nhttps://a.b/3,P,js\n", "wide.csv": f"{head}\nhttps://a.b/4,P,js,extra,more\nhttps://a.b/5,P,js\n",
        "short.csv": f"{head}\nhttps://a.b/6,P\n", "colon.csv": head.replace(",", ":") + "\nx:P:js\n",
    }
    for name, content in files.items():
        (folder / name).write_text(content)
    where = (str(tmp_path / "s"), str(tmp_path / "l"))
    report = {r.file_name: r for r in ingest.ingest_folder(spark, str(folder), *where).collect()}
    assert {n for n, r in report.items() if r.status == "processed"} == {"good.csv", "case.csv", "long.csv", "short.csv"}
    assert report["wide.csv"].error == "Rows wider than the header: expected 3 cells, saw up to 5 (1 rows)"
    stored = store.read_store(spark, where[0], "submission")
    assert sorted(r["Submission Url"] for r in stored.collect()) == [f"https://a.b/{k}" for k in (1, 2, 3, 6)]
    assert {"Skills", "skills.1"} <= set(stored.columns)
    jobs = ledger.state(ledger.read(spark, where[1])).collect()
    assert {r["status"] for r in jobs} == {"completed", "failed"}


def test_repeated_headers_get_free_numbers(spark):
    from eventmart.operators.clean import repaired_header

    df = spark.createDataFrame([(["a", "A", "a.1", "a"],)], "names array<string>")
    assert df.select(repaired_header(df["names"], ingest.F.lit(None).cast("array<string>"))).first()[0] == ["a", "A.2", "a.1", "a.3"]


# ---- the current table ----------------------------------------------------------


RECORDS = "_dedup_key string, v string, _ingest_seq long, _file_hash string, _block long, _row_no long"


def records(spark, seq, pairs, file="f"):
    return spark.createDataFrame([(k, v, seq, file, 0, n) for n, (k, v) in enumerate(pairs)], RECORDS)


def stored(spark, root, **options):
    found = store.read_store(spark, root, "submission", **options)
    return sorted(("-" if r._dedup_key is None else r._dedup_key, r.v) for r in found.collect())


def test_current_table_keeps_the_first_of_each_identity(spark, tmp_path):
    root = str(tmp_path / "s")
    assert store.read_store(spark, root, "submission") is None
    first = records(spark, 1, [("a", "1"), ("b", "1"), ("a", "2"), (None, "1"), (None, "2"), ("", "1")])
    for _ in range(2):  # again changes nothing
        sink.merge_records(first, root, "submission", buckets=3)
    second = records(spark, 2, [("b", "9"), ("c", "9"), (None, "9")], "g").withColumn("Extra", F.lit(1)).withColumnRenamed("v", "V")
    sink.merge_records(second, root, "submission", staged=True)
    want = [("", "1"), ("-", "1"), ("a", "1"), ("b", "1"), ("c", "9")]
    assert stored(spark, root) == want
    found = store.read_store(spark, root, "submission")
    assert S.BUCKET not in found.columns and {r.Extra for r in found.collect()} == {None, 1}
    assert {n.split("-of-")[1] for n in store.child_names(spark, store.current_path(spark, root, "submission")) if "=" in n} == {"00003"}
    for number in (2, 3, 4):
        sink.compact(spark, root, "submission", buckets=2)
        assert stored(spark, root) == want and store.current_path(spark, root, "submission").endswith(f"{number:06d}")
    assert store.generations(spark, root, "submission") == [3, 4]
    sink.merge_records(records(spark, 5, [("c", "0"), ("d", "0")]), root, "submission", staged=True)
    assert stored(spark, root) == [*want, ("d", "0")]
    with pytest.raises(ValueError):
        sink.merge_records(first.withColumn("v", F.lit(1)), root, "submission")


def below(path):
    return {f"{f.parent.name}/{f.name}" for f in path.rglob("*.parquet")}


def test_new_records_are_written_once(spark, tmp_path):
    root, current = str(tmp_path / "s"), tmp_path / "s" / "submissions" / "current" / "generation-000001"
    staged, rows = sink.stage_records(records(spark, 1, [(k, "1") for k in "abcdefgh"]).coalesce(1), root, "submission")
    first = {f"{r[0]}/{r[1]}" for r in sink._located(rows).select(F.concat(F.lit(f"{S.BUCKET}="), S.BUCKET), "_file").distinct().collect()}
    sink.merge_staged(staged, rows, root, "submission")
    assert len(first) > 1 and below(current) == first
    # one stored already, one twice, one refused
    more = records(spark, 2, [("a", "2"), ("x", "1"), ("x", "2"), ("no", "1"), *((f"n{k}", "1") for k in range(30))], "g")
    staged, rows = sink.stage_records(more.withColumn("_cells", F.lit(9)).coalesce(1), root, "submission")
    sink.merge_staged(staged, rows, root, "submission", lambda r: r.filter(f"{S.DEDUP_KEY} = 'no'"), ("_cells",))
    want = [*((k, "1") for k in "abcdefgh"), *((f"n{k}", "1") for k in range(30)), ("x", "1")]
    assert stored(spark, root) == sorted(want)
    assert below(current) > first and not list(current.parent.glob("staged-*"))
    assert "_cells" not in store.read_store(spark, root, "submission").columns


def test_new_identities_are_shuffled_once(spark, tmp_path, monkeypatch):
    root, plans = str(tmp_path / "s"), []
    sink.merge_records(records(spark, 1, [("a", "1")]), root, "submission")
    monkeypatch.setattr(sink, "_write", lambda df, *_: plans.append(df._jdf.queryExecution().executedPlan().toString()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sink.merge_records(records(spark, 2, [("a", "2"), ("b", "2")]), root, "submission")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the records once and the stored identities once, sorted by hash and not by text that begins alike
    assert plans[0].count("Exchange hashpartitioning") == 2 and "Sort [_hash" in plans[0]


def test_of_many_repetitions_only_those_are_shuffled(spark, tmp_path, monkeypatch):
    root, plans = str(tmp_path / "s"), []
    sink.merge_records(records(spark, 1, [("a", "1"), ("b", "1")]), root, "submission")
    pairs = [("a", "2"), *(("x", str(k)) for k in range(5)), ("no", "1"), ("both", "1"), (None, "1"), (None, "2"), *((f"n{k}", "1") for k in range(300))]
    more = records(spark, 2, pairs, "g").union(records(spark, 2, [("both", "2"), ("y", "2")], "bad"))
    staged, rows = sink.stage_records(more.coalesce(1), root, "submission")

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df)

    # every list counts as too long to be broadcast, as with 200,000 repetitions and gigabytes staged
    materialise = sink.materialise
    monkeypatch.setattr(sink, "materialise", seen)
    monkeypatch.setattr(sink, "is_small", lambda *_: False, raising=False)
    monkeypatch.setattr(sink, "broadcast_if_small", lambda df, *_: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sink.merge_staged(staged, rows, root, "submission", lambda r: r.filter(f"{S.FILE_HASH} = 'bad' or {S.DEDUP_KEY} = 'no'"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert stored(spark, root) == sorted([("-", "1"), ("a", "1"), ("b", "1"), ("both", "1"), ("x", "0"), *((f"n{k}", "1") for k in range(300))])
    # refused records, hashes that repeat, records to leave out: none is found by a join of all records
    assert len(plans) == 3 and "LeftAnti" not in plans[1] and "LeftSemi" not in plans[2] and "BroadcastHashJoin" in plans[2]


def test_filter_of_hashes_finds_all_and_few_others(spark):
    few = spark.range(0, 5000, 50).select(F.xxhash64("id").alias("_number"))
    told = maybe_among(spark.range(20000), F.xxhash64("id"), few)
    hits = [r.id for r in told.filter("_maybe").collect()]
    assert told.count() == 20000 and told.columns == ["id", "_maybe"]
    assert set(range(0, 5000, 50)) <= set(hits) and len(hits) == len(set(hits)) < 110


def test_figures_of_files_do_not_sort_records(spark):
    seen = [("f", 0, 7, None), ("f", 0, 5, 9), ("f", 3, 1, None), ("g", 2, 2**33, 4), ("g", 2, 2**33 + 1, 6)]
    read = spark.createDataFrame(seen, f"_file_hash string, {S.BLOCK} long, {S.ROW_NO} long, {text_exports.CELLS} int")
    found = text_exports.file_figures(read, S.FILE_HASH)
    assert sorted(rows(found)) == [("f", 3, (0, 5), 1, 9), ("g", 2, (2, 2**33), 2, 6)]
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert "HashAggregate" in [line for line in plan if "Aggregate" in line][-1]


def test_staging_keeps_a_file_open_per_folder(spark, tmp_path, monkeypatch):
    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    before = spark.conf.get(name)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **k: (seen.append(int(spark.conf.get(name))), write(w, *a, **k))[1])
    sink.stage_records(records(spark, 1, [(str(k), "1") for k in range(50)]), str(tmp_path / "s"), "submission")
    # a task that has opened as many files as it may sorts the rest of its records
    assert seen == [sink.BUCKETS + 1] and spark.conf.get(name) == before


def test_generation_that_broke_off_does_not_count(spark, tmp_path):
    root = str(tmp_path / "s")
    sink.merge_records(records(spark, 1, [("a", "1")]), root, "submission")
    half = store.generation_path(root, "submission", 2)
    records(spark, 1, [("z", "1")]).write.parquet(half)
    (tmp_path / "s" / "submissions" / "current" / "generation-000002" / "_SUCCESS").unlink()
    assert stored(spark, root) == [("a", "1")]
    sink.compact(spark, root, "submission")
    assert stored(spark, root) == [("a", "1")]


def test_older_parts_come_first_and_legacy_last(spark, tmp_path):
    root, legacy = str(tmp_path / "s"), str(tmp_path / "legacy")
    sink.write_parts(records(spark, 1, [("a", "part"), ("a", "part2"), ("b", "part")]), root, "submission")
    sink.merge_records(records(spark, 2, [("b", "now"), ("c", "now")]), root, "submission")
    spark.createDataFrame([("c", "old"), ("d", "old")], "_dedup_key string, v string").write.parquet(legacy)
    assert stored(spark, root, legacy=legacy) == [("a", "part"), ("b", "part"), ("c", "now"), ("d", "old")]


def test_reading_one_column_reads_one_column(spark, tmp_path):
    root = str(tmp_path / "s")
    sink.merge_records(records(spark, 1, [("a", "1"), ("b", "2")]), root, "submission")
    plan = store.read_store(spark, root, "submission").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<v:string>" in plan
    for word in ("Aggregate", "Sort", "Exchange", "Join"):
        assert word not in plan


def test_retry_looks_at_paths_and_not_at_folders(spark, tmp_path, drop):
    where = (str(tmp_path / "store"), str(tmp_path / "ledger"))
    ingest.ingest_folder(spark, str(drop), *where)
    jobs = ledger.state(ledger.read(spark, where[1]))
    events = jobs.filter("file_name = 'a subs+1.csv'").withColumn("path", F.col("retry_path"))
    ledger.append(ledger.event(events, "failed", 2**60, error=F.lit("x")), where[1])
    (drop / "new.csv").write_bytes(PEOPLE.replace(b"13;", b"15;"))
    report = {r.file_name: r.status for r in ingest.retry_failed(spark, *where).collect()}
    assert "new.csv" not in report and report["a subs+1.csv"] == "processed"
    assert store.read_store(spark, where[0], "submission").count() == 2
