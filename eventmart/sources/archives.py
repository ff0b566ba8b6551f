"""Unpacking ZIP archives into a shared folder (SRC-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def unpack_archives(spark: SparkSession, archives: str, target: str) -> DataFrame:
    """Copy the data files inside the archives to ``target``; returns (archive, member, path, length).

    One task per archive, streaming member by member, so neither an archive's files
    nor their content meet in memory. Members keep their name inside a folder
    named after archive and member path, never their own path, so an archive cannot
    write elsewhere; a task that runs again writes the same names. Each file appears
    by a rename once it is complete.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(archives)

    def unpack(batches):
        import hashlib
        import io
        import uuid
        import zipfile

        import pandas as pd
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(target)
        filesystem.create_dir(base, recursive=True)
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as opened:
                    for info in opened.infolist():
                        *folders, name = info.filename.split("/")
                        wanted = name.lower().endswith(".csv") and not name.startswith("~")
                        if info.is_dir() or not wanted or any("__MACOSX" in f for f in folders):
                            continue
                        origin = hashlib.sha256(f"{archive}\0{info.filename}".encode()).hexdigest()[:16]
                        folder = f"{base}/{origin}"
                        filesystem.create_dir(folder, recursive=True)
                        final = f"{folder}/{name}"
                        partial = f"{folder}/.{uuid.uuid4().hex}"
                        with opened.open(info) as source, filesystem.open_output_stream(partial) as sink:
                            while chunk := source.read(1 << 20):
                                sink.write(chunk)
                        filesystem.move(partial, final)
                        rows.append((archive, info.filename, final, info.file_size))
                yield pd.DataFrame(rows, columns=["archive", "member", "path", "length"])

    schema = "archive string, member string, path string, length long"
    return raw.select("path", "content").mapInPandas(unpack, schema)
