"""Side effects of rows that count once, however often a task is tried.

``foreachPartition`` runs its effect again when a task is tried again or doubled by speculation, and nobody can tell the copies apart. Here a task only prepares its effects, in
a file of its own attempt, and reports the file. When all tasks are done the driver commits: one manifest names the files that count. Attempts that no manifest
names are never seen, an aborted job removes its files.

    <path>/attempts/<id>.jsonl      what one attempt of one task prepared, a JSON line for each row
    <path>/committed/<id>.json      the files of one finished write, and its rows

Paths are folders all executors reach, as URIs or plain paths.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tidewright_effects"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style URI or plain path, and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass
class Prepared(WriterCommitMessage):
    file: str
    rows: int


class EffectsWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Prepared:
        """In a task: prepare the effects of its rows in a file no other attempt uses."""
        files, base = file_system(self.path)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        files.create_dir(f"{base}/attempts")
        with files.open_output_stream(f"{base}/attempts/{name}") as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
                rows += 1
        return Prepared(name, rows)

    def commit(self, messages: list[Prepared]) -> None:
        """On the driver, once: the manifest makes all files count together."""
        files, base = file_system(self.path)
        done = [m for m in messages if m is not None and m.rows]
        files.create_dir(f"{base}/committed")
        manifest, name = {"files": [m.file for m in done], "rows": sum(m.rows for m in done)}, uuid.uuid4().hex
        with files.open_output_stream(f"{base}/committed/{name}.tmp") as out:
            out.write(json.dumps(manifest).encode())
        files.move(f"{base}/committed/{name}.tmp", f"{base}/committed/{name}.json")

    def abort(self, messages: list[Prepared]) -> None:
        files, base = file_system(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{base}/attempts/{m.file}")


class Effects(DataSource):
    """``df.write.format(FORMAT).mode("append").save(path)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> EffectsWriter:
        if overwrite:
            raise ValueError("effects can't be taken back: use mode append")
        return EffectsWriter(self.options["path"])


def write_effects(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    spark.dataSource.register(Effects)
    df.write.format(FORMAT).mode("append").save(path)


def committed_files(path: str) -> list[str]:
    """Names of the files that count: one for each task of each finished write."""
    files, base = file_system(path)
    found = files.get_file_info(fs.FileSelector(f"{base}/committed", allow_not_found=True))
    names = []
    for info in found:
        if info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as manifest:
                names += json.loads(manifest.read())["files"]
    return sorted(names)


def read_effects(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The effects that count, each once."""
    names = committed_files(path)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/attempts/{n}" for n in names])
