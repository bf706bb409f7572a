"""Versioned tables in a folder, written with a two-phase commit: batch sink, batch source and stream source.

    path/data/<job>-<partition>-<attempt>.parquet     what tasks have written
    path/versions/00000007.json                       a manifest: schema, all files of the version, those it added

A task writes files of its own and names them to the driver; they are visible only once the manifest that lists them is there,
and that is written whole under another name and then moved.  What failed or repeated attempts leave behind is in no manifest;
abort() and the next commit of the same job delete it.  Old versions stay readable.  One job writes a table at a time.

As a stream the offsets are version numbers: a batch is what the versions after the last committed one have added, so a query
that is stopped goes on where it ended, without losing or repeating a version.

spark.dataSource.register(Snapshots)
df.write.format("snapshots").option("path", uri).mode("append").save()
spark.read.format("snapshots").option("path", uri).option("version", 3).load()
spark.readStream.format("snapshots").option("path", uri).load()
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a batch that a file is read by.
BATCH_ROWS = 4096


class Folder:
    """The manifests of a table."""

    def __init__(self, uri: str):
        self.uri = uri

    def store(self) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.uri)
        return store, base.rstrip("/")

    def latest(self) -> int:
        """The last version; 0 without one."""
        store, base = self.store()
        found = store.get_file_info(fs.FileSelector(f"{base}/versions", allow_not_found=True))
        return max((int(f.base_name.removesuffix(".json")) for f in found if f.base_name[:1].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "files": [], "added": []}
        store, base = self.store()
        with store.open_input_stream(f"{base}/versions/{version:08d}.json") as f:
            return json.loads(f.read())

    def put(self, manifest: dict) -> None:
        store, base = self.store()
        store.create_dir(f"{base}/versions", recursive=True)
        at = f"{base}/versions/{manifest['version']:08d}.json"
        if store.get_file_info(at).type != fs.FileType.NotFound:
            raise RuntimeError(f"version {manifest['version']} is there already: another job has written the table")
        part = f"{base}/versions/part-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(json.dumps(manifest).encode())
        store.move(part, at)

    def tidy(self, job: str, keep: set[str]) -> None:
        store, base = self.store()
        for f in store.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)):
            if f.base_name.startswith(f"{job}-") and f.base_name not in keep:
                store.delete_file(f.path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


@dataclass
class File(InputPartition):
    name: str


class Snapshots(DataSource):
    """format("snapshots")."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> StructType:
        found = Folder(self.options["path"]).manifest(_version(self.options))["schema"]
        if found is None:
            raise ValueError(f"no version in {self.options['path']}")
        return StructType.fromJson(found)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def _version(options) -> int | None:
    return int(options["version"]) if "version" in options else None


class _Files:
    """Reads a file in batches of bounded rows."""

    def __init__(self, options, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.folder, self.arrow, self.version = Folder(options["path"]), to_arrow_schema(schema), _version(options)

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        store, base = self.folder.store()
        with store.open_input_file(f"{base}/data/{partition.name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([batch.column(x.name).cast(x.type) for x in self.arrow], schema=self.arrow)


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(x) for x in self.folder.manifest(self.version)["files"]]


class _StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": self.folder.latest()}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(x) for v in range(start["version"] + 1, end["version"] + 1) for x in self.folder.manifest(v)["added"]]

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offset; files stay for other readers."""


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, schema: StructType, overwrite: bool):
        self.folder, self.kind, self.overwrite = Folder(uri), schema.jsonValue(), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        at, rows, out = TaskContext.get(), 0, None
        name = f"{self.job}-{at.partitionId():06d}-{at.taskAttemptId()}.parquet"
        store, base = self.folder.store()
        try:
            for batch in iterator:
                if out is None:
                    store.create_dir(f"{base}/data", recursive=True)
                    out = pq.ParquetWriter(f"{base}/data/{name}", batch.schema, filesystem=store)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        old = self.folder.manifest()
        added = [m.file for m in messages if m is not None and m.file]
        self.folder.tidy(self.job, set(added))
        self.folder.put({"version": old["version"] + 1, "schema": self.kind, "files": added if self.overwrite else old["files"] + added, "added": added, "rows": sum(m.rows for m in messages if m is not None)})

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.tidy(self.job, set())
