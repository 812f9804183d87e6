"""The catalogue: analyses, raw and cleaned tables and chat messages as Parquet below one folder.

Nothing is overwritten. A table is written as a new version; an analysis names the versions it belongs to,
and is itself a new row in its ``file_id=`` folder, the newest of which counts. So that row is the switch: until it
is there the old tables and the old analysis stand, whenever a writer dies. Superseded versions go after it.

Messages are appended as small files in a bucket for each month. A bucket with many files is merged into one;
every message has an id, so rows that are in a merged and in an old file for a moment count once.
"""

from __future__ import annotations

import json
import math
import uuid
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import ROW_ID

ANALYSES = "file_id string, version string, filename string, payload string, tables map<string,string>, created_at timestamp"
CHAT = "file_id string, bucket string, id string, question string, answer string, created_at timestamp"
SHOWN_CHAT = ("file_id", "question", "answer", "created_at")

#: Files of a bucket from which they are merged.
MOST_FILES = 32


def newest_first(messages: DataFrame, key: str, value: object, by: str, most: int | None = None) -> DataFrame:
    """The messages of one conversation, the last one first."""
    rows = messages.where(F.col(key) == value).orderBy(F.desc(by))
    return rows if most is None else rows.limit(most)


def for_json(value: object) -> object:
    """Plain values: NaN and infinities become null, keys text, times ISO."""
    if isinstance(value, dict):
        return {str(k): for_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [for_json(v) for v in value]
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        value = value.item()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value if value is None or isinstance(value, (str, int, bool)) else str(value)


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _check(self, file_id: str) -> str:
        if not file_id.isalnum():
            raise ValueError("a file id has letters and digits only")
        return file_id

    def _names(self, path: str) -> list[str]:
        """Names in a folder, none if it isn't there."""
        fs, p = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        if fs.exists(p):
            fs.delete(p, True)

    @staticmethod
    def new_version() -> str:
        """Later versions sort after earlier ones."""
        return f"{datetime.now(UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"

    def table(self) -> DataFrame:
        """The newest row of every analysis."""
        path = f"{self.folder}/analyses"
        if not self._names(path):
            return self.spark.createDataFrame([], ANALYSES)
        rows = self.spark.read.schema(ANALYSES).parquet(path)
        cells = F.struct(*[c.split()[0] for c in ANALYSES.split(", ")[1:]])
        return rows.groupBy("file_id").agg(F.max_by(cells, "version").alias("row")).select("file_id", "row.*")

    def store(self, file_id: str, filename: str, payload: dict, tables: dict[str, str] | None = None) -> None:
        """Make an analysis the current one, with these versions of its tables (by default those it has)."""
        before = self._current(file_id)
        tables = tables if tables is not None else (before["tables"] if before else {}) or {}
        version = self.new_version()
        rows = self.spark.createDataFrame([(filename, json.dumps(for_json(payload)), tables, datetime.now(UTC))], "filename string, payload string, tables map<string,string>, created_at timestamp")
        rows.coalesce(1).write.parquet(f"{self.folder}/analyses/file_id={self._check(file_id)}/version={version}")
        self._prune(file_id, version, tables)

    def _prune(self, file_id: str, version: str, tables: dict[str, str]) -> None:
        """Superseded versions: of the analysis and of the tables that it names."""
        for kind, kept in (("analyses", version), *tables.items()):
            path = f"{self.folder}/{kind}/file_id={file_id}"
            for name in self._names(path):
                if name < f"version={kept}":
                    self._remove(f"{path}/{name}")

    def _current(self, file_id: str) -> dict | None:
        row = self.table().where(F.col("file_id") == self._check(file_id)).first()
        return None if row is None else row.asDict()

    def get(self, file_id: str) -> dict | None:
        row = self._current(file_id)
        return None if row is None else {"file_id": file_id, "filename": row["filename"], **json.loads(row["payload"])}

    def file_ids(self) -> list[str]:
        return [r["file_id"] for r in self.table().orderBy(F.desc("created_at"), "file_id").select("file_id").collect()]

    def delete(self, file_id: str) -> bool:
        """Removes an analysis, its tables and its messages; whether there was one."""
        there = self._current(file_id) is not None
        for kind in ("analyses", "cleaned", "raw", "chat"):
            self._remove(f"{self.folder}/{kind}/file_id={self._check(file_id)}")
        return there

    def _path(self, file_id: str, kind: str, version: str) -> str:
        return f"{self.folder}/{kind}/file_id={self._check(file_id)}/version={version}"

    def save_table(self, file_id: str, df: DataFrame, kind: str, version: str) -> DataFrame:
        """Write a version of a table, which ``store`` then makes the current one."""
        path = self._path(file_id, kind, version)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def versions(self, file_id: str) -> dict[str, str]:
        """The current version of each table."""
        row = self._current(file_id)
        if row is None:
            raise KeyError(file_id)
        return dict(row["tables"] or {})

    def load_table(self, file_id: str, kind: str = "cleaned") -> DataFrame:
        version = self.versions(file_id).get(kind)
        if version is None or not self._exists(self._path(file_id, kind, version)):
            raise KeyError(f"{file_id}: {kind}")
        return self.spark.read.parquet(self._path(file_id, kind, version))

    def export_csv(self, file_id: str, path: str) -> None:
        """The cleaned table as one CSV file with a header, in the file's order."""
        df = self.load_table(file_id)
        ordered = df.orderBy(ROW_ID).drop(ROW_ID) if ROW_ID in df.columns else df
        ordered.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)

    def add_message(self, file_id: str, question: str, answer: str) -> None:
        now = datetime.now(UTC)
        row = [(uuid.uuid4().hex, question, answer, now)]
        bucket = f"{self.folder}/chat/file_id={self._check(file_id)}/bucket={now:%Y%m}"
        self.spark.createDataFrame(row, "id string, question string, answer string, created_at timestamp").coalesce(1).write.mode("append").parquet(bucket)
        if len(self._data_files(bucket)) > MOST_FILES:
            self.merge_messages(bucket)

    def _data_files(self, path: str) -> list[str]:
        return [n for n in self._names(path) if n.endswith(".parquet")]

    def merge_messages(self, bucket: str) -> None:
        """One file for those that a bucket holds now. They go when it is there; till then ids tell that rows are the same."""
        old = [f"{bucket}/{n}" for n in self._data_files(bucket)]
        rows = self.spark.read.parquet(*old).dropDuplicates(["id"])
        rows.coalesce(1).sortWithinPartitions("created_at").write.mode("append").parquet(bucket)
        for path in old:
            self._remove(path)

    def messages(self, file_id: str, most: int | None = None) -> DataFrame:
        """Newest first. With ``most`` only as many of the latest buckets are read as hold so many."""
        path = f"{self.folder}/chat/file_id={self._check(file_id)}"
        buckets = [n for n in self._names(path) if n.startswith("bucket=")]
        if not buckets:
            return self.spark.createDataFrame([], CHAT).select(*SHOWN_CHAT)
        read = lambda names: self.spark.read.option("basePath", f"{self.folder}/chat").schema(CHAT).parquet(*[f"{path}/{n}" for n in names]).dropDuplicates(["id"])
        first = len(buckets) - 1
        while most is not None and first and read(buckets[first:]).count() < most:
            first -= 1
        return newest_first(read(buckets if most is None else buckets[first:]), "file_id", file_id, "created_at", most).select(*SHOWN_CHAT)
