"""Versioned Parquet state with an event log and feedback; a pointer file makes a version current."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from siftline.schema import EVENT, FEEDBACK, STATE


class Store:
    """State and events of a run are written under one version folder and appear together with its pointer file.

    Readers of an older version go on undisturbed; a run that dies before its pointer is there leaves no trace
    in what readers see. All paths go through Hadoop's file systems.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, start: str) -> list[int]:
        """The numbers of the files or folders of the base whose names are start and a number, ascending."""
        found = self._fs.globStatus(self._path(f"{self.base}/{start}*")) or []
        tails = [f.getPath().getName()[len(start) :] for f in found]
        return sorted(int(t) for t in tails if t.isdigit())

    def versions(self) -> list[int]:
        """Committed versions, oldest first: those that the pointer with the highest number lists."""
        pointers = self._names("CURRENT.")
        if not pointers:
            return []
        stream = self._fs.open(self._path(f"{self.base}/CURRENT.{pointers[-1]}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [int(x) for x in text.split()]

    def _table(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        return self._table([f"{self.base}/v{v}/state" for v in self.versions()[-1:]], STATE)

    def events(self) -> DataFrame:
        return self._table([f"{self.base}/v{v}/events" for v in self.versions()], EVENT)

    def feedback(self) -> DataFrame:
        path = f"{self.base}/feedback"
        return self._table([path] if self._fs.exists(self._path(path)) else [], FEEDBACK)

    def commit(self, state: DataFrame, events: DataFrame) -> int:
        """Writes a version and makes it current."""
        have = self.versions()
        new = max([0, *have, *self._names("v")]) + 1  # a folder that a dead run left is never written again
        state.select(*STATE.names).write.parquet(f"{self.base}/v{new}/state")
        events.select(*EVENT.names).write.parquet(f"{self.base}/v{new}/events")
        self._point([*have, new])
        return new

    def _point(self, versions: list[int]) -> None:
        """Adds a pointer file, whole at once; the ones before stay, so there is a current version at any moment."""
        fresh, pointer = (self._path(f"{self.base}/{name}{versions[-1]}") for name in ("_new.", "CURRENT."))
        stream = self._fs.create(fresh, True)
        stream.write(bytearray("\n".join(map(str, versions)).encode()))
        stream.close()
        if self._fs.exists(pointer) or not self._fs.rename(fresh, pointer):
            raise OSError(f"cannot make version {versions[-1]} current")

    def add_feedback(self, uid: str, label: str, note: str, at: datetime) -> None:
        """Appends a label; nothing checks that the id exists."""
        self.add_labels(self.spark.createDataFrame([(uid, label, note, at)], FEEDBACK).coalesce(1))

    def add_labels(self, rows: DataFrame) -> None:
        """Appends a table of labels."""
        rows.select(*FEEDBACK.names).write.mode("append").parquet(f"{self.base}/feedback")
