"""The state of runs: bucketed snapshots with a manifest each.

A snapshot is a folder ``v=<version>`` of Parquet files, dealt by id over BUCKETS files and sorted, so that a join on id reads it as it lies.
Its manifest, written last under another name and then renamed, lists the files and their sizes. What has no manifest was never
finished and isn't seen; whether a snapshot is whole is told by a listing, not by reading it.
"""

from __future__ import annotations

import hashlib
import json
import warnings

from pyspark.sql import DataFrame, SparkSession

#: Files of a snapshot, and whole snapshots that stay.
BUCKETS, KEPT = 32, 5
MANIFEST = "_MANIFEST.json"


class _Store:
    """The file system of a path, any that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, place: str):
        return self.jvm.org.apache.hadoop.fs.Path(place)

    def versions(self) -> list[str]:
        """Folders of snapshots, the newest first."""
        found = self.fs.globStatus(self.path(f"{self.root}/v=*")) or []
        return sorted((str(f.getPath().toString()) for f in found), reverse=True)

    def sizes(self, folder: str) -> dict[str, int]:
        return {f.getPath().getName(): f.getLen() for f in self.fs.listStatus(self.path(folder)) if f.getPath().getName().endswith(".parquet")}

    def manifest(self, folder: str) -> dict | None:
        place = self.path(f"{folder}/{MANIFEST}")
        if not self.fs.exists(place):
            return None
        stream = self.fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, folder: str, manifest: dict) -> None:
        draft = self.path(f"{folder}/{MANIFEST}.draft")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        self.fs.rename(draft, self.path(f"{folder}/{MANIFEST}"))

    def drop(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


def _name(path: str) -> str:
    return "graincast_state_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def whole(store: _Store, folder: str) -> dict | None:
    """The manifest of a snapshot whose files are all there in their sizes; None if it never was finished. Tells of broken ones."""
    told = store.manifest(folder)
    if told is None:
        return None
    there = store.sizes(folder)
    wrong = sorted(n for n, size in told["files"].items() if there.get(n) != size)
    if wrong:
        warnings.warn(f"state {folder} can't be read, the one before is used: {wrong[0]} isn't as it was written", stacklevel=3)
        return None
    return told


def load(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest whole snapshot, as a bucketed table; empty if there is none."""
    store = _Store(spark, root)
    for folder in store.versions():
        told = whole(store, folder)
        if told is not None:
            name, place = _name(folder), folder.replace("'", "''")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {told['buckets']} BUCKETS LOCATION '{place}'")
            return spark.table(name)
    return spark.createDataFrame([], schema)


def save(df: DataFrame, root: str, version: str, buckets: int = BUCKETS, kept: int = KEPT) -> str:
    """A new snapshot beside the old ones; versions sort as text. The one being read is never overwritten, whole ones beyond ``kept`` and unfinished ones before it go.

    The rows are written before the manifest, so a run that dies between leaves nothing that is seen.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/v={version}"
    store, name = _Store(spark, root), _name(path) + "_new"
    if store.fs.exists(store.path(path)):
        raise FileExistsError(path)
    df.repartition(buckets, "id").write.format("parquet").bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    files = store.sizes(path)
    store.put(path, {"version": version, "buckets": buckets, "files": files})
    older = [f for f in store.versions() if f.rsplit("v=", 1)[1] < version]
    finished = [f for f in older if store.manifest(f) is not None]
    for folder in finished[max(0, kept - 1) :] + [f for f in older if f not in finished]:
        spark.sql(f"DROP TABLE IF EXISTS {_name(folder)}")
        store.drop(folder)
    return path


def beside(state_path: str) -> str:
    """Where the health of sources is kept: next to the state."""
    return f"{state_path.rstrip('/')}-health"
