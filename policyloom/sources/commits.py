"""A versioned folder of tables: every version adds rows to them, and one atomic rename makes a version count.

    <root>/v=<n>/<table>/   Parquet rows that version n adds
    <root>/v=<n>/manifest   row counts and content hashes of all its tables, written after them
    <root>/commits/<n>      the same, renamed into place: the version counts from then on

A torn write is found by its version folder without a commit: with a manifest all its tables are there and, if their contents agree with it, the
version is rolled forward; otherwise it is rolled back. Content hashes do not depend on the order of rows or on files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content(df: DataFrame) -> dict[str, object]:
    """Row count and hash of a frame's rows, whatever their order."""
    # Binary, array and struct columns are hashed as they are; a null differs from an empty value by its column's mark.
    marks = [F.col(f"`{c}`").isNull() for c in df.columns]
    one = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], *marks)
    other = F.xxhash64(F.lit(7), *marks, *[F.col(f"`{c}`") for c in reversed(df.columns)])
    row = df.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.sum(other.cast("decimal(38,0)"))).first()
    return {"rows": row[0], "hash": f"{row[1] or 0}:{row[2] or 0}"}


class CommitLog:
    """Versions of the tables below a root. schemas: every table's columns. after: called with the name of each write once it is done (tests stop there)."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], after: Callable[[str], None] = lambda name: None):
        self.spark, self.root, self.after = spark, root.rstrip("/"), after
        self.schemas = {name: T.StructType.fromDDL(ddl) for name, ddl in schemas.items()}
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def latest(self) -> int:
        """The last version that counts; 0 if there is none."""
        return max((int(n) for n in self._names("commits") if n.isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        return self._read(f"commits/{version}")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table's rows as of a version, the last by default. Folders without a commit are not read."""
        last = self.latest() if version is None else version
        if not last:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.root}/v={n}/{name}" for n in range(1, last + 1)])

    def commit(self, tables: dict[str, DataFrame], note: dict[str, object]) -> int:
        """Adds rows to tables and makes them count; another writer's version of the same number is an error."""
        version = self.latest() + 1

        def add(name: str) -> dict[str, object]:
            rows = tables.get(name)
            rows = self.spark.createDataFrame([], self.schemas[name]) if rows is None else rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schemas[name]])
            rows.write.parquet(f"{self.root}/v={version}/{name}")
            self.after(name)
            return content(self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/v={version}/{name}"))

        # Tables are written side by side; the manifest waits for all of them.
        with ThreadPoolExecutor(len(self.schemas)) as pool:
            found = dict(zip(self.schemas, pool.map(add, self.schemas), strict=True))
        self._write(f"v={version}/manifest", json.dumps({"version": version, "note": note, "tables": found}, sort_keys=True))
        self.after("manifest")
        self._point(version)
        return version

    def _point(self, version: int) -> None:
        staged = f"commits/.{version}-{uuid.uuid4().hex}"
        self._write(staged, json.dumps(self._read(f"v={version}/manifest"), sort_keys=True))
        self.after("staged")
        if self._fs.exists(self._path(f"commits/{version}")) or not self._fs.rename(self._path(staged), self._path(f"commits/{version}")):
            raise RuntimeError(f"version {version} was committed by another writer")
        self.after("commit")

    def _broken(self, manifest: dict) -> list[str]:
        """Tables of a version that differ from its manifest."""
        out = []
        for name, said in manifest["tables"].items():
            path = f"v={manifest['version']}/{name}"
            if not self._fs.exists(self._path(path)) or content(self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{path}")) != said:
                out.append(name)
        return out

    def recover(self) -> list[tuple[int, str]]:
        """Rolls versions without a commit forward or back; what was done with each."""
        last, done = self.latest(), []
        torn = sorted(int(n[2:]) for n in self._names("") if n.startswith("v=") and int(n[2:]) > last)
        for version in torn:
            whole = version == self.latest() + 1 and "manifest" in self._names(f"v={version}")
            if whole:
                try:
                    whole = not self._broken(self._read(f"v={version}/manifest"))
                except ValueError:  # the manifest itself was cut off
                    whole = False
            if whole:
                self._point(version)
            else:
                self._fs.delete(self._path(f"v={version}"), True)
            done.append((version, "forward" if whole else "back"))
        for name in self._names("commits"):
            if name.startswith("."):
                self._fs.delete(self._path(f"commits/{name}"), False)
        return done

    def verify(self) -> list[tuple[int, str]]:
        """Committed versions and tables whose contents are not those of their commit."""
        return [(n, name) for n in range(1, self.latest() + 1) for name in self._broken(self.manifest(n))]
