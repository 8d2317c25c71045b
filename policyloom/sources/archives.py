"""ZIP archives as a Spark data source: one partition a member, checked against byte caps before anything is unpacked.

    register(spark)
    spark.read.format("zip_members").option("path", "/archives").load()                       # archive, member, n_bytes, code, content
    spark.read.format("zip_members").option("path", "/archives").option("rows", "csv").load()    # archive, member, n_bytes, code, row, fields (a map by the header)

Planning reads the archives' directories only. A member is broken, with a code and without content, if its name leaves the archive (unsafe_name), it is encrypted
(encrypted), is larger than member_bytes (too_large), unpacks to other bytes than its directory says (damaged), is no text (not_text) or has no
header (no_header); an archive that is none has one row (not_an_archive). All members together beyond total_bytes are an error at planning. Members are
unpacked by the task that reads them, CSV streams row by row.
"""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import ship

MEMBER_BYTES, TOTAL_BYTES = 50 << 20, 2 << 30


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else f"file://{path.removeprefix('file:')}")


def code_of(info: zipfile.ZipInfo, most: int) -> str | None:
    """Why a member is not read, from its entry in the archive's directory alone."""
    name = info.filename.replace("\\", "/")
    if name.startswith("/") or ".." in name.split("/"):
        return "unsafe_name"
    if info.flag_bits & 1:
        return "encrypted"
    return "too_large" if info.file_size > most else None


@dataclass
class Member(InputPartition):
    """A member to read, or to report."""

    archive: str
    member: str | None
    size: int
    code: str | None


class ZipReader(DataSourceReader):
    """Plans members and reads each in a task of its own."""

    def __init__(self, options: dict[str, str]):
        self.path, self.csv = options["path"], options.get("rows") == "csv"
        self.most, self.total = int(options.get("member_bytes", MEMBER_BYTES)), int(options.get("total_bytes", TOTAL_BYTES))

    def partitions(self) -> list[Member]:
        from pyarrow import fs

        store, base = _store(self.path)
        found = store.get_file_info(base)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        out, total = [], 0
        for file in sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".zip")), key=lambda f: f.path):
            try:
                with store.open_input_file(file.path) as data, zipfile.ZipFile(data) as archive:
                    members = [Member(file.path, i.filename, i.file_size, code_of(i, self.most)) for i in archive.infolist() if not i.is_dir()]
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # Arrow refuses to seek before the start of a short file
                members = [Member(file.path, None, file.size, "not_an_archive")]
            total += sum(m.size for m in members if not m.code)
            if total > self.total:
                raise ValueError(f"members hold more than {self.total} bytes")
            out += members
        return out

    def read(self, part: Member) -> Iterator[tuple]:
        name = part.archive.rsplit("/", 1)[-1]
        head = (name, part.member, part.size)
        if part.code:
            yield (*head, part.code, None, None) if self.csv else (*head, part.code, None)
            return
        store, _ = _store(self.path)
        try:
            with store.open_input_file(part.archive) as data, zipfile.ZipFile(data) as archive:
                with archive.open(part.member) as member:
                    if not self.csv:
                        # One byte more than the directory says would show that it lies.
                        content = member.read(part.size + 1)
                        damaged = len(content) != part.size
                        yield (*head, "damaged" if damaged else None, None if damaged else content)
                        return
                    yield from self._rows(head, member)
        except (zipfile.BadZipFile, zlib.error, EOFError):
            yield (*head, "damaged", None, None) if self.csv else (*head, "damaged", None)

    @staticmethod
    def _rows(head: tuple, member) -> Iterator[tuple]:
        rows = csv.DictReader(io.TextIOWrapper(member, encoding="utf-8-sig", newline=""))
        try:
            if not rows.fieldnames:
                yield (*head, "no_header", None, None)
            for number, row in enumerate(rows, start=1):
                yield (*head, None, number, {k: v for k, v in row.items() if k is not None and v is not None})
        except UnicodeDecodeError:
            yield (*head, "not_text", None, None)


class ZipMembers(DataSource):
    """`zip_members`: options path (a file or a folder), rows (csv), member_bytes and total_bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        head = "archive string, member string, n_bytes long, code string, "
        return head + ("row long, fields map<string,string>" if self.options.get("rows") == "csv" else "content binary")

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    ship(spark)
    spark.dataSource.register(ZipMembers)


def comment_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of comment archives for readers.comment_rows(): members youtube*.csv in name order, with their file stem and row number; broken members and missing columns are errors."""
    register(spark)
    rows = spark.read.format("zip_members").option("path", path).option("rows", "csv").load()
    file = F.element_at(F.split("member", "/"), -1)
    wanted = rows.where(F.lower(file).like("youtube%.csv"))
    short = F.exists(F.array(*[F.lit(c) for c in ("COMMENT_ID", "CONTENT", "CLASS")]), lambda c: ~F.array_contains(F.map_keys("fields"), c))
    broken = wanted.where(F.col("code").isNotNull() | (F.col("row") == 1) & short).select("member", "code").first()
    if broken:
        raise ValueError(f"{broken.member}: {broken.code or 'columns are missing'}")
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    return wanted.select(stem.alias("stem"), "row", *[F.col("fields")[c].alias(c) for c in ("COMMENT_ID", "CONTENT", "CLASS")])
