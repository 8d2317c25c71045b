"""Bin-packed compaction of small Parquet files, planned and carried out by Spark SQL.

A folder holds one file a slot, `gen=<generation>/slot=<day>_<lot>_<piece>/`, and no file that is not in it. The plan collects each day's small files as
sorted structs and folds them with aggregate() into an array of groups, each file joining the first group with room for it. A group of
several becomes one file of the next generation, at its first member's slot; files of other groups are not touched.

A day's files are few by construction: lots follow the day's share of all rows. Rows are never gathered but by the file that they make, and
only sorted there, so a task spills and streams. Counts of days and files are tables that Spark joins, by broadcast only where small.

Order of the work, so that a run can be taken up after a crash: the plan is written, then the new generation (a repeat overwrites it), then
its rows are counted against the plan, and only then do executors remove the files that it replaces (a repeat finds none).

Defined cases: a null time makes a day of its own (null); a null key counts as empty text, in its hash and among the ids; equal rows and
equal (time, key) pairs keep an order by their other columns; a table without rows makes a folder without files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import parallelism, ship, stored

#: Schema of report(): one row a file, from its own rows.
_DIGEST = "slot string, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string"


def share(total: int, parts: int) -> int:
    """S(x): rows of one of about so many parts of the table."""
    return 1 + total // parts


def _free(name: str, taken: list[str]) -> str:
    """name, or the first of name_, name__, ... that no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


class Folder:
    """A folder of files in slots, with the names of the two partition columns that its table does not use itself."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.gen, self.slot = _free("gen", schema.names), _free("slot", schema.names)

    def read(self) -> DataFrame:
        """All rows with generation and slot; _metadata gives a row's file and place."""
        kinds = T.StructType([*self.schema.fields, T.StructField(self.gen, T.IntegerType()), T.StructField(self.slot, T.StringType())])
        return self.spark.read.schema(kinds).parquet(self.path)

    def generation(self, number: int) -> str:
        return f"{self.path}/{self.gen}={number}"

    def files(self) -> DataFrame:
        """(gen, slot, day, lot, piece, n_rows, path) of every file, from the files themselves."""
        rows = self.read().select(F.col(self.gen).alias("gen"), F.col(self.slot).alias("slot"), F.col("_metadata.file_path").alias("path"))
        parts = F.split("slot", "_")
        counted = rows.groupBy("gen", "slot", "path").agg(F.count(F.lit(1)).alias("n_rows"))
        return counted.select("gen", "slot", F.expr("try_cast(split(slot, '_')[0] AS long)").alias("day"), parts[1].cast("long").alias("lot"), parts[2].cast("long").alias("piece"), "n_rows", "path")


def _slots(rows: DataFrame, at: str, key: str, parts: int) -> tuple[DataFrame, int]:
    """rows with their slot as __slot, and how many rows there are. Counts by day are written, so Spark broadcasts them only if small."""
    day, h = F.coalesce(F.unix_date(F.col(f"`{at}`").cast("date")).cast("string"), F.lit("none")), F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    days = stored(rows.groupBy(day.alias("__day")).agg(F.count(F.lit(1)).alias("__r")), "compaction-days")
    total = days.agg(F.sum("__r")).first()[0] or 0
    lots = F.lit(1) + F.expr(f"__r div {share(total, parts)}L")
    placed = rows.withColumns({"__day": day, "__h": h}).join(days, "__day")
    slot = F.concat_ws("_", "__day", (F.shiftright("__h", 4) % lots).cast("string"), F.least(F.col("__h") % 4, F.shiftright("__h", 2) % 4).cast("string"))
    return placed.withColumn("__slot", slot).drop("__day", "__h", "__r"), total


def write_slots(rows: DataFrame, path: str, at: str = "arrived_at", key: str = "click_id", parts: int = 150) -> tuple[Folder, int]:
    """Starting files, generation 0: one for each slot that occurs, its rows by time, then key, with all columns in table order.

    Slots go to a fixed number of tasks: opening a file takes longer than writing a short one, so tasks are not merged by their bytes.

    Returns the folder and the table's row count.
    """
    made = Folder(rows.sparkSession, path, rows.schema)
    placed, total = _slots(rows, at, key, parts)
    rest = [f"`{f.name}`" for f in rows.schema.fields if f.name not in (at, key) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    ordered = placed.withColumnRenamed("__slot", made.slot).repartition(parallelism(made.spark), made.slot).sortWithinPartitions(made.slot, f"`{at}`", f"`{key}`", *rest)
    ordered.write.option("maxRecordsPerFile", 0).partitionBy(made.slot).parquet(made.generation(0))
    return made, total


def _first_fit(files: Column, cap: int) -> Column:
    """Groups of a sorted array of file structs: each file joins the earliest-opened group that it does not fill over cap, else opens one."""
    kind = "array<struct<n_rows: bigint, members: array<struct<order: bigint, lot: bigint, piece: bigint, n_rows: bigint, slot: string>>>>"

    def place(groups: Column, file: Column) -> Column:
        fits = F.transform(groups, lambda g: g.n_rows + file.n_rows <= F.lit(cap))
        into = F.array_position(fits, True)  # the first, or 0
        grown = F.transform(groups, lambda g, k: F.when(k + 1 == into, F.struct((g.n_rows + file.n_rows).alias("n_rows"), F.concat(g.members, F.array(file)).alias("members"))).otherwise(g))
        opened = F.array(F.struct(file.n_rows.alias("n_rows"), F.array(file).alias("members")))
        return F.when(into > 0, grown).otherwise(F.concat(groups, opened)).cast(kind)

    return F.aggregate(files, F.array().cast(kind), place)


def plan(files: DataFrame, small: int, cap: int) -> DataFrame:
    """One row a file: slot, day, lot, piece, n_rows, the slot of its group's first member (target), its place there (position), the group's size and sources.

    Files under `small` rows are grouped by day, the longest first, then by lot and piece; a group holds at most `cap` rows unless one file alone does.
    """
    struct = F.struct((-F.col("n_rows")).alias("order"), "lot", "piece", "n_rows", "slot")
    days = files.where(F.col("n_rows") < small).groupBy("day").agg(F.array_sort(F.collect_list(struct)).alias("files"))
    groups = days.select("day", F.explode(_first_fit(F.col("files"), cap)).alias("g"))
    named = lambda f: F.concat_ws("-", f.lot, f.piece)
    packed = groups.select(
        "day", F.col("g.members")[0]["slot"].alias("target"), F.size("g.members").alias("n_files"), F.array_join(F.transform("g.members", named), ",").alias("sources"),
        F.posexplode("g.members").alias("position", "f"),
    )
    single = files.where(F.col("n_rows") >= small).select("day", F.col("slot").alias("target"), F.lit(1).alias("n_files"), named(F.struct("lot", "piece")).alias("sources"), F.lit(0).alias("position"), "lot", "piece", "n_rows", "slot")
    return packed.select("day", "target", "n_files", "sources", "position", "f.lot", "f.piece", "f.n_rows", "f.slot").unionByName(single)


def _remover(folder: str):
    """Removes whole slots of a generation, in executors, by Arrow's file systems; a slot that is gone already is no error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if store.get_file_info(f"{base}/{path}").type == fs.FileType.Directory:
                    store.delete_dir(f"{base}/{path}")
            yield pa.RecordBatch.from_pydict({"path": batch.column(0)})

    return run


def compact(folder: Folder, small: int, cap: int) -> DataFrame:
    """Carries a plan out on the folder's generation 0 and returns the plan, as written. Each merged file holds its members' rows in joining order, then file order."""
    spark = folder.spark
    made = stored(plan(folder.files().where("gen = 0"), small, cap), "compaction-plan")
    merged = made.where("n_files > 1").select(F.col("slot").alias("__slot"), F.col("target").alias("__target"), F.col("position").alias("__position"))
    rows = folder.read().where(F.col(folder.gen) == 0).withColumn("__row", F.col("_metadata.row_index")).join(merged, F.col(folder.slot) == F.col("__slot"))
    ordered = rows.withColumn(folder.slot, F.col("__target")).repartition(parallelism(spark), folder.slot).sortWithinPartitions(folder.slot, "__position", "__row")
    ordered.select(*[f"`{c}`" for c in folder.schema.names], folder.slot).write.option("maxRecordsPerFile", 0).mode("overwrite").partitionBy(folder.slot).parquet(folder.generation(1))
    expected = made.where("n_files > 1").groupBy(F.col("target").alias("slot")).agg(F.sum("n_rows").alias("planned"))
    wrong = expected.join(folder.files().where("gen = 1").groupBy("slot").agg(F.sum("n_rows").alias("written"), F.count(F.lit(1)).alias("n")), "slot", "full").where("planned IS DISTINCT FROM written OR n <> 1")
    if wrong.count():
        raise RuntimeError(f"{folder.generation(1)} differs from its plan; nothing was removed")
    ship(spark)
    root = F.concat(F.lit(f"{folder.gen}=0/{folder.slot}="), "slot")
    uri = folder.path if "://" in folder.path else "file://" + folder.path.removeprefix("file:")
    made.where("n_files > 1").select(root.alias("path")).mapInArrow(_remover(uri), "path string").count()
    return made


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of a slot: counts and a digest that goes on from batch to batch, so a file is never held whole."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        sha, n, low, high, cents = state
        return pa.RecordBatch.from_pylist([{"slot": now, "n_rows": n, "min_click_id": low, "max_click_id": high, "cents": cents, "ids_sha256": sha.hexdigest()}], schema=kind)

    kind = pa.schema([("slot", pa.string()), ("n_rows", pa.int64()), ("min_click_id", pa.int64()), ("max_click_id", pa.int64()), ("cents", pa.int64()), ("ids_sha256", pa.string())])
    for batch in batches:
        start, slots = 0, batch.column(0).to_pylist()
        for end in range(1, len(slots) + 1):
            if end < len(slots) and slots[end] == slots[start]:
                continue
            if slots[start] != now:
                if now is not None:
                    yield row()
                now, state = slots[start], (hashlib.sha256(), 0, None, None, 0)
            sha, n, low, high, cents = state
            ids = batch.column(1).slice(start, end - start)
            sha.update(((n > 0) * "," + ",".join("" if v is None else str(v) for v in ids.to_pylist())).encode())
            ends = pc.min_max(ids).as_py()
            low, high = (min((v for v in (low, ends["min"]) if v is not None), default=None), max((v for v in (high, ends["max"]) if v is not None), default=None))
            state, start = (sha, n + end - start, low, high, cents + (pc.sum(batch.column(2).slice(start, end - start)).as_py() or 0)), end
    if now is not None:
        yield row()


def report(folder: Folder, made: DataFrame, key: str = "click_id", value: str = "value") -> DataFrame:
    """One row a file that the folder holds now, from its rows; made: the plan that was carried out."""
    ship(folder.spark)
    v = F.col(f"`{value}`")
    cents = F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0).otherwise(F.floor(100 * v + 0.5))
    rows = folder.read().select(F.col(folder.slot).alias("slot"), F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(cents, F.lit(0)).cast("long").alias("cents"), F.col("_metadata.row_index").alias("row"))
    found = rows.repartition(parallelism(folder.spark), "slot").sortWithinPartitions("slot", "row").select("slot", "id", "cents").mapInArrow(_digests, _DIGEST)
    first = made.where("position = 0").select(F.col("target").alias("slot"), "day", "lot", "piece", "sources", (F.col("n_files") > 1).alias("rewritten"))
    files = folder.files().select("slot", "path")
    columns = F.lit(",".join(folder.read().drop(folder.gen, folder.slot).columns))
    joined = found.join(first, "slot").join(files, "slot")
    return joined.select("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", columns.alias("columns"), "path", "rewritten")
