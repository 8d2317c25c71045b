"""A Merkle manifest of a data set: trees of rows by source, a tree of sources over them, and a proof of every row.

Every level is a table of nodes. Nodes of a group have row_number indices; an index divided by the fanout names the run, a run's children are
sorted and hashed into the parent. Going down again, each run is joined with its parent's path, to which it appends its own siblings, so that
what 16 leaves share is formed and moved once; leaves get their paths in the last join, where they are folded at once and not moved any more.

Indices come from sorted ranges: rows are dealt by range and written, ranges are counted, and a row's number is its number in the range plus
the rows of the ranges before. So a source that holds a third of all rows, or one id on all rows, is numbered by many tasks.

Defined cases: H of null is `-`, of other values their byte count, `:` and value; a null source is a source of its own, and the first; null
ids come first; rows that share an id are ordered by leaf, equal rows are leaves of their own; a table without rows has no leaves and no root.
A source with one row has its leaf as subroot, one source alone has its subroot as root, and a proof without siblings is the hash of no bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import parallelism, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<l: string, r: string>>"


def field(value: Column) -> Column:
    """A leaf's part of one value: `-`, or UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with their place in their group (idx, from 0, by `order`) and their group's size (n); no task gets a whole group."""
    n = parallelism(nodes.sparkSession)
    ranged = stored(nodes.repartitionByRange(n, "grp", *order).withColumn("__part", F.spark_partition_id()), "merkle-ranges")
    held = ranged.groupBy("grp", "__part").agg(F.count(F.lit(1)).alias("__held"))
    by = Window.partitionBy("grp")
    before = F.coalesce(F.sum("__held").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(held.select("grp", "__part", before.alias("__before"), F.sum("__held").over(by).alias("n")), "merkle-offsets")
    inner = F.row_number().over(Window.partitionBy("__part", "grp").orderBy(*order))
    return ranged.withColumn("__inner", inner).join(offsets, ["grp", "__part"]).withColumn("idx", F.col("__before") + F.col("__inner") - 1).drop("__before", "__inner", "__part")


def _runs(nodes: DataFrame, fanout: int, extra: list[str]) -> DataFrame:
    """Runs of consecutive nodes: (grp, idx of the parent, its node and group size, kids in order)."""
    parent = F.floor(F.col("idx") / fanout).cast("long")
    kids = F.array_sort(F.collect_list(F.struct("idx", "node", *extra))).alias("kids")
    runs = nodes.groupBy("grp", parent.alias("idx")).agg(F.max("n").alias("__n"), kids)
    return runs.select("grp", "idx", F.ceil(F.col("__n") / fanout).cast("long").alias("n"), F.sha2(F.array_join("kids.node", ""), 256).alias("node"), "kids")


class Tree:
    """Levels of a forest of groups (grp, idx, n, node): nodes of level k, and the runs that make level k + 1 of them."""

    def __init__(self, leaves: DataFrame, fanout: int, extra: list[str] | None = None):
        most = leaves.agg(F.max("n")).first()[0] or 0
        self.nodes, self.runs = [leaves], []
        while most > 1:
            self.runs.append(stored(_runs(self.nodes[-1].where("n > 1"), fanout, (extra or []) if len(self.runs) == 0 else []), "merkle-level"))
            self.nodes.append(self.runs[-1].select("grp", "idx", "n", "node"))
            most = -(-most // fanout)

    def roots(self) -> DataFrame:
        """(grp, node) of every group."""
        found = [level.where("n = 1").select("grp", "node") for level in self.nodes]
        out = found[0]
        for level in found[1:]:
            out = out.unionByName(level)
        return out

    def paths(self, tops: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """tops: (grp, path above the group's root, further columns). Leaves with their paths, from the leaf upwards: of runs, as kids to explode
        (kids, above, further columns), None if no group has several leaves; and of leaves that are roots, as (grp, above, further columns)."""
        more = [c for c in tops.columns if c not in ("grp", "path")]
        down = None
        for level in range(len(self.runs) - 1, -1, -1):
            # The parents of this level's runs: roots get what stands above their group, the others what was formed on the level above.
            above = self.nodes[level + 1].where("n = 1").select("grp", "idx").join(tops, "grp").select("grp", "idx", F.col("path").alias("above"), *more)
            if down is not None:
                above = above.unionByName(stored(down, "merkle-paths"))
            met = self.runs[level].select("grp", "idx", "kids").join(above, ["grp", "idx"])
            if level == 0:
                return met, tops.withColumnRenamed("path", "above")
            down = met.select("grp", "above", "kids", *more, F.posexplode("kids").alias("__at", "__kid"))
            down = down.select("grp", F.col("__kid.idx").alias("idx"), _path("__at").alias("above"), *more)
        return None, tops.withColumnRenamed("path", "above")


def _path(at: str) -> Column:
    """The path of the kid at place `at` of its run: what stands left and right of it there, then the path above."""
    nodes, size = F.col("kids.node"), F.size("kids")
    left, right = F.array_join(F.slice(nodes, 1, F.col(at)), ""), F.array_join(F.slice(nodes, F.col(at) + 2, size), "")
    return F.concat(F.array(F.struct(left.alias("l"), right.alias("r"))), F.col("above")).cast(_PATH)


def _folded(path: Column, leaf: Column) -> Column:
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p.l, acc, p.r), 256))


def manifest(leaves: DataFrame, fanout: int = 16) -> DataFrame:
    """Leaves (grp string, doc_id, leaf, probe) with subroot, root, proof_sha256 and folded_root, the root that `probe` leads to with the leaf's siblings.

    grp: `-` for a null source, else `:` and the source, so that groups are in the sources' order.
    """
    rows = numbered(leaves, ["doc_id", "leaf", "probe"]).withColumnRenamed("leaf", "node")
    lower = Tree(stored(rows, "merkle-leaves"), fanout, ["doc_id", "probe"])
    sources = lower.roots().select(F.lit("").alias("grp"), F.col("grp").alias("source"), "node")
    upper = Tree(stored(numbered(sources, ["source"]), "merkle-sources"), fanout, ["source"])
    root = upper.roots().select("grp", F.col("node").alias("root"))
    runs, alone = upper.paths(root.withColumn("path", F.array().cast(_PATH)))
    one = upper.nodes[0].where("n = 1").join(alone, "grp").select(F.col("source").alias("grp"), "node", F.col("above").alias("path"), "root")
    if runs is not None:
        kid = runs.select("kids", "above", "root", F.posexplode("kids").alias("at", "kid"))
        one = one.unionByName(kid.select(F.col("kid.source").alias("grp"), F.col("kid.node").alias("node"), _path("at").alias("path"), "root"))
    tops = stored(one.withColumnRenamed("node", "subroot"), "merkle-tops")
    runs, alone = lower.paths(tops)
    made = lower.nodes[0].where("n = 1").join(alone, "grp").select("grp", "doc_id", F.col("node").alias("leaf"), "probe", F.col("above").alias("path"), "subroot", "root")
    if runs is not None:
        kid = runs.select("grp", "kids", "above", "subroot", "root", F.posexplode("kids").alias("at", "kid"))
        made = made.unionByName(kid.select("grp", "kid.doc_id", F.col("kid.node").alias("leaf"), "kid.probe", _path("at").alias("path"), "subroot", "root"))
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p.l, p.r)), "")
    return made.select("grp", "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), _folded(F.col("path"), F.col("probe")).alias("folded_root"))


def tampered(text: Column, doc_id: Column) -> Column:
    """The probe's text: A-Z in lower case where 5 divides the id's CRC, else as it is."""
    return F.when(F.crc32(doc_id.cast("string")) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents (doc_id, source, lang, n_chars, text; further columns are no part of it). Texts are read once and do not travel."""
    fixed = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, probe = digest(*fixed, field(F.col("text"))), digest(*fixed, field(tampered(F.col("text"), F.col("doc_id"))))
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    grp = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("-"))
    leaves = docs.select(grp.alias("grp"), "doc_id", leaf.alias("leaf"), F.when(changed, probe).alias("__probe"))
    leaves = stored(leaves.select("grp", "doc_id", "leaf", F.coalesce("__probe", "leaf").alias("probe")), "merkle-rows")
    made = manifest(leaves)
    return made.select("doc_id", F.when(F.col("grp") != "-", F.substring("grp", 2, 2**31 - 1)).alias("source"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
