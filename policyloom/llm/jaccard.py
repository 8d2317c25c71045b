"""Exact Jaccard join of word-shingle sets, with components of linked documents.

Prefix filtering over a global order (frequent shingles last, else by hash): linked sets share a shingle among
the first n - ceil(t * n) + 1. Inverted index lists of prefixes are then searched with two relations between sets:

* Position blocks. A list is sorted by set size and position and cut in blocks, each with its range of sizes and its largest
  rest behind the position. A probe skips a block whose bound allows too little overlap; only members of the others are
  tested one by one.
* Derived answers. A list's hubs (the first set of each size band) are compared with the whole sets of the members that no
  block bound excludes, and the common counts are kept. Of two sets x and y with known counts cx and cy against one hub of
  n shingles, at least cx + cy - n and at most min(cx, cy) + min(nx - cx, ny - cy) shingles are common: what that decides is
  not compared, and sets that links already join in one component need no answer. Equal sets are one set throughout.

What hubs leave open in a list is a pair of different components. Short lists yield such pairs; the members of long ones meet
in blocks, where the common counts of all of them are derived together from the shingles that they share. Long lists
that share a member form one cluster for that, which is cut by size band and into blocks.

Links are verified on whole sets or follow from verified counts, so they are exact up to 64-bit shingle hashes. Blocks yield as
many links as join their components, so a group of n near copies makes no n * n rows. Text is scanned five times, never
shuffled. What travels is kept small, as disks hold all of it at once:

* Shingles are counted by 32 bits a shingle, and only prefix shingles that a second set may have are sent as postings.
* A set has a sketch of one to two bits a shingle, whose difference is at most that of the sets. Pairs and blocks meet with
  sketches first; whole sets, 64 times as large, are read (behind a bitmap) and sent only where sketches leave a link possible.

Defined results: words and shingles as in kernels; a null or wordless text has the empty set, n_shingles 0 and
links with nothing. Every row is linked for itself, repeated ids and rows too; a component is named by the smallest
id among its rows, and a row without an id has no component. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, parallelism, ship, stored
from .bitmaps import collect_bitmap, may_hold
from .components import components, spread_join
from .kernels import U64, as_bytes, batch_shingles, mix, slices

_COLUMNS = 4096
_LIST = 4096
_BLOCK = 64
#: So many blocks of whole sets are one block of sketches.
_WIDE = 8
#: Bits of the bitmap for each repeated shingle, and its most pieces of 4 KB.
_BITS, _PIECES = 16, 16384


def required_overlap(nx, ny, percent: int):
    """The least intersection with 100 * inter >= percent * union."""
    return -((-percent * (nx + ny)) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -((-percent * n) // 100) + 1


def _map(docs: DataFrame, id_col: str, text: str, width: int, schema: str, make, flush=None) -> DataFrame:
    """Run make(ids, shingle sets) over batches; it yields column lists. flush() yields what is left at the end."""
    ship(docs.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        state: dict = {}
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            for columns in make(state, ids, batch_shingles(as_bytes(batch.column(1)), width)):
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if flush:
            for columns in flush(state):
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def _key(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mix(np.array([s.sum(), np.bitwise_xor.reduce(s * (s | U64(1)))], U64) + U64(len(s))).sum().view(np.int64)) if len(s) else 0


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set: shingles flip one of a power of two of bits, at least as many as there are shingles.

    Sets with d shingles that the other lacks differ in at most d bits, also after folding.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(sketch: bytes, size: int) -> bytes:
    """The sketch of the same set in fewer bytes, a power of two of at least 8."""
    x = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, size)).tobytes()


def _differ(nx, ny, percent: int):
    """The most shingles that linked sets of nx and ny may have apart."""
    return nx + ny - 2 * required_overlap(nx, ny, percent)


def may_link(nx: int, x: bytes, ny: int, y: bytes, percent: int) -> bool:
    """Whether the sketches of two sets leave a link possible."""
    size = min(len(x), len(y))
    x, y = (int.from_bytes(z if len(z) == size else fold(z, size), "little") for z in (x, y))
    return (x ^ y).bit_count() <= _differ(nx, ny, percent)


def set_signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """id, n (set size), the set's key and sketch."""

    def make(_, ids, sets):
        rows = [(len(s), _key(s), sketch(s) if len(s) else None) for s in sets]
        yield [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())]

    return _map(docs, id_col, text, width, "id long, n long, key long, sketch binary", make)


def _reach(percent: int) -> np.uint64:
    """Shingles are counted below this hash, as far as a prefix in hash order reaches."""
    return U64(int((1.3 * (100 - percent) / 100) * 2**64))


def _stems(s: np.ndarray, bits: int) -> np.ndarray:
    """The first 32 + bits bits of hashes."""
    return (s >> U64(32 - bits)).astype(np.int64)


def repeated_shingles(docs: DataFrame, id_col: str, text: str, width: int, percent: int, bits: int) -> DataFrame:
    """stem, n: how many sets have shingles of a stem, for those of several sets; equal sets of different tasks count each.

    Tasks send stems as arrays, dealt by their first bits; the other 32 bits of each travel. Different shingles of one stem
    are counted together, which makes more candidates and loses none.
    """
    limit = _reach(percent)

    def emit(state):
        if state.get("size"):
            stems, counts = np.unique(_stems(np.concatenate(state["parts"]), bits), return_counts=True)
            part, low = stems >> 32, stems.astype(np.uint32)
            edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            # Counts are sent of the few that a task met several times.
            often = [np.flatnonzero(counts[a:b] > 1).astype(np.uint32) for a, b in spans]
            more = [counts[a:b][x].astype(np.uint32) for (a, b), x in zip(spans, often)]
            yield [pa.array(part[edges[:-1]]), *[pa.array(x, pa.binary()) for x in ([low[a:b].tobytes() for a, b in spans], [x.tobytes() for x in often], [x.tobytes() for x in more])]]
        state.update(size=0, parts=[])

    def make(state, _, sets):
        seen = state.setdefault("seen", set())
        for s in sets:
            if len(s) and (i := _key(s)) not in seen:
                seen.add(i)
                low = s[: np.searchsorted(s, limit)]
                state.setdefault("parts", []).append(low)
                state["size"] = state.get("size", 0) + len(low)
                if state["size"] > 2_000_000:
                    yield from emit(state)

    def count(table):
        parts = [np.frombuffer(b, np.uint32) for b in table.column("low").to_pylist()]
        low, n = np.concatenate(parts), np.ones(sum(map(len, parts)), np.int64)
        at = 0
        for x, often, more in zip(parts, table.column("often").to_pylist(), table.column("more").to_pylist()):
            n[at + np.frombuffer(often, np.uint32)] = np.frombuffer(more, np.uint32)
            at += len(x)
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.empty(0, np.int64)
        total = np.add.reduceat(n, starts) if len(low) else n
        stems = (table.column("part")[0].as_py() << 32) + low[starts].astype(np.int64)
        return pa.table({"stem": stems[total > 1], "n": total[total > 1]})

    sent = _map(docs, id_col, text, width, "part long, low binary, often binary, more binary", make, emit)
    return sent.groupBy("part").applyInArrow(count, "stem long, n long")


def frequent_stems(repeated: DataFrame, at_least: int = 32, most: int = 2_000_000) -> np.ndarray:
    """The most frequent stems, at most `most` of them: their shingles go last in the global order. Any such set gives exact results."""
    top = repeated.where(F.col("n") >= at_least).orderBy(F.desc("n"), "stem").limit(most)
    return np.sort(top.select("stem").toArrow().column(0).to_numpy())


def _postings(docs, id_col, text, width, percent, bits, frequent, repeated) -> DataFrame:
    """token, set key, n, position for those prefix shingles of every set that a second set may have; a task emits a set once.

    repeated: a bitmap of the stems that several sets have; shingles beyond those counted are all sent.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, repeated))
    limit = _reach(percent)

    def make(state, _, sets):
        (last, held), out = shared.value, []
        seen = state.setdefault("seen", set())
        for s in sets:
            if len(s) and (i := _key(s)) not in seen:
                seen.add(i)
                p = prefix_size(len(s), percent)
                head = s
                if len(last):
                    stems = _stems(s, bits)
                    seat = np.minimum(np.searchsorted(last, stems), len(last) - 1)
                    common = last[seat] == stems
                    head = np.concatenate([s[~common], s[common]])
                head = head[:p]
                pos = np.flatnonzero((head >= limit) | may_hold(held, _stems(head, bits)))
                out.append((head[pos], i, len(s), pos))
        if out:
            sizes = [len(x[0]) for x in out]
            repeat = lambda k: pa.array(np.repeat(np.array([x[k] for x in out], np.int64), sizes))
            yield [pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), repeat(1), repeat(2), pa.array(np.concatenate([x[3] for x in out]))]

    return _map(docs, id_col, text, width, "token long, id long, n long, pos long", make)


def _lists(postings: DataFrame, partitions: int) -> DataFrame:
    """Index lists with several sets: one row per token and run of at most _LIST members, sorted by set size."""
    names = ["token", "chunk", "ids", "ns", "pos"]

    def run(batches):
        # Postings come sorted; a list may go on in the next batch.
        rest = None

        def cut(rows, final):
            token = rows[0]
            edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            stop = len(edges) - 1 if final else len(edges) - 2
            out = []
            for k in range(stop):
                a, b = edges[k], edges[k + 1]
                if b - a > 1:
                    for c, at in enumerate(range(a, b, _LIST)):
                        end = min(b, at + _LIST)
                        out.append((int(token[a]), c, *[x[at:end].tobytes() for x in rows[1:]]))
            return out, [x[edges[stop] :] for x in rows]

        def batch_of(rows):
            t, c, *blobs = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(c, pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], names=names)

        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(4)]
            if rest is not None and len(rest[0]):
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            if len(rows[0]):
                found, rest = cut(rows, False)
                if found:
                    yield batch_of(found)
        if rest is not None and len(rest[0]):
            found, _ = cut(rest, True)
            if found:
                yield batch_of(found)

    dealt = postings.repartition(partitions, "token").dropDuplicates(["token", "id"]).sortWithinPartitions("token", "n", "id")
    return dealt.mapInArrow(run, "token long, chunk int, ids binary, ns binary, pos binary")


def _possible(na, pa_, nb, pb, percent):
    """Whether the sizes and positions allow enough overlap."""
    return 1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= required_overlap(na, nb, percent)


def open_blocks(n: int, rest: int, least: np.ndarray, most: np.ndarray, rests: np.ndarray, percent: int) -> np.ndarray:
    """Which blocks (sizes from least to most, at most rests shingles behind the position) a set of n shingles and that rest may link into."""
    # The overlap that a block's smallest possible partner needs.
    nearest = np.maximum(least, -(-percent * n // 100))
    fits = (nearest <= most) & (100 * n >= percent * least)
    return fits & (np.minimum(rest, rests) >= required_overlap(n, nearest, percent))


def _bands(ns: np.ndarray, percent: int) -> np.ndarray:
    """Size bands: sets of bands further apart than one differ too much in size."""
    return np.floor(np.log(ns) / np.log(100 / percent)).astype(np.int64)


def _hub_pairs(ids, ns, pos, percent):
    """Each size band's first set against the members of its own and the next band, block by block."""
    order = np.lexsort((pos, ns))
    ids, ns, pos = ids[order], ns[order], pos[order]
    edges = np.arange(0, len(ids), _BLOCK)
    least, most = ns[edges], ns[np.append(edges[1:], len(ids)) - 1]
    rests = np.maximum.reduceat(ns - pos, edges)
    bands = _bands(ns, percent)
    starts = np.flatnonzero(np.concatenate(([True], bands[1:] != bands[:-1])))
    us, vs = [], []
    for a in starts.tolist():
        # The hub is the least key of its band, so that lists of one group choose the same.
        band = np.flatnonzero(bands == bands[a])
        h = band[np.argmin(ids[band])]
        blocks = np.flatnonzero(open_blocks(int(ns[h]), int(ns[h] - pos[h]), least, most, rests, percent))
        if not len(blocks):
            continue
        members = np.concatenate([np.arange(edges[k], min(edges[k] + _BLOCK, len(ids))) for k in blocks.tolist()])
        near = members[(bands[members] >= bands[a]) & (bands[members] <= bands[a] + 1) & (ids[members] != ids[h])]
        near = near[_possible(ns[near], pos[near], ns[h], pos[h], percent)]
        us.append(np.full(len(near), ids[h]))
        vs.append(ids[near])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64), np.empty(0, np.int64))


def derived(nx, cx, ny, cy, nh, percent):
    """1 if two sets of nx and ny shingles link, -1 if they do not, 0 if it stays open, from their common counts with a set of nh."""
    need = required_overlap(nx, ny, percent)
    return np.where(cx + cy - nh >= need, 1, np.where(np.minimum(cx, cy) + np.minimum(nx - cx, ny - cy) < need, -1, 0))


def link_sets(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of a block link (side 2: with all others, sides 0 and 1: with each other), as pairs of places that join the same components.

    Common counts come from products of presence columns, a few thousand shingles at a time; shingles of one set only
    cannot count and are left out.
    """
    sizes = np.array([len(x) for x in sets])
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(place, minlength=len(tokens)) > 1
    seat = np.cumsum(often) - 1
    keep = often[place]
    column, row = seat[place[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(often.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + _COLUMNS))
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    both = sizes[:, None] + sizes[None, :]
    linked = (100 + percent) * common.astype(np.int64) >= percent * both
    if not (sides == 2).all():
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, False)
    label = np.arange(len(sets))
    x, y = np.nonzero(linked)
    while len(x):
        before = label.copy()
        np.minimum.at(label, x, label[y])
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return moved, label[moved]


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u < v) of hubs and members; repeated ones fall away in each task first.

    A list of two is one pair; those of a batch are tested together.
    """

    def run(batches):
        parts, size = [], 0

        def flush():
            both = np.concatenate(parts, 1)
            both = np.unique(np.stack([both.min(0), both.max(0)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            two = [r for r in rows if len(r[0]) == 16]
            if two:
                ids, ns, pos = (_ints(b"".join(x)).reshape(-1, 2) for x in zip(*two))
                parts.append(ids[_possible(ns[:, 0], pos[:, 0], ns[:, 1], pos[:, 1], percent)].T)
                size += parts[-1].shape[1]
            for r in rows:
                if len(r[0]) > 16:
                    parts.append(np.stack(_hub_pairs(*map(_ints, r), percent)))
                    size += parts[-1].shape[1]
            if size > 1_000_000:
                yield flush()
                parts, size = [], 0
        if size:
            yield flush()

    return lists.select("ids", "ns", "pos").mapInArrow(run, "u long, v long").distinct()


def _open_pairs(runs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of members of different components of a short list, and the answer that follows from their hub's counts: 1 for a link, 0 if it stays open."""

    def run(batches):
        for batch in batches:
            parts = [_few_pairs(row, percent) for row in zip(*(c.to_pylist() for c in batch.columns))]
            if parts:
                u, v, answer = np.concatenate(parts, 1)
                both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v), answer]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["u", "v", "answer"])

    return runs.mapInArrow(run, "u long, v long, answer long").distinct()


def _ints(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def _wanted_sets(ids: DataFrame, docs: DataFrame, id_col: str, text: str, width: int, bitmap_buckets: int) -> DataFrame:
    """(id, tokens) of the sets with these keys, and of a few more: documents are scanned behind a bitmap of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(collect_bitmap(ids, "id", bitmap_buckets))

    def make(state, _, sets):
        seen, out = state.setdefault("seen", set()), []
        for s in sets:
            if len(s) and (i := _key(s)) not in seen and may_hold(shared.value, np.array([i]))[0]:
                seen.add(i)
                out.append((i, s.tobytes()))
        if out:
            yield [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())]

    sets = _map(docs, id_col, text, width, "id long, tokens binary", make)
    return sets.groupBy("id").agg(F.first("tokens").alias("tokens"))


def _near_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that their sketches (id, n, sketch) leave possible."""
    by_v = pairs.join(sketches.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("right")), "v")
    both = by_v.join(sketches.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("left")), "u")

    def run(batches):
        for batch in batches:
            near = [may_link(*row, percent) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return both.select("u", "v", "nu", "left", "nv", "right").mapInArrow(run, "u long, v long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()


def count_common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, common, nu, nv of pairs, from their whole sets. Pairs meet both sets by id, so a heavy hub's pairs are one key of a join, which Spark splits only where it is adaptive."""
    by_v = pairs.join(sets.select(F.col("id").alias("v"), F.col("tokens").alias("right")), "v")
    both = by_v.join(sets.select(F.col("id").alias("u"), F.col("tokens").alias("left")), "u")

    def run(batches):
        for batch in slices(batches, 256):
            out = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(b, U64), np.frombuffer(a, U64)
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                seat = np.searchsorted(many, few)
                seat[seat == len(many)] = 0
                out.append((int((many[seat] == few).sum()), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))]], names=["u", "v", "common", "nu", "nv"])

    return both.select("u", "v", "right", "left").mapInArrow(run, "u long, v long, common long, nu long, nv long")


def _linked(percent: int):
    return F.col("common") * (100 + percent) >= percent * (F.col("nu") + F.col("nv"))


def _few_pairs(columns, percent: int):
    """u, v, answer of the pairs of different components in one short list that sizes, positions and derived answers allow."""
    ids, ns, pos, c, hub, common, hub_size = (np.array(x, np.int64) for x in columns)
    x, y = np.triu_indices(len(ids), 1)
    near = _possible(ns[x], pos[x], ns[y], pos[y], percent) & (c[x] != c[y])
    x, y = x[near], y[near]
    answer = np.where(hub[x] == hub[y], derived(ns[x], common[x], ns[y], common[y], hub_size[x], percent), 0)
    return np.stack([ids[x], ids[y], answer])[:, answer >= 0]


def _units(members: DataFrame, block: int) -> DataFrame:
    """Members (cluster, band, id, c) dealt to wide blocks that must meet: h1, h2, i, j, side, part, id, c; part is the block of whole sets.

    Sets of a cluster meet if they are of one size band or of neighbouring ones; others differ too much in size. A band of a
    cluster is cut in blocks, so that no group is collected whole.
    """
    own = stored(members.select("cluster", "band", "id", "c", F.xxhash64("cluster", "band").alias("hub")).distinct(), "cluster-members")
    hubs = own.select("cluster", "band", "hub").distinct()
    blocks = own.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("blocks", F.ceil(F.col("parts") / _WIDE).cast("int"))
    own = own.select("hub", "id", "c")
    dealt = own.join(blocks, "hub").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("mine", F.floor(F.col("part") / _WIDE).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    same = dealt.where("n > 1").withColumn("other", every("blocks"))
    same = same.select(
        F.col("hub").alias("h1"), F.col("hub").alias("h2"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "part", "id", "c",
    )
    next_band = hubs.select("cluster", (F.col("band") - 1).alias("band"), F.col("hub").alias("h2"))
    sizes = blocks.select("hub", "blocks")
    meet = hubs.withColumnRenamed("hub", "h1").join(next_band, ["cluster", "band"]).select("h1", "h2").distinct()
    meet = meet.join(sizes.withColumnsRenamed({"hub": "h1", "blocks": "b1"}), "h1").join(sizes.withColumnsRenamed({"hub": "h2", "blocks": "b2"}), "h2")
    dealt = dealt.select("hub", "mine", "part", "id", "c")
    left = dealt.withColumnRenamed("hub", "h1").join(meet, "h1").withColumn("j", every("b2")).select("h1", "h2", F.col("mine").alias("i"), "j", F.lit(0).alias("side"), "part", "id", "c")
    right = dealt.withColumnRenamed("hub", "h2").join(meet, "h2").withColumn("i", every("b1")).select("h1", "h2", "i", F.col("mine").alias("j"), F.lit(1).alias("side"), "part", "id", "c")
    return same.unionByName(left).unionByName(right)


def near_places(x: np.ndarray, nx: np.ndarray, cx: np.ndarray, y: np.ndarray, ny: np.ndarray, cy: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets of one block, and of another, that sketches (rows of 64-bit words) let link into the other across components."""
    apart = np.zeros((len(nx), len(ny)), np.int64)
    for k in range(x.shape[1]):
        apart += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    near = (apart <= _differ(nx[:, None], ny[None, :], percent)) & (cx[:, None] != cy[None, :])
    return np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))


def _by_cell(batches, done):
    """Rows of batches, sorted by four columns of a cell, in lists of one cell; yields what done(cell, rows without them) makes."""
    held, at = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:4] != at:
                if len(held) > 1 and (out := done(at, held)) is not None:
                    yield out
                held, at = [], row[:4]
            held.append(row[4:])
    if len(held) > 1 and (out := done(at, held)) is not None:
        yield out


def _cells(units: DataFrame) -> DataFrame:
    return units.repartition(parallelism(units.sparkSession), "h1", "h2", "i", "j").sortWithinPartitions("h1", "h2", "i", "j")


def _near_units(units: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Units (h1, h2, i, j, side, id) of blocks of whole sets: the sets that their sketches let link within the two blocks."""
    names = ["h1", "h2", "i", "j", "side", "id"]

    def done(at, held):
        side, part, ids, c, n = (np.array(x, np.int64) for x in list(zip(*held))[:5])
        size = min(len(r[5]) for r in held)
        words = np.frombuffer(b"".join(fold(r[5], size) for r in held), np.uint64).reshape(len(held), -1)
        groups = {(s, p): np.flatnonzero((side == s) & (part == p)) for s, p in sorted(set(zip(side.tolist(), part.tolist())))}
        out = []
        for (s, p), a in groups.items():
            for (s2, p2), b in groups.items():
                # Within a block every two parts meet, otherwise those of its two sides.
                if (s, s2) == (0, 1) or s == 2 and p <= p2:
                    left, right = near_places(words[a], n[a], c[a], words[b], n[b], c[b], percent)
                    if len(left):
                        own = s == 2 and p == p2
                        out += [(*at[:2], p, p2, 2 if own else 0, i) for i in ids[a[left]].tolist()]
                        out += [] if own else [(*at[:2], p, p2, 1, i) for i in ids[b[right]].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names) if out else None

    sent = _cells(units.join(sketches, "id").select("h1", "h2", "i", "j", "side", "part", "id", "c", "n", "sketch"))
    return sent.mapInArrow(lambda batches: _by_cell(slices(batches), done), ", ".join(f"{x} long" for x in names))


def _block_links(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found in blocks, as many as join each block's components: no pair rows are made."""

    def done(_, held):
        keys = np.array([r[1] for r in held], np.int64)
        x, y = link_sets([np.frombuffer(r[2], U64) for r in held], np.array([r[0] for r in held]), percent)
        return pa.RecordBatch.from_arrays([pa.array(keys[x]), pa.array(keys[y])], names=["u", "v"]) if len(x) else None

    sent = _cells(units.join(sets, "id").select("h1", "h2", "i", "j", "side", "id", "tokens"))
    return sent.mapInArrow(lambda batches: _by_cell(slices(batches), done), "u long, v long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bitmap_buckets: int = 1024, block: int = 512, short_list: int = 32) -> DataFrame:
    """Per row: the id, n_shingles, component_id (smallest id reachable by links, its own included)."""
    spark = docs.sparkSession
    bits = min(32, (16 * parallelism(spark)).bit_length())
    signed = stored(set_signatures(docs, id_col, text, width), "sets")
    sketches = signed.where("n > 0").groupBy(F.col("key").alias("id")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    repeated = stored(repeated_shingles(docs, id_col, text, width, percent, bits), "repeated")
    pieces = min(_PIECES, repeated.count() * _BITS // 32768 + 1)
    postings = _postings(docs, id_col, text, width, percent, bits, frequent_stems(repeated), collect_bitmap(repeated, "stem", pieces))
    lists = stored(_lists(postings, parallelism(spark)), "lists")
    discard(repeated)
    tried = stored(_candidates(lists, percent), "hub-pairs")
    near = stored(_near_pairs(tried, sketches, percent), "near-hub-pairs")
    known = stored(count_common(near, _wanted_sets(_ends(near), docs, id_col, text, width, bitmap_buckets)), "hub-counts")
    links = known.where(_linked(percent)).select("u", "v")
    found = stored(components(links), "hub-components")
    # Lists that still hold several components are searched on, across components.
    # A list of two is settled by its hub; a short piece of a long list is not.
    more_than_two = lists.where("octet_length(ids) > 16 or chunk > 0")
    named = lambda members: members.join(found, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
    tops = named(more_than_two.select("token", "ids").mapInArrow(_unpack, "token long, id long")).groupBy("token")
    open_tokens = tops.agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("size"), F.min("id").alias("hub")).where("a < b").select("token", "size", "hub")
    # Lists meet their token's row packed, and members go by id only, so no task gets a common token's members.
    members = more_than_two.join(open_tokens, "token").select("token", "size", "hub", "ids", "ns", "pos").mapInArrow(_unpack, "token long, size long, hub long, id long, n long, pos long")
    # Each member with its component and the hub that it has most in common with; a hub has all in common with itself.
    best = known.select(F.col("v").alias("id"), "u", "common", "nu").unionByName(known.select(F.col("u").alias("id"), "u", F.col("nu").alias("common"), "nu"))
    best = best.groupBy("id").agg(F.max(F.struct("common", F.col("u").alias("hub"), F.col("nu").alias("hub_size"))).alias("b"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    open_members = stored(named(members).select("token", "size", "hub", band.alias("band"), "id", "n", "pos", "c"), "open-members")
    # Short lists: their pairs across components, at most short_list / 2 for each member.
    short = open_members.where(F.col("size") <= short_list).drop("hub").join(best, "id", "left")
    short = short.select("token", "id", "n", "pos", "c", F.coalesce("b.hub", "id").alias("hub"), F.coalesce("b.common", F.lit(0)).alias("common"), F.coalesce("b.hub_size", F.lit(0)).alias("hub_size"))
    fields = ("id", "n", "pos", "c", "hub", "common", "hub_size")
    runs = stored(short.groupBy("token").agg(F.collect_list(F.struct(*fields)).alias("m")).select(*[F.col(f"m.{f}").alias(f) for f in fields]), "short-lists")
    asked = stored(_open_pairs(runs, percent).join(tried, ["u", "v"], "left_anti"), "few-pairs")
    few = stored(_near_pairs(asked.where("answer = 0").select("u", "v").distinct(), sketches, percent), "near-few-pairs")
    wanted = _ends(few)
    # Long lists: members that any of them connects form a cluster, whose blocks meet.
    crowd = stored(open_members.where(F.col("size") > short_list).select("hub", "band", "id", "c").distinct(), "crowded")
    discard(lists, tried, runs, open_members)
    units = None
    if not crowd.isEmpty():
        clusters = components(crowd.select(F.col("hub").alias("u"), F.col("id").alias("v"))).withColumnRenamed("component_id", "cluster")
        units = stored(_near_units(_units(crowd.select("band", "id", "c").distinct().join(clusters, "id"), block), sketches, percent), "near-units")
        wanted = wanted.union(units.select("id")).distinct()
    sets = _wanted_sets(wanted, docs, id_col, text, width, bitmap_buckets)
    more = count_common(few, sets).where(_linked(percent)).select("u", "v").unionByName(asked.where("answer = 1").select("u", "v"))
    if units is not None:
        more = more.unionByName(_block_links(units, sets, percent))
    final = components(links.unionByName(more))
    least = signed.where("n > 0").groupBy("key").agg(F.min("id").alias("least"))
    groups = stored(least.join(final.withColumnRenamed("id", "key"), "key", "left").withColumn("c", F.coalesce("component_id", "key")).select("key", "least", "c"), "groups")
    discard(near, known, found, asked, few, crowd, *([units] if units is not None else []))
    by_key = spread_join(groups, groups.groupBy("c").agg(F.min("least").alias("smallest")), "c").select("key", "smallest")
    named_rows = signed.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("smallest")).unionByName(spread_join(signed.where("n > 0"), by_key, "key").select("id", "n", "smallest"))
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("smallest")).otherwise(F.col("id"))
    return named_rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _unpack(batches):
    """A row for each member of packed lists; columns that are no blobs are repeated."""
    names = {"ids": "id", "ns": "n"}
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        if batch.num_rows:
            sizes = [len(x) // 8 for x in columns["ids"].to_pylist()]
            made = [pa.array(np.repeat(x.to_numpy(), sizes) if pa.types.is_integer(x.type) else _ints(b"".join(x.to_pylist()))) for x in columns.values()]
            yield pa.RecordBatch.from_arrays(made, names=[names.get(x, x) for x in columns])
