"""Removal of long byte strings that a document with a smaller id holds too, by a logarithmic family of suffix arrays.

Every string of `length` bytes has an anchor: the least hash among its runs of `gram` bytes, the leftmost among equals.
Consecutive strings share their anchor, so a document falls into pieces, each the strings of one anchor. Equal strings
have equal anchors, which splits the space of suffixes into independent shards:

1. Anchors alone are counted by documents, with map-side combine. Those of one document only cannot match; the others
   are remembered in a bitmap of fixed size (false positives cost work, never results).
2. A second scan sends the pieces of remembered anchors to their shards, packed. Equal pieces of a task meet there
   first: all but those of the smallest id are covered at once, so a passage that many documents share sends one piece a
   task; of equal pieces of a shard, too, only the first is looked into.
3. A shard takes pieces in batches in id order. A batch gets a suffix array over its strings' starts, in byte order to a
   depth of `length` bytes; neighbours that share all of them match within the batch, and a scan in that order against
   each level finds matches with earlier batches. What is new becomes a level, and levels merge while the newer is at
   least half as large as the older. Levels live as long as their shard's task, which holds one shard at a time.
4. Runs of matching starts go back by document, and documents are cut.

Text is shuffled once, to meet its spans. Strings are compared by all their bytes; only anchors are hashes.

Defined results: a null text is the empty text; documents are compared by id, so rows of one id never cover each
other; a null id comes last and covers no other null. Matches within a document do not count. Columns of other names
pass through; outputs replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import parallelism, ship
from .bitmaps import collect_bitmap, may_hold
from .bpe import _replaced
from .kernels import U64, as_bytes, slices, window_hashes

_LAST = (1 << 63) - 1
_POSITIONS = 20
_RUN = 1 << 18


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values: suffix minima of blocks against prefix minima of the next ones."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, values.max(), values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, length: int, gram: int):
    """Per piece: its anchor, its first start and how many starts it has."""
    if len(data) < length:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    found = []
    reach = (1 << _POSITIONS) - length
    for at in range(0, len(data) - length + 1, reach):
        part = data[at : at + reach + length - 1]
        hashes = window_hashes(part, gram)
        marked = (hashes & ~U64((1 << _POSITIONS) - 1)) | np.arange(len(hashes), dtype=U64)
        place = (_sliding_least(marked, length - gram + 1) & U64((1 << _POSITIONS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        found.append((hashes[place[first]], first + at, np.diff(np.append(first, len(place)))))
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs(texts: list[bytes], length: int, gram: int):
    """Pieces of several texts at once: index of the text, anchor, first start in it, count."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _RUN):
            size += len(texts[end])
            end += 1
        run = texts[at:end]
        data = np.frombuffer(b"".join(run), np.uint8)
        anchor, start, count = pieces(data, length, gram)
        if len(start):
            begins = np.zeros(len(run) + 1, np.int64)
            np.cumsum([len(x) for x in run], out=begins[1:])
            # A piece may reach over the end of a text: it is cut to the strings that lie in one text.
            text = np.searchsorted(begins, start, side="right") - 1
            out = [np.stack([text, start, start + count])]
            anchors = [anchor]
            over = np.flatnonzero(start + count + length - 1 > begins[text + 1])
            for k in over.tolist():
                t, stop = int(text[k]) + 1, int(start[k] + count[k])
                more = []
                while t < len(run) and begins[t] < stop:
                    more.append((t, begins[t], stop))
                    t += 1
                if more:
                    out.append(np.array(more, np.int64).T)
                    anchors.append(np.full(len(more), anchor[k], U64))
            text, start, stop = np.concatenate(out, 1)
            anchor = np.concatenate(anchors)
            stop = np.minimum(stop, begins[text + 1] - length + 1)
            keep = stop > start
            text, start, stop, anchor = text[keep], start[keep], stop[keep], anchor[keep]
            yield text + at, anchor, start - begins[text], stop - start
        at = end


class SuffixLevels:
    """Suffix arrays of distinct strings in byte order, the newest last; sizes at least halve from one to the next.

    A string is a suffix of its piece cut after `length` bytes, the depth to which matches are looked for: two suffixes
    share that many bytes where their strings are equal.
    """

    def __init__(self, length: int):
        self.length = length
        self.levels: list[np.ndarray] = []

    def scan(self, strings: np.ndarray) -> np.ndarray:
        """Which of the strings, in byte order, have a common prefix of all `length` bytes with their place in some level."""
        found = np.zeros(len(strings), bool)
        for held in self.levels:
            open_ = np.flatnonzero(~found)
            seat = np.searchsorted(held, strings[open_])
            seat[seat == len(held)] = 0
            found[open_] = held[seat] == strings[open_]
        return found

    def add(self, strings: np.ndarray) -> None:
        """Take distinct strings that no level holds, in byte order; levels of like size merge in one pass."""
        if not len(strings):
            return
        self.levels.append(strings)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) >= len(self.levels[-2]):
            new, old = self.levels.pop(), self.levels.pop()
            self.levels.append(np.insert(old, np.searchsorted(old, new), new))


def suffix_array(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of strings of `length` bytes within the texts, numbered text by text: their byte order (equal ones in order
    of their numbers), the strings in that order, and where a string differs from the one before."""
    sizes = np.array([len(x) for x in texts], np.int64)
    counts = sizes - length + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    # Strings of one width: padding cannot make unequal ones equal, and null bytes sort first.
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[start].view(f"S{length}").reshape(-1)
    order = np.argsort(strings, kind="stable")
    strings = strings[order]
    return order, strings, np.concatenate(([True], strings[1:] != strings[:-1]))


def covered(owners: np.ndarray, texts: list[bytes], index: SuffixLevels) -> np.ndarray:
    """For the starts of pieces in id order: whether an earlier id has the string. The index takes the new ones."""
    order, strings, first = suffix_array(texts, index.length)
    owner = np.repeat(owners, [len(x) - index.length + 1 for x in texts])[order]
    heads = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    known = index.scan(strings[heads])
    index.add(strings[heads[~known]])
    out = np.empty(len(order), bool)
    out[order] = known[group] | (owner > owner[heads][group])
    return out


_ROW = np.dtype([("o", "<i8"), ("sig", "<u4"), ("start", "<u4"), ("count", "<u2"), ("size", "<u2")])


def _pack(rows: np.ndarray, texts: list[bytes]) -> bytes:
    """Pieces of one shard, column by column and compressed: places first, then the bytes of those that have some."""
    columns = b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in _ROW.names)
    return zlib.compress(len(rows).to_bytes(4, "little") + columns + b"".join(texts), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zlib.decompress(blob)
    n, at = int.from_bytes(raw[:4], "little"), 4
    rows = np.empty(n, _ROW)
    for f in _ROW.names:
        kind = _ROW.fields[f][0]
        rows[f] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    ends = at + np.cumsum(rows["size"].astype(np.int64))
    return rows, [raw[b - s : b] for b, s in zip(ends.tolist(), rows["size"].tolist())]


def repeated_spans(docs: DataFrame, id_col: str, text: str, length: int = 50, gram: int = 20, bitmap_buckets: int = 2048, batch_strings: int = 1 << 17, shard_bytes: int = 1 << 23) -> DataFrame:
    """Rows (o, sig, start, stop): byte ranges of a text that strings of smaller ids cover; o is the id in order, sig a hash of the text."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(_order(id_col).alias("o"), _signature(text).alias("sig"), F.col(text).alias("text")).where(F.octet_length("text") >= length)

    def anchors(batches):
        held, size = [], 0

        def flush():
            anchor, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(np.minimum(n, 2), pa.int64())], names=["anchor", "n"])

        for batch in slices(batches):
            for t, anchor, _, _ in _runs(as_bytes(batch.column(0)), length, gram):
                order = np.lexsort((anchor, t))
                a, b = anchor[order], t[order]
                held.append(a[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))])
                size += len(held[-1])
            if size > 1 << 20:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    # An anchor counts once for each of its texts; that two rows may share an id only adds candidates.
    counted = rows.select("text").mapInArrow(anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast(collect_bitmap(counted.where("n > 1"), "anchor", bitmap_buckets))
    # Shards grow in number, not in size: one for so many bytes of text, and one a task.
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(parallelism(spark), -(-total // shard_bytes))

    def sent(batches):
        held, size = [], 0
        for batch in slices(batches):
            own, sigs, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), as_bytes(batch.column(2))
            for t, anchor, start, count in _runs(texts, length, gram):
                keep = np.flatnonzero(may_hold(shared.value, anchor.view(np.int64)))
                rows_in = np.empty(len(keep), _ROW)
                rows_in["o"], rows_in["sig"], rows_in["start"], rows_in["count"] = own[t[keep]], sigs[t[keep]], start[keep], count[keep]
                ends = (start[keep] + count[keep] + length - 1).tolist()
                held.append((anchor[keep] % U64(shards), rows_in, [texts[i][a:b] for i, a, b in zip(t[keep].tolist(), start[keep].tolist(), ends)]))
                size += len(keep)
            if size >= 1 << 17:
                yield settle(held)
                held, size = [], 0
        if size:
            yield settle(held)

    def settle(held):
        shard, rows_in = np.concatenate([h[0] for h in held]).astype(np.int64), np.concatenate([h[1] for h in held])
        texts = [x for h in held for x in h[2]]
        least: dict[bytes, int] = {}
        for piece, o in zip(texts, rows_in["o"].tolist()):
            if least.setdefault(piece, o) > o:
                least[piece] = o
        # A piece that a smaller id of the same run holds too is covered: it travels without its bytes.
        full = np.array([least[p] for p in texts], np.int64) == rows_in["o"]
        rows_in["size"] = np.where(full, rows_in["count"] + (length - 1), 0)
        order = np.lexsort((rows_in["start"], rows_in["o"], shard))
        edges = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0, [True])))
        groups = [order[a:b] for a, b in zip(edges, edges[1:])]
        blobs = [_pack(rows_in[g], [texts[k] for k in g.tolist() if full[k]]) for g in groups]
        return pa.RecordBatch.from_arrays([pa.array([int(shard[g[0]]) for g in groups], pa.int32()), pa.array([int(rows_in["o"][g].min()) for g in groups], pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "o", "blob"])

    def found(batches):
        own, at = [], None
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != at:
                    yield from search(own)
                    own, at = [], shard
                own.append(blob.as_py())
        yield from search(own)

    def search(blobs):
        """All of one shard: pieces in id order, equal ones once, batch by batch against the levels."""
        if not blobs:
            return
        parts = [_unpack(b) for b in blobs]
        places, texts = np.concatenate([p[0] for p in parts]), [x for p in parts for x in p[1]]
        del parts
        order = np.argsort(places["o"], kind="stable")
        index, least, batch, strings, done = SuffixLevels(length), {}, [], 0, []
        direct = []
        last = None
        for k in order.tolist():
            piece, o = texts[k], int(places["o"][k])
            if not piece or least.setdefault(piece, o) < o:
                direct.append(k)
                continue
            if strings >= batch_strings and o != last:
                done += match(places, texts, batch, index)
                batch, strings = [], 0
            batch.append(k)
            strings += len(piece) - length + 1
            last = o
        if batch:
            done += match(places, texts, batch, index)
        d = places[direct]
        out = [np.stack([d["o"], d["sig"].astype(np.int64), d["start"].astype(np.int64), d["start"].astype(np.int64) + d["count"] + (length - 1)])]
        if done:
            out.append(np.array(done, np.int64).T)
        columns = np.concatenate(out, 1)
        if columns.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["o", "sig", "start", "stop"])

    def match(places, texts, batch, index):
        hit = covered(places["o"][batch], [texts[k] for k in batch], index)
        edge = np.zeros(len(batch) + 1, np.int64)
        np.cumsum(places["count"][batch], out=edge[1:])
        inner = np.zeros(len(hit) + 1, bool)
        inner[edge] = True
        on = np.concatenate(([False], hit))
        turn_on = np.flatnonzero(hit & (inner[:-1] | ~on[:-1]))
        off = np.concatenate((hit[1:], [False]))
        turn_off = np.flatnonzero(hit & (inner[1:] | ~off)) + 1
        piece = np.searchsorted(edge, turn_on, side="right") - 1
        at = places[np.array(batch)[piece]]
        begin = at["start"].astype(np.int64) - edge[piece]
        return list(zip(at["o"].tolist(), at["sig"].tolist(), (begin + turn_on).tolist(), (begin + turn_off + length - 1).tolist()))

    blobs = rows.mapInArrow(sent, "shard int, o long, blob binary")
    return blobs.repartitionById(shards, "shard").sortWithinPartitions("shard", "o").select("shard", "blob").mapInArrow(found, "o long, sig long, start long, stop long")


def _order(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def _signature(text: str):
    """Tells texts of one id apart."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def cut_spans(raw: bytes, spans: list) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed runs."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), [(a, b) for a, b in merged]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50, gram: int = 20, bitmap_buckets: int = 2048) -> DataFrame:
    """Adds kept (the remaining bytes), n_bytes, n_removed and n_spans."""
    spans = repeated_spans(docs, id_col, text, length, gram, bitmap_buckets)
    by_doc = spans.groupBy("o", "sig").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    by_doc = by_doc.select(F.col("o").alias("__so"), F.col("sig").alias("__ss"), "__spans")
    added = [T.StructField("kept", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]]
    schema = _replaced(docs.schema, *added)
    names = [f.name for f in schema.fields]
    kept = names[: -len(added)]
    # Text crosses the shuffle once: as a column that is kept anyway, or else beside the others.
    carried = kept if text in kept else [*kept, text]
    own = docs.select(*[F.col(f"`{c}`") for c in carried], _order(id_col).alias("__o"), _signature(text).alias("__s"))
    joined = own.join(by_doc, (F.col("__o") == F.col("__so")) & (F.col("__s") == F.col("__ss")), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in carried], F.col("__spans.start").alias("__a"), F.col("__spans.stop").alias("__b"))
    place, n = carried.index(text), len(carried)

    def run(batches):
        for batch in slices(batches):
            out = []
            for raw, a, b in zip(as_bytes(batch.column(place)), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                left, merged = cut_spans(raw or b"", list(zip(a or [], b or [])))
                out.append((left, len(raw or b""), len(raw or b"") - len(left), len(merged)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), [pa.binary(), pa.int64(), pa.int64(), pa.int64()])] if out else [pa.array([], pa.binary()), *[pa.array([], pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(kept))], *columns], names=names)

    return joined.mapInArrow(run, schema)
