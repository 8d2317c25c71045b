"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves a whole pre-token that is itself a vocabulary entry by a minimal perfect hash
(hash and displace), for all pre-tokens of a run of texts at once. Tier two merges the misses
with a heap over doubly linked bytes, in rank order and leftmost first. Ids equal those of the rank
file's own library.

Defined results: a null text encodes as the empty text, which has no ids; rows are never dropped or
merged, repeated rows give repeated results; other columns pass through, and a column that has the
name of an output is replaced by it; an empty table gives an empty result of the same schema.
Texts of any length are handled whole; a text longer than a run is one of its own.
"""

from __future__ import annotations

import base64
import heapq
import struct
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .kernels import U64, blocks_of, mix, same_spans, slices, span_hashes

_RUN = 1 << 18
_CACHE_ENTRIES = 1 << 16
#: The characters that \\s matches in the vocabulary's pattern.
_SPACES = "\t\n\v\f\r \x85\xa0                　"
_SPACE, _LETTER, _NUMBER, _OTHER, _EDGE = range(5)


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by id."""
    entries = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            entries[int(rank)] = base64.b64decode(token)
    if sorted(entries) != list(range(len(entries))):
        raise ValueError("ranks must be 0 to n - 1")
    return [entries[k] for k in range(len(entries))]


class PerfectHash:
    """A minimal perfect hash from distinct 64-bit keys to 0..n-1."""

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.buckets = max(1, n)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        used = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = keys[order[edges[b] : edges[b + 1]]]
            shift = 0
            while True:
                slots = self._slot(own, np.int64(shift))
                if len(set(slots.tolist())) == len(slots) and not used[slots].any():
                    break
                shift += 1
            used[slots] = True
            self.shift[b] = shift
        free = iter(np.flatnonzero(~used))
        for b in np.flatnonzero(sizes == 1):
            self.shift[b] = -int(next(free)) - 1

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> U64(20)) % U64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, shift) -> np.ndarray:
        step = np.asarray(shift, np.int64).astype(U64) * U64(0x9E3779B97F4A7C15)
        return (mix(keys + step) % U64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[self._bucket(keys)]
        return np.where(shift < 0, -shift - 1, self._slot(keys, shift))


class Vocabulary:
    """Tables of both tiers; plain arrays, so that a broadcast of it is as large as the rank file."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.kinds = _classes()
        self.ranks = {token: k for k, token in enumerate(tokens)}
        sizes = np.array([len(x) for x in tokens], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        self.blocks = blocks_of(data).copy()
        keys = span_hashes(data, ends - sizes, ends, self.blocks)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two entries share a hash")
        self.find = PerfectHash(keys)
        slots = self.find(keys)
        self.id, self.size, self.at = np.zeros(len(tokens), np.uint32), np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        self.id[slots], self.size[slots], self.at[slots] = np.arange(len(tokens)), sizes, ends - sizes
        self.cache: dict[bytes, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def merge(self, piece: bytes) -> bytes:
        """Tier two: packed ids of a pre-token that is no vocabulary entry."""
        found = self.cache.get(piece)
        if found is None:
            ids = _merged(piece, self.ranks)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                if len(self.cache) >= _CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[piece] = found
        return found


def _merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Links each part to its neighbours; a heap yields the pair of lowest rank, the leftmost among equals."""
    n = len(piece)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if stop[i] else n
        if not stop[i] or j >= n or stop[j] != end:
            continue  # one of the two parts has grown or gone since
        stop[i], stop[j] = end, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get(piece[i : stop[k]])) is not None:
                heapq.heappush(heap, (rank, i, stop[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (rank, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = after[i]
    return out


@lru_cache(1)
def _classes() -> np.ndarray:
    """The kind of every code point."""
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    marks = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    kinds[marks == "L"] = _LETTER
    kinds[marks == "N"] = _NUMBER
    kinds[[ord(c) for c in _SPACES]] = _SPACE
    return kinds


def _starts(points: np.ndarray, edges: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts laid end to end, an edge point behind each; the edges count as starts too."""
    kinds = classes[points]
    kinds[edges] = _EDGE
    n = len(points)
    turn = np.ones(n, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=turn[1:])
    turn[edges] = True
    begin = np.flatnonzero(turn)
    end = np.append(begin[1:], n)
    kind = kinds[begin]
    start = turn.copy()
    # White space before a further character of the same text: its last one stands alone or opens the next pre-token.
    inner = (kind == _SPACE) & (kinds[np.minimum(end, n - 1)] != _EDGE)
    last = end[inner] - 1
    start[last] = True
    start[end[inner][points[last] == 0x20]] = False
    # A lone apostrophe that opens a pre-token takes a contraction's letters.
    quote = begin[(kind == _OTHER) & (end - begin == 1) & (points[begin] == 0x27) & start[begin]]
    one, two = points[np.minimum(quote + 1, n - 1)], points[np.minimum(quote + 2, n - 1)]
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for hit, size in ((single, 2), (double & ~single, 3)):
        start[quote[hit] + 1] = False
        start[quote[hit] + size] = True
    return np.flatnonzero(start)


def _distinct_spans(data, blocks, begin, size, key):
    """Of spans the first of each group of equal bytes, and each span's group."""
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    other = begin[first][which]
    same = size == size[first][which]
    same[same] = same_spans(data, blocks, begin[same], other[same], size[same])
    # Spans whose hash is another's are groups of their own.
    alone = np.flatnonzero(~same)
    which = which.copy()
    which[alone] = len(first) + np.arange(len(alone))
    return np.concatenate([first, alone]), which


def encode_run(texts: list[str], vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of each text, uint32."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    edges = np.cumsum([len(x) + 1 for x in texts]) - 1
    start = _starts(points, edges, vocabulary.kinds)
    width = np.ones(len(points) + 1, np.int64)
    width[0] = 0
    width[1:] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width)
    raw = joined.encode("utf-8")
    data = np.frombuffer(raw, np.uint8)
    begin = at[start]
    stop = np.append(begin[1:], len(data))
    edge_row = np.searchsorted(start, edges)
    keep = np.ones(len(start), bool)
    keep[edge_row] = False
    begin, stop = begin[keep], stop[keep]
    size = stop - begin
    blocks = blocks_of(data)
    key = span_hashes(data, begin, stop, blocks)
    slot = vocabulary.find(key)
    # A hit has the entry's size and all its bytes.
    hit = vocabulary.size[slot] == size
    sized = np.flatnonzero(hit)
    hit[sized] = same_spans(data, blocks, begin[sized], vocabulary.at[slot[sized]], size[sized], vocabulary.blocks)
    misses = np.flatnonzero(~hit)
    first, which = _distinct_spans(data, blocks, begin[misses], size[misses], key[misses])
    first = misses[first]
    parts = [vocabulary.merge(raw[a:b]) for a, b in zip(begin[first].tolist(), stop[first].tolist())]
    part_size = np.array([len(x) // 4 for x in parts], np.int64)
    counts = np.ones(len(begin), np.int64)
    counts[misses] = part_size[which]
    places = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(counts, out=places[1:])
    ids = np.empty(places[-1], np.uint32)
    ids[places[:-1][hit]] = vocabulary.id[slot[hit]]
    if parts:
        lengths = counts[misses]
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        part_at = np.cumsum(part_size) - part_size
        ids[np.repeat(places[misses], lengths) + step] = np.frombuffer(b"".join(parts), "<u4")[np.repeat(part_at[which], lengths) + step]
    cuts = places[edge_row - np.arange(len(edge_row))]
    return np.split(ids, cuts[:-1])


def encode_texts(texts: list, vocabulary: Vocabulary):
    """The ids of each text; a null is the empty text. Texts are encoded together in runs of about a quarter of a megabyte."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= _RUN):
            size += len(texts[end] or "") + 1
            end += 1
        yield from encode_run([x or "" for x in texts[at:end]], vocabulary)
        at = end


def unpack(ids: bytes) -> list[int]:
    """Ids of a packed column."""
    return np.frombuffer(ids, "<u4").tolist()


def _replaced(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(fields))


def load(spark: SparkSession, path: str):
    """The vocabulary of a rank file, broadcast: as large as the file (here under two megabytes)."""
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path)))


def encode(docs: DataFrame, ranks_path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds token_ids (little-endian unsigned 32-bit integers, packed) and n_tokens; with decoded, in the same pass also the bytes that the ids stand for."""
    ship(docs.sparkSession)
    shared = load(docs.sparkSession, ranks_path)
    added = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("decoded", T.BinaryType())] if decoded else []
    schema = _replaced(docs.schema, *added)
    kept = [f.name for f in schema.fields[: -len(added)]]
    needed = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for batch in slices(batches):
            ids = list(encode_texts(batch.column(len(kept)).to_pylist(), shared.value))
            columns = [batch.column(k) for k in range(len(kept))]
            columns += [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
            if decoded:
                columns.append(pa.array([decode_ids(x, shared.value) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return needed.mapInArrow(run, schema)


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(vocabulary.tokens.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """Adds decoded, the bytes that the packed ids stand for; null ids decode as no bytes."""
    ship(encoded.sparkSession)
    shared = load(encoded.sparkSession, ranks_path)
    schema = _replaced(encoded.schema, T.StructField("decoded", T.BinaryType()))
    kept = [f.name for f in schema.fields[:-1]]
    needed = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__ids"))

    def run(batches):
        for batch in slices(batches):
            out = [decode_ids(np.frombuffer(x or b"", "<u4"), shared.value) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(kept))], pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return needed.mapInArrow(run, schema)
