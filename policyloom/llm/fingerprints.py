"""Document fingerprints by one-permutation MinHash.

A shingle is hashed once; the leading bits of its hash choose a bin and the bin keeps its least hash. Empty bins
borrow from bins that a fixed hash of (bin, attempt) walks to, until one is filled (optimal densification). Of each
bin the low `bits` bits of a mix of hash and bin are packed. Two fingerprints that agree in a share m of their bins
have the likeness (m - c) / (1 - c) with c = 2 ** -bits, which corrects for chance agreement; it is clipped to 0..1.

edit_pairs() sets every document beside its successor by id: ids are cut in ranges by approximate quantiles, each
range's first document is dealt to the range before too (the first of all to the last), and one shuffle of the text
sorts ranges in their partitions. Only the cuts and the first id of each range reach the driver, a few for a partition.

Defined results: a null text is the empty text; a wordless text has the fingerprint '', like another such text
(1.0) and unlike any other (0.0). Rows of one id are ordered by their texts; a null id sorts before all. A single
document succeeds itself. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism, ship
from .kernels import U64, batch_shingles, mix, slices

_LEAST = -(1 << 63)


def minhash(shingles: np.ndarray, bins: int = 512, bits: int = 4) -> bytes:
    """The packed fingerprint of sorted distinct shingle hashes; no bytes for the empty set."""
    if not len(shingles):
        return b""
    if bins & (bins - 1) or bits not in (1, 2, 4, 8):
        raise ValueError("bins must be a power of two and bits 1, 2, 4 or 8")
    own = (shingles >> U64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    least = np.zeros(bins, U64)
    filled = np.zeros(bins, bool)
    least[own[first]] = shingles[first]
    filled[own[first]] = True
    source = np.arange(bins)
    open_bins = np.flatnonzero(~filled)
    attempt = 1
    while len(open_bins):
        at = (mix(open_bins.astype(U64) + U64(attempt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & U64(bins - 1)).astype(np.int64)
        source[open_bins] = at
        open_bins = open_bins[~filled[at]]
        attempt += 1
    low = (mix(least[source] + np.arange(bins, dtype=U64) * U64(0xD1342543DE82EF95)) & U64((1 << bits) - 1)).astype(np.uint8)
    if bits == 8:
        return low.tobytes()
    planes = (low[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(-1)).tobytes()


def likeness(a: bytes, b: bytes, bits: int = 4) -> float:
    """Estimated Jaccard similarity of the sets behind two fingerprints."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    planes = np.unpackbits(x ^ y).reshape(-1, bits)
    agree = 1.0 - float(planes.any(1).mean())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (agree - chance) / (1.0 - chance)))


def edited(text: str, after: str) -> str:
    """The last half of a text, rounded down, replaced by as many code points from the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _ranges(ids: DataFrame, pieces: int):
    """Cuts of the ids into ranges, and for the first id of each range the range before it."""
    share = [k / pieces for k in range(1, pieces)]
    cuts = np.array(sorted(set(ids.agg(F.percentile_approx("o", share, 20 * pieces)).first()[0] or [])), np.int64) if share else np.empty(0, np.int64)

    @F.pandas_udf("int")
    def piece(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, o.to_numpy(np.int64), side="right").astype(np.int32))

    firsts = sorted((r.b, r.o) for r in ids.groupBy(piece("o").alias("b")).agg(F.min("o").alias("o")).collect())
    before = {o: firsts[k - 1][0] for k, (_, o) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(o: pd.Series) -> pd.Series:
        values = o.to_numpy(np.int64)
        own = np.searchsorted(cuts, values, side="right").tolist()
        # A range's number doubled; one more marks a row that only serves as a successor.
        return pd.Series([[2 * b] if v not in before else [2 * b, 2 * before[v] + 1] for v, b in zip(values.tolist(), own)])

    return places


def edit_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bins: int = 512, bits: int = 4, width: int = 5) -> DataFrame:
    """Per document: id, n_chars, the SHA-256 of its edited text, both fingerprints, likeness to the edited and to the next text."""
    ship(docs.sparkSession)
    partitions = parallelism(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    places = _ranges(rows.select("o"), 4 * partitions)
    dealt = rows.withColumn("place", F.explode(places("o"))).withColumn("piece", F.expr("place div 2"))
    dealt = dealt.repartition(partitions, "piece").sortWithinPartitions("piece", "place", "o", "text").select("place", "id", "text")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None
        for batch in slices(batches):
            place, ids, texts = (c.to_pylist() for c in batch.columns)
            prints = [minhash(s, bins, bits) for s in batch_shingles([x.encode("utf-8", "surrogatepass") for x in texts], width)]
            now = list(zip(place, ids, texts, prints))
            chain = now if held is None else [held, *now]
            held = chain[-1] if chain else held
            # Each row of a range but its last copy has its successor right behind it.
            pairs = [(a, b) for a, b in zip(chain, chain[1:]) if not a[0] & 1 and a[0] >> 1 == b[0] >> 1]
            changed = [edited(a[2], b[2]).encode("utf-8", "surrogatepass") for a, b in pairs]
            after = [minhash(s, bins, bits) for s in batch_shingles(changed, width)]
            out = [
                (a[1], len(a[2]), hashlib.sha256(c).hexdigest(), base64.b64encode(a[3]).decode(), base64.b64encode(e).decode(), likeness(a[3], e, bits), likeness(a[3], b[3], bits))
                for (a, b), c, e in zip(pairs, changed, after)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)] if any(r[0] is not None for r in out) else [pa.array([None] * len(out), pa.int64()), *[pa.array(x) for x in list(zip(*out))[1:]]], names=names)

    return dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
