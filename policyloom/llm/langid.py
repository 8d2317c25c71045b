"""Language identification with a blended-spectrum string kernel.

The kernel of two texts counts the character n-grams (n = 1 to 3, letters folded to lower case) that
both hold, divided by the root of the product of their counts of distinct n-grams; presence alone
counts, so that a text's length does not. n-grams are hashed to a fixed number of presence bits.
Landmarks drawn from the labelled rows span a Nystroem approximation, kernel ridge regression gives
one weight vector a language against the rest, and texts are scored in blocks: presence matrix times
landmark matrix, scaled to kernel values, times weights.

Fitting reads a bounded sample: up to max_rows labelled rows, dealt evenly over the languages and drawn
by a hash of the id among all labelled rows. Every language is learned: beyond max_rows / 4 of them, each
still has up to four rows, and each has a landmark, so sample and model grow with the languages. Only the
samples' presence bits reach the driver (bits / 8 bytes a row). Scoring is one pass without a shuffle.

Defined results: a null text, or one without any letter, is `und` with score 0; so is every text if no
labelled row exists. Ties go to the language that sorts first. Repeated rows get repeated results;
null ids and columns of other names pass through, and a column named like an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .bpe import _replaced
from .kernels import U64, mix, slices

_BLOCK = 64
_PIECE = 1 << 18


@dataclass
class LanguageModel:
    """Landmarks as presence columns, weights by landmark and language."""

    languages: list[str]
    landmarks: np.ndarray  # bits x landmarks, float32
    landmark_sizes: np.ndarray
    weights: np.ndarray  # landmarks x languages
    orders: tuple[int, ...]
    bits: int


def presence(text: str, orders: tuple[int, ...], bits: int, out: np.ndarray) -> bool:
    """Set the presence bits of a text's n-grams; whether it holds a letter. Long texts go in overlapping pieces."""
    text = text.lower()
    letters, longest = False, max(orders)
    for at in range(0, max(1, len(text)), _PIECE):
        piece = text[at : at + _PIECE + longest - 1]
        letters = letters or any(map(str.isalpha, piece[:256])) or any(map(str.isalpha, piece))
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
        total = points
        for n in range(1, longest + 1):
            if n > 1:
                if len(total) < 2:
                    break
                total = total[:-1] * U64(0x100000001B3) + points[n - 1 :]
            if n in orders:
                out[((total + U64(n)) * U64(0x9E3779B97F4A7C15) >> U64(40)) & U64(bits - 1)] = 1
    return letters


def _kernel(rows: np.ndarray, sizes: np.ndarray, landmarks: np.ndarray, landmark_sizes: np.ndarray) -> np.ndarray:
    return (rows @ landmarks) / np.sqrt(np.maximum(sizes, 1)[:, None] * np.maximum(landmark_sizes, 1)[None, :])


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    max_rows: int = 1600, landmarks: int = 160, orders: tuple[int, ...] = (1, 2, 3), bits: int = 1 << 14, ridge: float = 1e-2,
) -> LanguageModel:
    """Fit on rows of non-null text and lang; at most max_rows of them or four a language, chosen by a hash of the id."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((bits, 0), np.float32), np.zeros(0), np.zeros((0, 0)), orders, bits)
    each = max(4, max_rows // len(counts))
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit("langid"))
    shares = labelled.sparkSession.createDataFrame([(name, min(1.0, 1.3 * each / n + 5 / n)) for name, n in counts.items()], "__lang string, share double")
    dealt = rows.select(draw.alias("draw"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(shares), F.col("lang") == F.col("__lang"))
    sample = dealt.where(F.pmod("draw", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("draw", "text", "lang")

    def bits_of(batches):
        for batch in slices(batches):
            out = []
            for value in batch.column(1).to_pylist():
                row = np.zeros(bits, np.uint8)
                presence(value, orders, bits, row)
                out.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["draw", "lang", "bits"])

    drawn = sample.mapInArrow(bits_of, "draw long, lang string, bits binary").collect()
    languages = sorted(counts)
    own_rows: dict[str, set] = {name: set() for name in languages}
    for r in drawn:
        own_rows[r.lang].add((r.draw, bytes(r.bits)))
    picked = [sorted(own)[:each] for own in own_rows.values()]
    x = np.array([np.unpackbits(np.frombuffer(b, np.uint8)) for own in picked for _, b in own], np.float32).reshape(-1, bits)
    y = np.repeat(np.arange(len(languages)), [len(own) for own in picked])
    per = max(1, landmarks // len(languages))
    first = np.concatenate([np.flatnonzero(y == k)[:per] for k in range(len(languages))])
    sizes = x.sum(1)
    chosen, chosen_sizes = x[first].T.copy(), sizes[first]
    to_landmarks = _kernel(x, sizes, chosen, chosen_sizes).astype(np.float64)
    among = to_landmarks[first]
    balance = 1.0 / np.bincount(y, minlength=len(languages))[y]
    target = (y[:, None] == np.arange(len(languages))[None, :]).astype(np.float64)
    left = to_landmarks.T @ (to_landmarks * balance[:, None]) + ridge * among + 1e-6 * np.eye(len(first))
    weights = np.linalg.solve(left, to_landmarks.T @ (target * balance[:, None]))
    return LanguageModel(languages, chosen, chosen_sizes, weights, orders, bits)


def score_block(texts: list, model: LanguageModel) -> tuple[list[str], list[float]]:
    """Language and score of each text of a block."""
    rows = np.zeros((len(texts), model.bits), np.float32)
    known = np.array([value is not None and presence(value, model.orders, model.bits, row) for value, row in zip(texts, rows)], bool)
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    margins = _kernel(rows, rows.sum(1), model.landmarks, model.landmark_sizes) @ model.weights
    best = margins.argmax(1)
    score = np.clip(margins[np.arange(len(best)), best], 0.0, 1.0)
    return [model.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0).tolist()


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = _replaced(docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()))
    kept = [f.name for f in schema.fields[:-2]]
    needed = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for batch in slices(batches):
            values, names, scores = batch.column(len(kept)), [], []
            for at in range(0, len(values), _BLOCK):
                a, b = score_block(values.slice(at, _BLOCK).to_pylist(), shared.value)
                names += a
                scores += b
            columns = [*[batch.column(k) for k in range(len(kept))], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return needed.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from fitting: the CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
