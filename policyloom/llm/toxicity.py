"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as symbols: insult, threat, target, negation, report, other. Small Mealy machines rewrite the stream
and are composed into one machine: negation turns an insult or threat that follows within a few words into a negated
one, reported speech turns those behind it into reported ones, and a target beside an insult makes it a targeted one.
The composed machine's outputs are the kinds of matched clauses; a clause weighs as much as its strongest term of each
kind. A document's features are, by kind, its strongest clause and how many clauses match; logistic weights over them
give the score. So clauses are scored, never words alone, and how much negation or reporting takes off is learned.

Words that insult are learned: whole words and word beginnings (4 to 6 letters) that a bounded sample of labelled rows
ties to label 1, chosen greedily, each for the labelled documents that the terms before it leave unexplained. The sample holds at
most max_rows rows of each label, drawn by a hash of the id among all of them; the driver sees term counts (at most
max_terms) and a bit a term and row. Scoring is one pass without a shuffle; a multi-pattern automaton finds terms in
whole texts and only clauses with a term are run.

Defined results: null and empty texts score as a text without matches; ties do not arise, as every row is scored for
itself; without labelled rows of both labels the seed lexicon alone scores. Columns of other names pass through.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .bpe import _replaced
from .kernels import slices

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Kinds of matches that the composed machine tells apart.
KINDS = ("plain", "targeted", "negated", "reported", "threat")
_PLAIN, _TARGETED, _NEGATED, _REPORTED, _THREAT = range(5)
WORDS = {
    TARGET: "you your you're yours he she they them him her du dich dir euch ihr tu toi vous ils tú usted vosotros ustedes".split(),
    NEGATION: "not no never isn't aren't wasn't don't nobody without nicht kein keine nie niemals ne pas jamais aucun nunca ningún sin".split(),
    REPORT: "said says say told tells called calls quoted wrote claims claimed reported sagte sagt nannte dit disait dijo dice llamó".split(),
    THREAT: "kill murder hurt beat destroy stab shoot strangle töten umbringen tuer frapper matar golpear".split(),
    INSULT: "idiot moron stupid pathetic worthless scum disgusting loser".split(),
}
_CLAUSE_END = re.compile(r"[.!?;:\n]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_NEAR = 3


class Machine:
    """A Mealy machine over small integers: table[state][symbol] = (next state, output)."""

    def __init__(self, table: list[list[tuple[int, int]]]):
        self.table = table

    def __rshift__(self, after: "Machine") -> "Machine":
        """The machine that feeds this one's output to another."""
        width = len(after.table)
        table = []
        for a in range(len(self.table)):
            for b in range(width):
                row = []
                for symbol in range(len(self.table[0])):
                    to, out = self.table[a][symbol]
                    to_b, out_b = after.table[b][out]
                    row.append((to * width + to_b, out_b))
                table.append(row)
        return Machine(table)

    def run(self, symbols) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state, o = self.table[state][s]
            out.append(o)
        return out


# The stream's alphabet grows by rewritten symbols: 6 negated insult or threat, 7 reported one, 8 targeted insult.
_NEGATED_SYMBOL, _REPORTED_SYMBOL, _TARGETED_SYMBOL, _ALPHABET = 6, 7, 8, 9


def _window(trigger: int, rewrite: dict[int, int], reach: int) -> Machine:
    """Rewrites symbols that follow a trigger within `reach` words; reach 0: to the clause's end."""
    states = 2 if reach == 0 else reach + 1
    table = []
    for left in range(states):
        row = []
        for s in range(_ALPHABET):
            out = rewrite.get(s, s) if left else s
            to = states - 1 if s == trigger else (left if reach == 0 else max(0, left - 1))
            row.append((to, out))
        table.append(row)
    return Machine(table)


GRAMMAR = (
    _window(NEGATION, {INSULT: _NEGATED_SYMBOL, THREAT: _NEGATED_SYMBOL}, _NEAR)
    >> _window(REPORT, {INSULT: _REPORTED_SYMBOL, THREAT: _REPORTED_SYMBOL}, 0)
    >> _window(TARGET, {INSULT: _TARGETED_SYMBOL}, _NEAR)
)
_KIND_OF = {INSULT: _PLAIN, _TARGETED_SYMBOL: _TARGETED, _NEGATED_SYMBOL: _NEGATED, _REPORTED_SYMBOL: _REPORTED, THREAT: _THREAT}


@dataclass
class ToxicityModel:
    """Insult terms with weights (a term that ends in * is a word's beginning) and logistic weights."""

    terms: dict[str, float]
    weights: np.ndarray
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                found.add_word(term.rstrip("*"), (len(term.rstrip("*")), term.endswith("*"), INSULT, weight))
            for word in WORDS[THREAT]:
                if not found.exists(word):
                    found.add_word(word, (len(word), False, THREAT, 1.0))
            found.make_automaton()
            self._automaton = found
        return self._automaton


_SYMBOLS = {word: symbol for symbol, words in WORDS.items() if symbol not in (INSULT, THREAT) for word in words}


def matches(text: str, model: ToxicityModel) -> list[tuple[int, float]]:
    """Kind and weight of the strongest term of each kind in each clause that has any."""
    low = text.lower()
    hits: dict[int, tuple[int, int, float]] = {}
    for stop, (size, begins, symbol, weight) in model.automaton().iter(low):
        start = stop - size + 1
        if start and low[start - 1].isalnum() or not begins and stop + 1 < len(low) and low[stop + 1].isalnum():
            continue
        if start not in hits or hits[start][2] < weight:
            hits[start] = (stop + 1, symbol, weight)
    out, done = [], -1
    for start in sorted(hits):
        if start < done:
            continue
        begin = max((m for m in (low.rfind(c, 0, start) for c in ".!?;:\n")), default=-1) + 1
        found = _CLAUSE_END.search(low, hits[start][0])
        done = found.start() if found else len(low)
        symbols, weights = [], []
        for word in _WORD.finditer(low, begin, done):
            hit = hits.get(word.start())
            symbols.append(hit[1] if hit else _SYMBOLS.get(word.group(), OTHER))
            weights.append(hit[2] if hit else 0.0)
        best: dict[int, float] = {}
        for s, w in zip(GRAMMAR.run(symbols), weights):
            if s in _KIND_OF and w:
                best[_KIND_OF[s]] = max(best.get(_KIND_OF[s], 0.0), w)
        out += best.items()
    return out


def features(text: str | None, model: ToxicityModel) -> np.ndarray:
    """By kind the strongest clause and the log of how many clauses match, and a constant."""
    x = np.zeros(2 * len(KINDS) + 1)
    x[-1] = 1.0
    for kind, weight in matches(text or "", model):
        x[2 * kind] = max(x[2 * kind], weight)
        x[2 * kind + 1] += 1.0
    x[1:-1:2] = np.log1p(x[1:-1:2])
    return x


def score(text: str | None, model: ToxicityModel) -> float:
    """0 to 1; higher means toxic likelier."""
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(features(text, model) @ model.weights)))))


def _terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in (4, 5, 6) if len(w) > n}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method, both labels weighing alike."""
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (balance * p * (1 - p))[:, None]) + penalty, x.T @ (balance * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 3000, max_terms: int = 4000) -> ToxicityModel:
    """Fit on at most max_rows labelled rows of each label; labels holds (id, label); an id that any row calls toxic is toxic."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).groupBy("__id").agg(F.max("y").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    seeds = {w: 4.0 for w in WORDS[INSULT]}
    if len(counts) < 2:
        return ToxicityModel(seeds, np.array([0.5, 0.5, 0.8, 0.8, 0.2, 0.2, 0.2, 0.2, 0.8, 0.5, -3.0]))
    draw = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, 0.95 * max_rows / n))).otherwise(share)
    # At most about 2 * max_rows ids, whatever the input: small enough to meet the documents in a broadcast join.
    sample = spark.createDataFrame([(r[0], r[1]) for r in known.where(draw < share * (1 << 30)).collect()], known.schema)
    rows = docs.join(F.broadcast(sample), F.col(id_col) == F.col("__id")).select(F.col(text).alias("text"), "y")

    def term_counts(batches):
        total: dict[str, list[int]] = {}
        for batch in slices(batches):
            for value, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in _terms_of(value or ""):
                    total.setdefault(term, [0, 0])[y] += 1
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([c[0] for c in total.values()]), pa.array([c[1] for c in total.values()])], names=["term", "n0", "n1"])

    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return ToxicityModel(seeds, np.array([0.5, 0.5, 0.8, 0.8, 0.2, 0.2, 0.2, 0.2, 0.8, 0.5, -3.0]))
    seen = rows.mapInArrow(term_counts, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    strong = seen.where("n1 >= 3").withColumn("odds", odds).where("odds >= 2")
    top = strong.orderBy(F.desc(F.col("n1") * F.col("odds")), "term").limit(max_terms).collect()
    terms = [r.term for r in top]
    place = {t: k for k, t in enumerate(terms)}

    def term_bits(batches):
        for batch in slices(batches):
            out = []
            for value in batch.column(0).to_pylist():
                row = np.zeros(max(1, len(terms)), bool)
                row[[place[t] for t in _terms_of(value or "") if t in place]] = True
                out.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["bits", "y"])

    drawn = rows.mapInArrow(term_bits, "bits binary, y int").collect()
    bits = np.array([np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), count=max(1, len(terms))) for r in drawn], bool)
    y = np.array([r.y for r in drawn])
    chosen = _learned(bits, y, terms, [r.odds for r in top])
    model = ToxicityModel(seeds | chosen, np.zeros(2 * len(KINDS) + 1))
    shared = spark.sparkContext.broadcast(model)

    def rows_of(batches):
        for batch in slices(batches):
            x = [features(v, shared.value).tolist() for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    drawn = rows.mapInArrow(rows_of, "x array<double>, y int").collect()
    model.weights = _logistic(np.array([r.x for r in drawn]), np.array([r.y for r in drawn], float))
    return model


def _learned(bits: np.ndarray, y: np.ndarray, terms: list[str], odds: list[float]) -> dict[str, float]:
    """The greedy cover, and besides every term that a twentieth of the toxic rows and next to no clean row hold."""
    own, clean = bits[y == 1].sum(0), bits[y == 0].sum(0)
    strong = {t: float(o) for t, o, a, b in zip(terms, odds, own, clean) if a >= max(5, 0.05 * (y == 1).sum()) and b * 50 <= a}
    held = {t: int(a) for t, a in zip(terms, own)}
    # A beginning gives way to a longer term that explains as much.
    stems = [t for t in strong if t.endswith("*")]
    for stem in stems:
        if any(t != stem and t.startswith(stem[:-1]) and held[t] >= 0.9 * held[stem] for t in strong):
            held[stem] = 0
    return {t: o for t, o in strong.items() if held[t]} | _cover(bits, y, terms, odds)


def _cover(bits: np.ndarray, y: np.ndarray, terms: list[str], odds: list[float]) -> dict[str, float]:
    """Terms chosen greedily: each explains the most toxic rows that no term before it did, less ten times the clean rows it hits."""
    left = bits[y == 1].astype(np.float32)
    clean = bits[y == 0].sum(0) * 10.0 * max(1, (y == 1).sum()) / max(1, (y == 0).sum())
    open_rows = np.ones(len(left), np.float32)
    chosen: dict[str, float] = {}
    while terms and len(chosen) < 400:
        gain = open_rows @ left - clean
        # Among equals the longer, more particular term comes first.
        best = max(range(len(terms)), key=lambda k: (gain[k], len(terms[k]), terms[k]))
        if gain[best] < 3:
            break
        chosen[terms[best]] = float(odds[best])
        open_rows *= 1.0 - 0.6 * left[:, best]
        open_rows[open_rows < 0.2] = 0.0
        left[:, best] = 0.0
    return chosen


def add_scores(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds score and predicted (1 from 0.5 on)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = _replaced(docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()))
    kept = [f.name for f in schema.fields[:-2]]
    needed = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for batch in slices(batches):
            scores = [score(v, shared.value) for v in batch.column(len(kept)).to_pylist()]
            columns = [*[batch.column(k) for k in range(len(kept))], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])

    return needed.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from fitting: the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
