"""Token overlap ranking, near duplicates, similarity to a source, and greedy acceptance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import discard, parallelism, ship, stored


#: Token entries of a block of queries or records; a pair of blocks is one task's work and memory.
BLOCK_TOKENS = 1 << 21


#: A token of more than one in so many records of a block has a row of a table of bytes, one a record; others have lists.
COMMON_OF_BLOCK = 32


def best_of_block(queries: pa.Table, records: pa.Table, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, record row, shared tokens) of the k best records of a block for each query, ties by record id.

    Rows of a query's common tokens are added up byte by byte, its rare tokens are counted from their lists. Records with many tokens come first: the k-th best of
    the first ones is the least that can still come in, so few of the others are sorted.
    """
    lists = [t.column("tokens").combine_chunks() for t in (queries, records)]
    (q_at, q_tok), (r_at, r_tok) = [(x.offsets.to_numpy(), x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()]) for x in lists]
    q_at, n = q_at - q_at[0], len(r_at) - 1
    largest = np.argsort(-np.diff(r_at), kind="stable")
    spot = np.empty(n, np.int32)
    spot[largest] = np.arange(n, dtype=np.int32)
    # Of the block's tokens only those of a query are kept.
    known, place = np.unique(q_tok, return_inverse=True)
    if not len(known) or not n:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    token = np.searchsorted(known, r_tok).astype(np.int32)
    token[known[np.minimum(token, len(known) - 1)] != r_tok] = -1
    owner = np.repeat(spot, np.diff(r_at))[token >= 0]
    token = token[token >= 0]
    owner, df = owner[np.argsort(token, kind="stable")], np.bincount(token, minlength=len(known))
    del token
    ends = np.cumsum(df)
    starts = ends - df
    common = np.flatnonzero(df * COMMON_OF_BLOCK > n)
    row_of = np.full(len(known), -1)
    row_of[common] = np.arange(len(common))
    table = np.zeros((len(common), n), np.uint8)
    for row, t in enumerate(common):
        table[row, owner[starts[t] : ends[t]]] = 1
    by_id = np.empty(n, np.int64)
    by_id[np.array(pc.sort_indices(records.column("rid")))] = np.arange(n)
    by_id = by_id[largest]
    first = min(n, max(k, n // 16))
    out = ([], [], [])
    for q in range(len(q_at) - 1):
        tokens = place[q_at[q] : q_at[q + 1]]
        tokens = tokens[df[tokens] > 0]
        if len(tokens) < least:
            continue
        row = row_of[tokens]
        rare, rows = tokens[row < 0], row[row >= 0]
        score = np.zeros(n, np.uint16 if len(tokens) < 1 << 16 else np.uint32)
        for at in range(0, len(rows), 255):  # what a byte holds
            score += np.add.reduce(table[rows[at : at + 255]], axis=0, dtype=np.uint8)
        if len(rare):
            held = [owner[a:b] for a, b in zip(starts[rare].tolist(), ends[rare].tolist(), strict=True)]
            score += np.bincount(np.concatenate(held), minlength=n).astype(score.dtype)
        cut = max(least, int(np.partition(score[:first], first - k)[first - k])) if first >= k else least
        found = np.flatnonzero(score >= cut)
        shared = score[found].astype(np.int64)
        best = np.lexsort((by_id[found], -shared))[:k]
        for part, values in zip(out, (np.full(len(best), q), largest[found[best]], shared[best]), strict=True):
            part.append(values)
    return tuple(np.concatenate(part) if part else np.zeros(0, np.int64) for part in out)


def overlap_top_k(queries: DataFrame, records: DataFrame, query_id: str, query_text: Column, record_id: str, record_text: Column, k: int, least: int = 1, token_set=X.token_set, block: int = BLOCK_TOKENS) -> DataFrame:
    """For each query the k records that share most distinct tokens; ties by record id. Records below `least` shared tokens are left out. Ids are unique and not null.

    Queries and records are dealt into blocks of about `block` tokens. Each pair of blocks counts in one task and gives at most k records a query, so what is
    shuffled is token hashes once for each block of the other side, and k rows; no pair of a query and a record is a row.
    """
    spark = queries.sparkSession
    ship(spark)
    hashed = lambda text: F.transform(token_set(text), lambda t: F.xxhash64(t))
    q = stored(queries.select(F.col(query_id).alias("qid"), hashed(query_text).alias("tokens")).where("size(tokens) > 0"), "ranking-queries")
    r = stored(records.select(F.col(record_id).alias("rid"), hashed(record_text).alias("tokens")).where("size(tokens) > 0"), "ranking-records")
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    n_q = 1 + size(q) // block
    n_r = max(1 + size(r) // block, -(-min(parallelism(spark), 64) // n_q))  # as many tasks as the session has partitions, if blocks are few
    dealt_q = q.select("*", F.pmod(F.xxhash64("qid"), F.lit(n_q)).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_r - 1).cast("long"))).alias("b"))
    dealt_r = r.select("*", F.pmod(F.xxhash64("rid"), F.lit(n_r)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("a"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": left.column("qid").slice(0, 0), "rid": right.column("rid").slice(0, 0), "score": pa.array([], pa.int64())})
        rows, found, score = best_of_block(left, right, k, least)
        return pa.table({"qid": left.column("qid").take(pa.array(rows)), "rid": right.column("rid").take(pa.array(found)), "score": pa.array(score, pa.int64())})

    kinds = f"qid {queries.schema[query_id].dataType.simpleString()}, rid {records.schema[record_id].dataType.simpleString()}, score long"
    found = dealt_q.groupBy("a", "b").cogroup(dealt_r.groupBy("a", "b")).applyInArrow(run, kinds)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("qid").alias(query_id), F.col("rid").alias(record_id), "score", "rank")


def overlap_top_k_with_zeros(queries: DataFrame, records: DataFrame, query_id: str, query_text: Column, record_id: str, record_text: Column, k: int, token_set=X.word_or_cjk_set) -> DataFrame:
    """As above, but records without a common token fill up the list, smallest id first.

    Only the first records by id can do that for any query, so 2k of them are added to each, not all records.
    """
    scored = overlap_top_k(queries, records, query_id, query_text, record_id, record_text, k, 1, token_set).select(query_id, record_id, "score")
    # The k smallest ids that are not yet ranked: among the k smallest and k that may be ranked, at least k are free.
    fill = [r[0] for r in records.select(record_id).distinct().orderBy(record_id).limit(2 * k).collect()]
    kind = records.schema[record_id].dataType
    padded = queries.select(query_id).distinct().withColumn(record_id, F.explode(F.array(*[F.lit(x).cast(kind) for x in fill])))
    zeros = padded.join(scored.select(query_id, record_id), [query_id, record_id], "left_anti").withColumn("score", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), record_id))
    return scored.unionByName(zeros).withColumn("rank", rank).where(F.col("rank") <= k)


#: Shingles that stand last in the order of prefixes: at most so many, each in more than so many sets of those looked at. Any list gives the same pairs.
MOST_COMMON, COMMON_FROM, LOOKED_AT = 1 << 15, 4, 1 << 14
#: Work of one comparing task, in shingles of the pairs it gets; it bounds what the task holds.
CELL_WORK = 1 << 23
#: Most ids that are sent to the rows they name; more of them are joined.
MOST_SENT = 1 << 19


def among(rows: DataFrame, ids: DataFrame, name: str, how: str = "left_semi") -> DataFrame:
    """Rows joined with ids by `name`. Few ids are sent to the rows, so long rows stay where they are; ids are counted first."""
    few = ids.limit(MOST_SENT + 1).count() <= MOST_SENT
    return rows.join(F.broadcast(ids) if few else ids, name, how)


def common_grams(sets: DataFrame, held: DataFrame | None = None) -> list[int]:
    """Shingles of many sets, such as those of quoted passages, so that prefixes can begin with the others. held: unique keys of the sets that count.

    Prefixes are right with any list, so it is made from every 16th set, or more of a small table; no pair depends on it.
    """
    every = max(1, min(16, sets.count() // LOOKED_AT))
    some = sets.where(F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(every)) == 0).select("key", "grams")
    n = F.count(F.lit(1)).alias("n")
    many = (some if held is None else some.join(held, "key")).select(F.explode("grams").alias("gram")).groupBy("gram").agg(n).where(F.col("n") > COMMON_FROM)
    return [r.gram for r in many.orderBy(F.desc("n"), "gram").limit(MOST_COMMON).collect()]


def heads_of(grams: pa.ListArray, threshold: float, listed: np.ndarray) -> pa.ListArray:
    """The first n - ceil(threshold n) + 1 codes of each set. Their natural order has the listed shingles (sorted) last: codes are negative for others, not for them.

    A code has 63 bits of a shingle; the lost one can only add candidates.
    """
    at, values = grams.offsets.to_numpy() - grams.offsets[0].as_py(), grams.values.to_numpy()[grams.offsets[0].as_py() : grams.offsets[-1].as_py()]
    code = (values.view(np.uint64) >> np.uint64(1)).astype(np.int64)
    common = listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values if len(listed) else np.zeros(len(values), bool)
    code, n = np.where(common, code, ~code), np.diff(at).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    code = code[np.lexsort((code, row))]
    size = np.where(n > 0, n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1, 0)
    kept = code[np.arange(len(code)) - at[row] < size[row]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(kept))


def set_prefixes(sets: DataFrame, threshold: float, common: list[int], held: DataFrame | None = None) -> DataFrame:
    """(gram, key, n, last) for the first n - ceil(threshold n) + 1 shingles of each set (key, grams); last is the last of them.

    Sets that reach the threshold share one of them. The order is that of heads_of(), the same for any set at any time for one list of common shingles,
    so an index of prefixes can grow. held: unique keys of the sets that count; heads travel to meet them, whole sets do not.
    """
    ship(sets.sparkSession)
    listed = np.sort(np.array(common, np.int64))

    def run(batches):
        for batch in batches:
            grams = batch.column("grams")
            yield pa.RecordBatch.from_arrays([batch.column("key"), pc.list_value_length(grams), heads_of(grams, threshold, listed)], ["key", "n", "head"])

    kind = sets.schema["key"].dataType.simpleString()
    cut = sets.select("key", "grams").mapInArrow(run, f"key {kind}, n int, head array<bigint>")
    cut = cut if held is None else cut.join(held, "key")
    return cut.select(F.explode("head").alias("gram"), "key", "n", F.element_at("head", -1).alias("last"))


def common_of_pairs(pairs: pa.Table, sets: pa.Table) -> np.ndarray:
    """How many shingles the sets of each pair (key, other) share; sets: set (its key) and sorted grams of every set that a pair names."""
    grams = sets.column("grams").combine_chunks()
    at, values = grams.offsets.to_numpy() - grams.offsets[0].as_py(), grams.values.to_numpy()[grams.offsets[0].as_py() : grams.offsets[-1].as_py()]
    left, right = (pc.index_in(pairs.column(c), sets.column("set")).to_numpy() for c in ("key", "other"))
    shared = np.zeros(len(left), np.int64)
    order = np.argsort(left, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(left[order])) + 1):
        if not len(rows):
            continue
        mine, sizes = values[at[left[rows[0]]] : at[left[rows[0]] + 1]], at[right[rows] + 1] - at[right[rows]]
        theirs = np.concatenate([values[at[o] : at[o + 1]] for o in right[rows]])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        shared[rows] = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return shared


def verified(close: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], threshold: float, work: int = CELL_WORK) -> DataFrame:
    """Pairs (key, other, jaccard) of close (key, other, n, m) that reach the threshold on whole sets (key, grams), or what gives the sets of keys.

    Only sets that a pair names are dealt. A pair does not carry sets: pairs that hang together by their smallest neighbour meet in a cell, and a set is sent once to each cell that compares it.
    Cells are sized by the shingles of their pairs; one with too many is divided by both keys of its pairs.
    """
    spark = close.sparkSession
    ship(spark)
    pairs = stored(close.select("key", "other", "n", "m"), "close-pairs")
    weight = (F.col("n") + F.col("m") + 16).cast("long")
    total = pairs.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    cells = max(parallelism(spark), 1 + total // work)
    least = F.least("key", "other").alias("least")
    lowest = pairs.select(F.col("key").alias("end"), least).unionByName(pairs.select(F.col("other").alias("end"), least)).groupBy("end").agg(F.min("least").alias("least"))
    met = pairs.join(lowest.select(F.col("end").alias("key"), F.col("least").alias("l")), "key").join(lowest.select(F.col("end").alias("other"), F.col("least").alias("r")), "other")
    placed = stored(met.select("key", "other", "n", "m", F.pmod(F.xxhash64(F.least("l", "r")), F.lit(cells)).alias("cell")), "placed-pairs")
    heavy = placed.groupBy("cell").agg(F.ceil(F.sqrt(F.sum(weight) / work)).cast("long").alias("parts")).where("parts > 1")
    side = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.coalesce("parts", F.lit(1).cast("long")))
    dealt = stored(placed.join(heavy, "cell", "left").select("cell", side("key").alias("i"), side("other").alias("j"), "key", "other", "n", "m"), "dealt-pairs")
    at = ["cell", "i", "j"]
    wanted = dealt.select(*at, "key").unionByName(dealt.select(*at, F.col("other").alias("key"))).distinct()
    kind = dealt.schema["key"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared = common_of_pairs(left, right) if left.num_rows else np.zeros(0, np.int64)
        n, m = (left.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
        score = shared / (n + m - shared)
        near = pa.array(np.flatnonzero(score >= threshold))
        return pa.table({"key": left.column("key").take(near), "other": left.column("other").take(near), "jaccard": pa.array(score).take(near)})

    ids = wanted.select("key").distinct()
    held = sets(ids) if callable(sets) else among(sets.select("key", "grams"), ids, "key")
    sent = wanted.join(held, "key").select(*[F.col(c).alias(f"to_{c}") for c in at], F.col("key").alias("set"), "grams")
    made = dealt.groupBy(*at).cogroup(sent.groupBy(*[f"to_{c}" for c in at])).applyInArrow(run, f"key {kind}, other {kind}, jaccard double")
    out = stored(made, "near-keys")
    discard(pairs, placed, dealt)
    return out


def near_keys(sets: DataFrame | Callable[[DataFrame], DataFrame], prefixes: DataFrame, threshold: float, postings: DataFrame | None = None) -> DataFrame:
    """Pairs (key, other) of different sets that reach the threshold: of those in prefixes (key < other), or of those with the sets in postings.

    Shared shingles of two prefixes are counted before any set is fetched. Of the set whose prefix ends first, all that is shared within its prefix
    lies in the other's prefix too, so what is counted and the rest of that set bound the overlap; few pairs are left to be verified on whole sets.
    """
    theirs = prefixes if postings is None else postings
    met = prefixes.join(theirs.select("gram", F.col("key").alias("other"), F.col("n").alias("m"), F.col("last").alias("other_last")), "gram")
    met = met.where((F.col("key") < F.col("other")) if postings is None else (F.col("key") != F.col("other")))
    met = met.where(F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9)
    counted = met.groupBy("key", "other", "n", "m", "last", "other_last").agg(F.count(F.lit(1)).alias("shared"))
    beyond = F.ceil(F.when(F.col("last") <= F.col("other_last"), F.col("n")).otherwise(F.col("m")) * threshold - 1e-9) - 1
    least = F.ceil((F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - 1e-9)
    close = counted.where(F.col("shared") + beyond >= least).select("key", "other", "n", "m")
    return verified(close, sets, threshold)


def _two_first(holders: DataFrame) -> DataFrame:
    """Of each key the first holder (ordinal and family) and the first of another family: enough to tell whether a row has one before it of another family."""
    each = holders.groupBy("key", "family").agg(F.min("ordinal").alias("ordinal"))
    one = each.groupBy("key").agg(F.min(F.struct("ordinal", "family")).alias("one"))
    rest = each.join(one, "key").where(~F.col("family").eqNullSafe(F.col("one.family"))).groupBy("key").agg(F.min("ordinal").alias("second"))
    return one.join(rest, "key", "left")


def first_holders(pairs: DataFrame, holders: DataFrame) -> DataFrame:
    """(key, one, second) over pairs (key, other): the first of the others' holders (key, family, ordinal), and the first of another family than that one's."""
    found = pairs.join(_two_first(holders).withColumnRenamed("key", "other"), "other")
    one = found.groupBy("key").agg(F.min("one").alias("least"))
    second = F.min(F.when(F.col("one.family").eqNullSafe(F.col("least.family")), F.col("second")).otherwise(F.col("one.ordinal")))
    return found.join(one, "key").groupBy("key").agg(F.first("least").alias("one"), second.alias("second"))


def preceded(hit: str) -> Column:
    """Whether a row (ordinal, family) comes after a holder of another family, by a struct of first_holders()' columns."""
    one = F.col(f"{hit}.one")
    first = F.when(one.family.eqNullSafe(F.col("family")), F.col(f"{hit}.second")).otherwise(one.ordinal)
    return F.coalesce(first < F.col("ordinal"), F.lit(False))


def _keyed(docs: DataFrame, id_col: str, text: Column, family: str | None, width: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, family, key) with a shingle set, whose key is the number of the first row with an equal one; sets (key, n, grams sorted) of all rows; and prefixes of the first ones.

    Whole sets are written once and not dealt by content: equal sets meet by 128 bits, and only their prefixes go on.
    """
    grams = F.sort_array(X.gram_hashes(text, width))
    hashed = docs.select(F.col(id_col).alias("id"), F.col(family).alias("family") if family else F.lit(None).cast("string").alias("family"), grams.alias("grams")).where("size(grams) > 0")
    same = F.struct(F.xxhash64("grams").alias("a"), F.xxhash64(F.lit(7), F.col("grams")).alias("b")).alias("same")
    sets = stored(hashed.select("id", "family", same, F.monotonically_increasing_id().alias("key"), F.size("grams").alias("n"), "grams"), "shingle-sets")
    first = sets.groupBy("same").agg(F.min("key").alias("first"))
    rows = stored(sets.select("id", "family", "same").join(first, "same").select("id", "family", F.col("first").alias("key")), "set-rows")
    held = first.select(F.col("first").alias("key"))
    common = common_grams(sets, held)
    return rows, sets.select("key", "n", "grams"), stored(set_prefixes(sets, threshold, common, held), "set-prefixes")


def near_pairs(docs: DataFrame, id_col: str, text: Column, threshold: float, family: str | None = None, width: int = 5) -> DataFrame:
    """Pairs (left_id < right_id) whose shingle sets reach the threshold, of different families if given. Equal sets are compared once and expanded to rows at the end."""
    rows, sets, prefixes = _keyed(docs, id_col, text, family, width, threshold)
    one = near_keys(sets, prefixes, threshold)
    pairs = one.unionByName(one.select(F.col("other").alias("key"), F.col("key").alias("other"), "jaccard"))
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("key").alias("other"), F.lit(1.0).alias("jaccard"))
    left, right = (rows.select(F.col("id").alias(f"{s}_id"), F.col("family").alias(f"{s}_family"), F.col("key").alias(k)) for s, k in (("left", "key"), ("right", "other")))
    met = pairs.unionByName(repeated).join(left, "key").join(right, "other").where("left_id < right_id")
    return (met.where("not (left_family <=> right_family)") if family else met).select("left_id", "right_id", "jaccard")


def near_representatives(docs: DataFrame, id_col: str, text: Column, threshold: float, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows (id, first) with a shingle set and the smallest id of an equal set, and pairs (early, late) of such first ids whose sets reach the threshold. Copies are not paired."""
    rows, sets, prefixes = _keyed(docs, id_col, text, None, width, threshold)
    first = stored(rows.groupBy("key").agg(F.min("id").alias("first")), "set-firsts")
    one = near_keys(sets, prefixes, threshold)
    met = one.join(first.withColumnRenamed("first", "a"), "key").join(first.select(F.col("key").alias("other"), F.col("first").alias("b")), "other")
    return rows.join(first, "key").select("id", "first"), met.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"))


def near_earlier(docs: DataFrame, id_col: str, text: Column, threshold: float, family: str, width: int = 5) -> DataFrame:
    """Ids of rows with a near row of a smaller id in another family. No pair of rows is formed: of the rows of a set, the first and the first of another family tell."""
    rows, sets, prefixes = _keyed(docs, id_col, text, family, width, threshold)
    one = near_keys(sets, prefixes, threshold).select("key", "other")
    same = rows.select("key", F.col("key").alias("other")).distinct()
    pairs = one.unionByName(one.select(F.col("other").alias("key"), F.col("key").alias("other"))).unionByName(same)
    holders = rows.withColumnRenamed("id", "ordinal")
    hit = first_holders(pairs, holders).select("key", F.struct("one", "second").alias("near"))
    return holders.join(hit, "key").where(preceded("near")).select(F.col("ordinal").alias(id_col))


def source_similar(rows: DataFrame, source: Column, query: Column, response: Column, threshold: float = 0.5) -> Column:
    """Whether query, response or both together equal a row's own source text or share enough of its shingles."""
    same = lambda c: X.squeeze(X.fold(source)).eqNullSafe(X.squeeze(X.fold(c)))
    close = lambda c: X.jaccard(X.grams(source), X.grams(c)) >= threshold
    views = (query, F.coalesce(response, query), X.combined(query, response))
    found = F.lit(False)
    for view in views:
        found = found | same(view) | close(view)
    return source.isNotNull() & found


def greedy_accept(rows: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Keeps rows in id order unless an earlier kept row conflicts. edges: (early, late) pairs.

    Rounds: a row without an undecided or kept earlier neighbour is kept; a neighbour of an earlier kept row goes. Each round
    decides at least the first undecided row of every conflict group, so rounds follow the longest chain.
    """
    open_edges = stored(edges.select("early", "late").distinct(), "edges")
    state = stored(rows.select(F.col(id_col).alias("id")).withColumn("kept", F.lit(None).cast("boolean")), "greedy")
    while True:
        undecided = state.where("kept is null").select("id")
        blocked = open_edges.join(undecided.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct()
        lost = open_edges.join(state.where("kept").select(F.col("id").alias("early")), "early", "left_semi").select(F.col("late").alias("id")).distinct()
        made = stored(
            state.join(lost.withColumn("lost", F.lit(True)), "id", "left").join(blocked.withColumn("wait", F.lit(True)), "id", "left")
            .select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("lost"), False).when(F.col("wait").isNull(), True).alias("kept")), "greedy",
        )
        discard(state)
        state = made
        if state.where("kept is null").isEmpty():
            discard(open_edges)
            return state.withColumnRenamed("id", id_col)
