"""Queries of whole runs: event logs, budgets, generation with an index, and stored runs. Their inputs are derived from the driver's tables by Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import automaton, capped, query_run, settlement, similarity
from ..runtime import scratch_path, ship, stored, table
from ..sources.commits import CommitLog
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(make):
        QUERIES[make.__name__] = make
        if oracle:
            ORACLE_SQL[make.__name__] = oracle
        return make

    return add


# --- event logs ---------------------------------------------------------------------------------------------------

#: A log for each user: kinds by event_id, the first row mostly `initialize`, counts by event_id, and every 19th to 97th row broken in one way.
_LOG = """WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place,
  lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
b AS (SELECT *, CASE WHEN place = 1 AND user_id % 11 <> 0 THEN 'initialize' WHEN event_id % 83 = 0 THEN 'initialize' WHEN event_id % 89 = 0 THEN 'unknown'
  WHEN event_id % 10 < 5 THEN 'batch_complete' WHEN event_id % 10 < 7 THEN 'batch_rejected' WHEN event_id % 10 = 7 THEN 'provider_stop' ELSE 'resume' END AS event FROM a),
c AS (SELECT *, CASE WHEN event IN ('batch_complete', 'batch_rejected', 'provider_stop') THEN CASE WHEN event_id % 61 = 0 THEN 5 WHEN event_id % 67 = 0 THEN 0 ELSE 1 + event_id % 4 END END AS batch_count FROM b),
d AS (SELECT *, CASE WHEN event = 'batch_complete' THEN CASE WHEN event_id % 71 = 0 THEN batch_count + 1 ELSE event_id % (1 + batch_count) END END AS accepted_count FROM c),
log AS (SELECT event_id, user_id, CASE WHEN event_id % 97 = 0 THEN place + 1 ELSE place END AS sequence, event,
  CASE event WHEN 'initialize' THEN 'fresh' WHEN 'resume' THEN 'validated' WHEN 'batch_rejected' THEN 'parse_invalid_batch' WHEN 'batch_complete' THEN CASE WHEN event_id % 73 = 0 THEN 'fresh' ELSE 'gated' END
    WHEN 'provider_stop' THEN CASE WHEN event_id % 2 = 0 THEN 'budget_exceeded' ELSE 'provider_request' END ELSE 'fresh' END AS code, batch_count, accepted_count,
  CASE WHEN event = 'resume' THEN CASE WHEN event_id % 19 = 0 THEN 1000001 WHEN event_id % 3 = 0 THEN 7
    ELSE coalesce(sum(accepted_count) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END END AS completed_count, place FROM d)"""

_LOG_SQL = _LOG + """,
e AS (SELECT *, CASE WHEN event = 'unknown' THEN 'event_type' WHEN sequence <> place OR (event = 'batch_complete' AND code <> 'gated') THEN 'event_schema' END AS shape,
  CASE WHEN NOT batch_count BETWEEN 1 AND 4 THEN 'batch_count' WHEN NOT completed_count BETWEEN 0 AND 1000000 THEN 'completed_count' WHEN NOT accepted_count BETWEEN 0 AND batch_count THEN 'accepted_count' END AS counts FROM log),
f AS (SELECT *, CASE WHEN place = 1 THEN 'new' WHEN coalesce(last_value(CASE WHEN shape IS NULL AND counts IS NULL AND event IN ('resume', 'provider_stop') THEN event END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'provider_stop' THEN 'stopped' ELSE 'open' END AS state FROM e),
g AS (SELECT *, coalesce(sum(CASE WHEN shape IS NULL AND counts IS NULL AND state = 'open' AND event = 'batch_complete' THEN accepted_count ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS counted FROM f),
h AS (SELECT *, coalesce(shape, CASE state WHEN 'new' THEN CASE WHEN event <> 'initialize' THEN 'must_begin_with_initialize' END WHEN 'open' THEN CASE WHEN event = 'initialize' THEN 'initialize_out_of_order' END
  ELSE CASE WHEN event <> 'resume' THEN 'must_follow_stop' END END, counts, CASE WHEN event = 'resume' AND completed_count <> counted THEN 'completed_unreachable' END) AS fault FROM g)"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """The log above as a frame: event_id, user_id, sequence, event, code and counts. Its window only makes an input; the checks need none."""
    events = table(spark, d, "events").select("event_id", "user_id")
    rows = spark.sql(_LOG.replace("FROM events)", "FROM {events})") + " SELECT * FROM log", events=events)
    return rows.select("event_id", "user_id", F.col("sequence").cast("long").alias("sequence"), "event", "code", *[F.col(c).cast("long").alias(c) for c in automaton.COUNTS])


@query(_LOG_SQL + " SELECT event_id, user_id, place, state, counted, fault FROM h")
def event_automaton(spark, d):
    """Every event's state and fault, of all users' logs."""
    return automaton.event_automaton(event_log(spark, d), "user_id", ["event_id"], F.lit(1_000_000)).select("event_id", "user_id", "place", "state", "counted", "fault")


@query(_LOG_SQL + """, m AS (SELECT user_id, min(place) AS fault_place, min_by(fault, place) AS fault FROM h WHERE fault IS NOT NULL GROUP BY user_id),
n AS (SELECT h.user_id, count(*) AS n_events, any_value(m.fault) AS fault, any_value(m.fault_place) AS fault_place,
  coalesce(sum(accepted_count) FILTER (place < coalesce(fault_place, place + 1) AND event = 'batch_complete'), 0)::BIGINT AS accepted,
  coalesce(sum(batch_count) FILTER (place < coalesce(fault_place, place + 1) AND event IN ('batch_complete', 'batch_rejected')), 0)::BIGINT AS attempted FROM h LEFT JOIN m USING (user_id) GROUP BY h.user_id)
SELECT *, attempted - accepted AS rejected FROM n""")
def event_log_totals(spark, d):
    """What a reader gets of each log up to its first fault."""
    checked = automaton.event_automaton(event_log(spark, d), "user_id", ["event_id"], F.lit(1_000_000))
    return automaton.log_totals(checked, "user_id")


# --- budgets ------------------------------------------------------------------------------------------------------

_CAPS = settlement.Caps(requests=24, cost=120_000, patience=20 * 3600 * 1_000_000)

#: Two of three entries of a user reserve; a record is for the reservation one or four entries before it, or after it, and some never come.
_ENTRIES = """WITH a AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 IN (0, 1, 3) THEN 'reserve' ELSE 'record' END AS kind,
  lag(event_id, 1) OVER w AS before1, lag(event_id, 4) OVER w AS before4, lead(event_id, 1) OVER w AS after1, CAST(floor(abs(value) * 100) AS BIGINT) AS v
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
entries AS (SELECT event_id, user_id, ts, kind, CASE WHEN kind = 'reserve' THEN event_id WHEN event_id % 7 < 4 THEN before1 WHEN event_id % 7 < 6 THEN before4 ELSE after1 END AS request,
  CASE WHEN kind = 'reserve' THEN CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN -5 WHEN event_id % 107 = 0 THEN 0 ELSE 4000 + v % 5000 END
    ELSE CASE WHEN event_id % 97 = 2 THEN NULL WHEN event_id % 89 = 2 THEN 20000 WHEN event_id % 83 = 2 THEN -1 ELSE v % 4000 END END AS amount,
  CASE WHEN kind = 'record' THEN event_id % 113 <> 2 END AS complete FROM a)"""

_SETTLE_SQL = "WITH RECURSIVE " + _ENTRIES.removeprefix("WITH ") + f""",
e AS (SELECT *, epoch_us(ts) AS due, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM entries),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS place, NULL::BIGINT AS number, NULL::VARCHAR AS code, 0::BIGINT AS requests, 0::BIGINT AS spent, true AS complete,
  []::STRUCT(id BIGINT, amount BIGINT, since BIGINT)[] AS opened, []::STRUCT(id BIGINT, amount BIGINT, since BIGINT)[] AS charged FROM e
UNION ALL
SELECT user_id, place, number, code, requests + (code = 'granted')::BIGINT,
  spent + CASE WHEN NOT took OR kind = 'reserve' THEN 0 WHEN amount IS NULL THEN CASE WHEN late THEN 0 ELSE held END ELSE amount - CASE WHEN late THEN held ELSE 0 END END,
  complete AND (NOT took OR kind = 'reserve' OR coalesce(fine AND amount <= held, false)),
  CASE WHEN code = 'granted' THEN list_append(opened, {{'id': request, 'amount': amount, 'since': due}}) WHEN took THEN list_filter(opened, lambda g: g.id <> request) ELSE opened END,
  CASE WHEN took THEN list_filter(charged, lambda g: g.id <> request) ELSE charged END
FROM (SELECT *, CASE WHEN kind = 'reserve' THEN CASE WHEN held IS NOT NULL THEN 'duplicate_request' WHEN requests >= {_CAPS.requests} THEN 'max_requests'
      WHEN NOT complete OR coalesce(amount, 0) = 0 THEN 'cost_accounting_incomplete' WHEN amount < 0 THEN 'invalid_amount'
      WHEN spent + coalesce(list_sum([g.amount for g in opened]), 0) + amount > {_CAPS.cost} THEN 'max_estimated_cost' ELSE 'granted' END
    WHEN held IS NULL THEN 'no_open_reservation' WHEN amount < 0 THEN 'invalid_amount' WHEN amount IS NULL THEN 'cost_accounting_incomplete' WHEN amount > held THEN 'cost_reservation_exceeded'
    WHEN spent + amount - CASE WHEN late THEN held ELSE 0 END > {_CAPS.cost} THEN 'max_estimated_cost' WHEN late THEN 'settled_late' ELSE 'settled' END AS code,
    kind = 'record' AND held IS NOT NULL AND NOT coalesce(amount < 0, false) AS took
  FROM (SELECT *, len(list_filter(charged, lambda g: g.id = request)) > 0 AS late, coalesce(list_filter(opened, lambda g: g.id = request)[1].amount, list_filter(charged, lambda g: g.id = request)[1].amount) AS held
    FROM (SELECT r.user_id, e.place, e.event_id AS number, e.kind, e.request, e.amount, coalesce(e.complete, true) AS fine, e.due, r.requests, r.complete,
        r.spent + coalesce(list_sum([g.amount for g in r.opened if g.since + {_CAPS.patience} < e.due]), 0)::BIGINT AS spent,
        list_filter(r.opened, lambda g: g.since + {_CAPS.patience} >= e.due) AS opened, list_concat(r.charged, list_filter(r.opened, lambda g: g.since + {_CAPS.patience} < e.due)) AS charged
      FROM r JOIN e ON e.user_id = r.user_id AND e.place = r.place + 1))))
SELECT number AS event_id, user_id, code, requests, spent::BIGINT AS spent, coalesce(list_sum([g.amount for g in opened]), 0)::BIGINT AS reserved, complete AS accounting_complete FROM r WHERE place > 0"""


def budget_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries above, with their event time; the window only makes an input."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    rows = spark.sql(_ENTRIES.replace("FROM events", "FROM {events}") + " SELECT * FROM entries", events=events)
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    return rows.select("user_id", at.alias("at"), F.col("event_id").alias("number"), "kind", F.col("request").cast("string").alias("request"), F.col("amount").cast("long").alias("amount"), "complete")


@query(_SETTLE_SQL)
def budget_settlement(spark, d):
    """Every entry's code and its budget's totals after it: grants, costs in time, late or never, and records that come before their request."""
    made = settlement.settle(budget_entries(spark, d), "user_id", _CAPS)
    return made.select(F.col("number").alias("event_id"), "user_id", "code", "requests", "spent", "reserved", "accounting_complete")


# --- generation ---------------------------------------------------------------------------------------------------

#: Replies stand in the tables: the text at the first attempt, the text with other letters at the second. Some batches cannot be parsed, some reviews disagree.
_RUN_SQL = """WITH RECURSIVE n AS (SELECT count(*) AS total, max(doc_id) + 1 AS most FROM documents),
c AS (SELECT (a.attempt - 1) * most + doc_id + 1 AS rid, doc_id + 1 AS ordinal, a.attempt, doc_id // 4 AS batch, source, CASE a.attempt WHEN 1 THEN text ELSE translate(text, 'et', 'iz') END AS text, total
  FROM documents, (VALUES (1), (2)) a(attempt), n),
l AS (SELECT *, CASE WHEN batch % 29 = 3 AND attempt = 1 THEN 'parse_invalid_batch' WHEN NOT (coalesce({english} >= 0.8, false) AND regexp_matches(text, '[A-Za-z]')) THEN 'wrong_language' END AS local FROM c),
p AS MATERIALIZED (SELECT rid, ordinal, source, {key} AS k, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM (SELECT *, {tokens} AS t FROM l WHERE local IS NULL)),
b AS (SELECT item_id + 1 AS ordinal, {key} AS k, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM (SELECT *, {tokens} AS t FROM benchmark)),
u AS (SELECT p.rid FROM p JOIN b USING (ordinal) WHERE p.k = b.k OR (len(p.s) > 0 AND len(b.s) > 0 AND 2 * len(list_intersect(p.s, b.s)) >= len(p.s) + len(b.s) - len(list_intersect(p.s, b.s)))),
g AS MATERIALIZED (SELECT rid, source, unnest(s) AS s FROM p),
o AS (SELECT x.rid AS x, y.rid AS y, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.rid < y.rid AND x.source IS DISTINCT FROM y.source GROUP BY x.rid, y.rid),
near AS (SELECT y AS rid, list(x) AS near FROM o JOIN p a ON a.rid = x JOIN p b ON b.rid = y WHERE i >= 0.85 * (len(a.s) + len(b.s) - i) GROUP BY y),
same AS (SELECT y.rid, list(x.rid) AS same FROM p x JOIN p y ON x.k = y.k AND x.rid < y.rid GROUP BY y.rid),
r AS MATERIALIZED (SELECT l.rid, l.ordinal, l.attempt, l.attempt * 1000000000 + l.batch AS batch, l.local, coalesce(same, []) AS same, coalesce(near, []) AS near, u.rid IS NOT NULL AS copied,
    CASE WHEN l.batch % 31 = 7 THEN 'semantic_review_invalid' WHEN l.ordinal % 13 = 5 AND l.attempt = 1 THEN 'semantic_mismatch' END AS verdict, (total * 7 // 10) AS cap, row_number() OVER (ORDER BY l.rid) AS turn
  FROM l LEFT JOIN same USING (rid) LEFT JOIN near USING (rid) LEFT JOIN u USING (rid)),
w AS (SELECT 0::BIGINT AS turn, 0::BIGINT AS ordinal, 0 AS attempt, NULL::VARCHAR AS code, []::BIGINT[] AS won, 0::BIGINT AS asked, 0::BIGINT AS batch, false AS stopped
UNION ALL SELECT turn, ordinal, attempt, code, CASE WHEN code = 'accepted' THEN list_append(won, rid) ELSE won END, asked, batch, stopped
FROM (SELECT *, CASE WHEN NOT takes THEN NULL WHEN local IS NOT NULL THEN local WHEN list_has_any(same, won) THEN 'exact_duplicate' WHEN copied THEN 'source_too_similar' WHEN list_has_any(near, won) THEN 'near_duplicate'
      ELSE coalesce(verdict, 'accepted') END AS code
  FROM (SELECT r.rid, r.turn, r.ordinal, r.attempt, r.local, r.same, r.near, r.copied, r.verdict, w.won,
      NOT w.stopped AND NOT (r.attempt = 2 AND list_contains(w.won, r.ordinal)) AND (w.batch = r.batch OR 2 * (w.asked + 1) <= r.cap) AS takes,
      w.asked + (NOT w.stopped AND NOT (r.attempt = 2 AND list_contains(w.won, r.ordinal)) AND w.batch <> r.batch AND 2 * (w.asked + 1) <= r.cap)::BIGINT AS asked,
      CASE WHEN w.stopped OR (r.attempt = 2 AND list_contains(w.won, r.ordinal)) THEN w.batch ELSE r.batch END AS batch,
      w.stopped OR (NOT (r.attempt = 2 AND list_contains(w.won, r.ordinal)) AND w.batch <> r.batch AND 2 * (w.asked + 1) > r.cap) AS stopped
    FROM w JOIN r ON r.turn = w.turn + 1))),
z AS (SELECT ordinal, max(attempt) FILTER (code IS NOT NULL) AS attempts, max_by(code, attempt) FILTER (code IS NOT NULL) AS code FROM w WHERE turn > 0 GROUP BY ordinal)
SELECT ordinal - 1 AS doc_id, CASE WHEN code = 'accepted' THEN 'accepted' WHEN attempts >= 2 THEN 'rejected' ELSE 'pending' END AS status, coalesce(attempts, 0)::BIGINT AS attempts, code FROM z"""


def generation_run(spark: SparkSession, d: str) -> tuple[DataFrame, query_run.Run]:
    """The plan and the functions of the run above."""
    ship(spark)
    docs = table(spark, d, "documents")
    plan = docs.select((F.col("doc_id") + 1).alias("ordinal"), F.col("source").alias("family"), F.lit("p").alias("policy_id"))
    texts = docs.select((F.col("doc_id") + 1).alias("ordinal"), "text")
    items = table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("ordinal"), F.col("text").alias("source_text"))

    def provide(rows: DataFrame) -> DataFrame:
        query = F.when(F.col("attempt") == 1, F.col("text")).otherwise(F.translate("text", "et", "iz"))
        # Only a step's range of texts is dealt, not the whole table at every step.
        low, high = rows.agg(F.min("ordinal"), F.max("ordinal")).first()
        return rows.join(texts.where(F.col("ordinal").between(low, high)), "ordinal").select("ordinal", query.alias("query"), F.lit(None).cast("string").alias("response"), (~((F.col("batch") % 29 == 3) & (F.col("attempt") == 1))).alias("valid"))

    def review(rows: DataFrame) -> DataFrame:
        return rows.select("ordinal", F.when(F.col("batch") % 31 == 7, "semantic_review_invalid").when((F.col("ordinal") % 13 == 5) & (F.col("attempt") == 1), "semantic_mismatch").alias("verdict"))

    def copied(rows: DataFrame) -> DataFrame:
        met = rows.join(items, "ordinal")
        return met.where(similarity.source_similar(met, F.col("source_text"), F.col("query"), F.col("response")))

    gate = lambda rows: F.when(X.is_english(F.col("query")), "accepted").otherwise("wrong_language")
    return plan, query_run.Run(provide, gate, review, copied, attempts=2, requests=docs.count() * 7 // 10)


@query(_RUN_SQL.format(english=sql.ENGLISH.format("text"), key=sql.SQUEEZE.format(sql.FOLD.format("text")), tokens=sql.TOKENS.format("text")))
def query_run_outcome(spark, d):
    """Status, attempts and last code of every planned row of a run: near duplicates by an index that grows, source copies, blind review, and a budget that ends."""
    plan, run = generation_run(spark, d)
    log = CommitLog(spark, scratch_path(spark, "run"), query_run.SCHEMAS)
    query_run.run_queries(plan, run, log)
    return query_run.outcome(plan, log, run.attempts).select((F.col("ordinal") - 1).alias("doc_id"), "status", "attempts", "code")


@query(ORACLE_SQL["query_run_outcome"])
def resume_state(spark, d):
    """The same run, broken off at half its budget, verified and taken up again: rows, attempts and codes are those of an unbroken one."""
    plan, run = generation_run(spark, d)
    log = CommitLog(spark, scratch_path(spark, "run"), query_run.SCHEMAS)
    query_run.run_queries(plan, replace(run, requests=run.requests // 2), log)
    if log.verify() or not query_run.run_faults(plan, log, run).where("n > 0").isEmpty():
        raise RuntimeError("the stored run is not sound")
    query_run.run_queries(plan, run, log)
    return query_run.outcome(plan, log, run.attempts).select((F.col("ordinal") - 1).alias("doc_id"), "status", "attempts", "code")


# --- caps ---------------------------------------------------------------------------------------------------------

_BATCH_CAPS = {"records": 650, "requests": 1300, "cost": 1_700_000}
_CAPPED_SQL = f"""WITH l AS (SELECT l_suppkey % 97 AS batch, l_orderkey, l_linenumber, 1 + l_linenumber % 3 AS requests, CAST(floor(l_quantity * 100) AS BIGINT) AS cost FROM lineitem),
s AS (SELECT *, row_number() OVER w AS idx, sum(requests) OVER w AS r, sum(cost) OVER w AS c FROM l WINDOW w AS (PARTITION BY batch ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, CASE WHEN idx > {_BATCH_CAPS["records"]} THEN 'max_records' WHEN r > {_BATCH_CAPS["requests"]} THEN 'max_requests' WHEN c > {_BATCH_CAPS["cost"]} THEN 'max_cost' END AS reason FROM s),
o AS (SELECT batch, count(*) AS n_rows, count(*) FILTER (reason IS NULL) AS done, min_by(reason, idx) FILTER (reason IS NOT NULL) AS reason FROM d GROUP BY batch)"""


@query(_CAPPED_SQL + " SELECT o.batch, n_rows, done, o.reason, o.reason IS NULL AS published, CASE WHEN o.reason IS NULL THEN (SELECT sum(cost)::BIGINT FROM d WHERE d.batch = o.batch) END AS published_cost FROM o")
def capped_batches(spark, d):
    """Batches under three caps, published whole or not at all, and what the published folder then holds."""
    line = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 97).alias("batch"), "l_orderkey", "l_linenumber", (1 + F.col("l_linenumber") % 3).cast("long").alias("requests"), F.floor(F.col("l_quantity") * 100).cast("long").alias("cost")
    )
    decided = stored(capped.capped(line, "batch", ["l_orderkey", "l_linenumber"], _BATCH_CAPS), "capped")
    path = scratch_path(spark, "published")
    outcomes = capped.publish(decided, "batch", path)
    if outcomes.where("published").isEmpty():
        return outcomes.withColumn("published_cost", F.lit(None).cast("long"))
    held = spark.read.schema(line.schema).parquet(path).groupBy("batch").agg(F.sum("cost").alias("published_cost"))
    return outcomes.join(held, "batch", "left")


_ALLOCATION_SQL = """WITH c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS place, CASE WHEN hash_place % 4 = 1 THEN 3 WHEN hash_place % 4 = 2 THEN 40 ELSE 100000 END AS most
  FROM (SELECT *, dense_rank() OVER (ORDER BY source) AS hash_place FROM documents) GROUP BY source, hash_place),
t AS (SELECT *, greatest((SELECT count(*) * 6 // 10 FROM documents) - coalesce(sum(least(n, most)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS remaining FROM c),
a AS (SELECT source, place, n, most, least(n, most, remaining)::BIGINT AS taken, CASE WHEN remaining = 0 THEN 'skipped' WHEN most > remaining THEN 'truncated' ELSE 'whole' END AS status FROM t)"""


def _allocation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy("source"))  # the sources' table is the configuration here
    most = F.when(F.col("place") % 4 == 1, 3).when(F.col("place") % 4 == 2, 40).otherwise(100_000).cast("long")
    configured = counts.withColumn("place", place.cast("long")).withColumn("most", most)
    return docs, stored(capped.allocate(configured, docs.count() * 6 // 10), "allocation")


@query(_ALLOCATION_SQL + " SELECT source, place, n, most::BIGINT AS most, taken, status FROM a")
def import_allocation(spark, d):
    """What one global cap leaves to each source in turn, and which are truncated or skipped."""
    return _allocation(spark, d)[1]


@query(_ALLOCATION_SQL + """, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT doc_id, source, idx FROM r JOIN a USING (source) WHERE idx < taken""")
def import_rows(spark, d):
    """The rows that the allocation takes."""
    docs, allocation = _allocation(spark, d)
    return capped.allocated_rows(docs, allocation, ["doc_id"]).select("doc_id", "source", "idx")
