"""Requests, replies and the generation loop around an injected provider: planning and gating are tables, only the provider is a function.

A provider is any function from a pandas frame of requests to one of replies; it runs in mapInPandas, one batch a call. No
network client is part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import text as X
from ..runtime import cut, ship
from .joins import complete_join, source_lookup

#: Terminal codes of a run, and exit codes.
EXIT = {"complete": 0, "incomplete": 2, "quality_fail": 3}
REPAIRABLE = ("output_grammar", "answer_format", "slow_structure", "slow_rule_evidence", "slow_rule_order", "slow_verdict_consistency")


def batches(blueprints: DataFrame, size: int = 4) -> DataFrame:
    """Blueprints in batches of at most four by ordinal."""
    if not 1 <= size <= 4:
        raise ValueError("a batch holds 1 to 4 rows")
    return blueprints.withColumn("batch", F.expr(f"cast((ordinal - 1) div {size} as long)"))


def content_requests(blueprints: DataFrame, policies: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Requests: every blueprint with its policy, which must exist once, and its source text where it has a source."""
    rows = complete_join(blueprints, policies, ["policy_id"]).withColumn("source_text", F.lit(None).cast("string"))
    return source_lookup(rows.drop("source_text"), texts) if texts is not None else rows


def review_requests(candidates: DataFrame, policies: DataFrame) -> DataFrame:
    """Blind review: candidates with their policy and none of the targets. The explicit columns are a boundary, not a speed-up."""
    return candidates.select("blueprint_id", "policy_id", "query", "response").join(policies.select("policy_id", "rules"), "policy_id")


def parse_replies(replies: DataFrame, reply: str, expected: str, schema: str) -> DataFrame:
    """Items of batch replies: a reply counts only if it is a list of 1 to 4 whose ids are exactly those expected; code is null for its items, else parse_invalid_batch."""
    items = F.from_json(F.col(reply), f"array<{schema}>")
    ids = F.transform(items, lambda x: x["blueprint_id"])
    sound = items.isNotNull() & F.size(items).between(1, 4) & (F.array_sort(ids) == F.array_sort(F.col(expected)))
    return replies.select("*", F.explode(F.when(sound, F.transform(items, lambda x: F.struct(x["blueprint_id"].alias("blueprint_id"), x.alias("item"), F.lit(None).cast("string").alias("code")))).otherwise(
        F.transform(F.col(expected), lambda i: F.struct(i.alias("blueprint_id"), F.lit(None).cast(schema).alias("item"), F.lit("parse_invalid_batch").alias("code")))
    )).alias("x")).select("*", "x.*").drop("x")


def verdict_code(label: Column, answers: Column, wanted_label: Column, wanted_answers: Column) -> Column:
    """A review's outcome: invalid if label and answers do not fit each other, a mismatch if they differ from the plan, else accepted."""
    valid = F.when(label == "safe", F.size(answers) == 0).when(label == "unsafe", (F.size(answers) > 0) & (F.size(F.array_distinct(answers)) == F.size(answers)))
    return F.when(~F.coalesce(valid, F.lit(False)), "semantic_review_invalid").when((label != wanted_label) | (answers != wanted_answers), "semantic_mismatch").otherwise("accepted")


def ask(requests: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Replies of an injected provider."""
    ship(requests.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield provider(frame)

    return requests.mapInPandas(run, schema)


def run_rounds(blueprints: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], gate: Callable[[DataFrame], Column], most_attempts: int = 3) -> DataFrame:
    """Generate, gate and retry in rounds: blueprint_id, attempt, query, response and code of the last try.

    Equal candidates are settled in ordinal order against all accepted before, within a batch too: the rule that a resumed run
    would follow.
    """
    if not 1 <= most_attempts <= 3:
        raise ValueError("1 to 3 attempts")
    pending, accepted, refused = blueprints, None, None
    for attempt in range(1, most_attempts + 1):
        made = cut(_gated(pending, provider, gate))
        key = F.sha2(X.canonical(F.col("query"), F.col("response")), 256)
        fresh = made.where("code = 'accepted'").withColumn("key", key)
        first = F.row_number().over(Window.partitionBy("key").orderBy("ordinal")) == 1
        fresh = fresh.withColumn("first", first)
        if accepted is not None:
            fresh = fresh.join(accepted.select("key").distinct().withColumn("known", F.lit(True)), "key", "left")
        else:
            fresh = fresh.withColumn("known", F.lit(None).cast("boolean"))
        fresh = cut(fresh.withColumn("code", G.first_failure((~F.col("first") | F.coalesce("known", F.lit(False)), "exact_duplicate"))).withColumn("attempt", F.lit(attempt)))
        kept = fresh.where("code = 'accepted'").select("blueprint_id", "ordinal", "attempt", "query", "response", "code", "key")
        accepted = kept if accepted is None else accepted.unionByName(kept)
        lost = made.where("code <> 'accepted'").withColumn("attempt", F.lit(attempt)).select("blueprint_id", "attempt", "query", "response", "code")
        refused = lost.unionByName(fresh.where("code <> 'accepted'").select("blueprint_id", "attempt", "query", "response", "code"))
        pending = pending.join(accepted.select("blueprint_id"), "blueprint_id", "left_anti")
        if pending.isEmpty():
            break
    done = accepted.select("blueprint_id", "attempt", "query", "response", "code")
    return done.unionByName(refused.join(done.select("blueprint_id"), "blueprint_id", "left_anti"))


def _gated(pending: DataFrame, provider, gate) -> DataFrame:
    made = ask(pending, provider, "blueprint_id string, query string, response string")
    rows = made.join(pending, "blueprint_id")
    return rows.withColumn("code", gate(rows))


def tool_replay(samples: DataFrame, called: str = "called", wanted: str = "tool_names", policy: str = "tool_policy", most: int = 2) -> DataFrame:
    """Code of each sample's tool calls: required calls come exactly in order, optional ones are allowed, none exceeds the limit."""
    code = G.first_failure(
        (F.size(called) > most, "too_many_tool_calls"),
        ((F.col(policy) == "required") & (F.col(called) != F.col(wanted)), "required_tool_order"),
        (F.size(F.array_except(called, wanted)) > 0, "tool_not_allowed"),
    )
    return samples.withColumn("tool_code", code)


def manifest_status(blueprints: DataFrame, outcome: DataFrame) -> DataFrame:
    """Counts of accepted, rejected and pending blueprints, the status, and its exit code."""
    rows = blueprints.select("blueprint_id").join(outcome.select("blueprint_id", "code"), "blueprint_id", "left")
    counts = rows.agg(F.count_if(F.col("code") == "accepted").alias("accepted"), F.count_if(F.col("code").isNotNull() & (F.col("code") != "accepted")).alias("rejected"), F.count_if(F.col("code").isNull()).alias("pending"))
    status = F.when(F.col("accepted") == F.col("accepted") + F.col("rejected") + F.col("pending"), "complete").otherwise("incomplete")
    return counts.withColumn("status", status).withColumn("exit_code", F.when(status == "complete", EXIT["complete"]).otherwise(EXIT["incomplete"]))


def quality_status(samples: DataFrame, finished: Column, expected: Column, met: Column) -> DataFrame:
    """incomplete, not_evaluated, pass or fail of a run of samples."""
    counts = samples.agg(F.bool_and(finished).alias("f"), F.count_if(expected).alias("e"), F.count_if(expected & met).alias("m"))
    return counts.select(F.when(~F.col("f"), "incomplete").when(F.col("e") == 0, "not_evaluated").when(F.col("e") == F.col("m"), "pass").otherwise("fail").alias("status"))
