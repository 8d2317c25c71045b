"""Scoring of decisions: accuracy, policy following over pairs, and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def policy_following(rows: DataFrame, group: Column, right: Column) -> DataFrame:
    """Per group the pairs of rows and how many have both predictions right; a single row counts as itself.

    Of n rows with c right there are n(n-1)/2 pairs and c(c-1)/2 right ones, so no pair is formed.
    """
    counted = rows.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(right.cast("long")).alias("c"))
    pairs = lambda x: F.when(F.col("n") == 1, F.col(x)).otherwise(F.expr(f"{x} * ({x} - 1) div 2"))
    return counted.select("g", "n", pairs("n").alias("comparisons"), pairs("c").alias("matches"))


def evaluate(rows: DataFrame, group: Column, label: str, predicted: str, rule: str, predicted_rule: str) -> DataFrame:
    """One row of label_accuracy, rule_exact_match (two nulls match) and policy_following_accuracy; no row for no input."""
    right = F.col(label) == F.col(predicted)
    exact = rows.agg(F.avg(right.cast("double")).alias("label_accuracy"), F.avg(F.col(rule).eqNullSafe(F.col(predicted_rule)).cast("double")).alias("rule_exact_match"))
    follow = policy_following(rows, group, right).agg((F.sum("matches") / F.sum("comparisons")).alias("policy_following_accuracy"))
    return exact.join(F.broadcast(follow), F.lit(True)).where("label_accuracy is not null")


_DECISION = "struct<tool:string,arguments:struct<label:string,rule_id:string,confidence:double,risk_level:string,next_action:string>>"


def decision(text: Column) -> Column:
    """Arguments of a final decision from JSON, else null.

    It has a tool and arguments alone; of the arguments label, rule_id and confidence are needed, risk_level and
    next_action may follow, none twice; the label is known and the confidence a number in 0..1.
    """
    parsed = F.try_parse_json(text)
    args = F.get_json_object(text, "$.arguments")
    names = lambda *x: F.array(*map(F.lit, x))
    keys, inner = F.json_object_keys(text), F.json_object_keys(args)
    whole = (F.size(keys) == 2) & (F.size(F.array_except(names("tool", "arguments"), keys)) == 0) & (F.get_json_object(text, "$.tool") == "final_decision")
    needed = names("label", "rule_id", "confidence")
    whole = whole & (F.size(F.array_except(needed, inner)) == 0) & (F.size(F.array_except(inner, names("label", "rule_id", "confidence", "risk_level", "next_action"))) == 0)
    whole = whole & (F.size(F.array_distinct(inner)) == F.size(inner)) & parsed.isNotNull()
    got = F.from_json(args, "struct<label:string,rule_id:string,confidence:string,risk_level:string>")
    number = got["confidence"].rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & ~args.rlike(r'"confidence"\s*:\s*"')
    sound = got["label"].isin("safe", "unsafe") & number & got["confidence"].try_cast("double").between(0, 1)
    sound = sound & F.coalesce(got["risk_level"].isin("P0", "P1", "P2", "P3"), F.lit(True))
    return F.when(whole & sound, got)


def rewards(completion: Column, solution: Column) -> list[Column]:
    """format, label and rule reward: 1.0 if both are sound, if labels agree, if rules agree as well."""
    made, wanted = decision(completion), decision(solution)
    sound = made.isNotNull() & wanted.isNotNull()
    label = sound & (made["label"] == wanted["label"])
    rule = label & made["rule_id"].eqNullSafe(wanted["rule_id"])
    return [F.coalesce(c, F.lit(False)).cast("double").alias(n) for c, n in ((sound, "format_reward"), (label, "label_reward"), (rule, "rule_reward"))]
