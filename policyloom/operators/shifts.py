"""Pairs of tasks before and after a change of policy: the edits, and names that follow from the policies' canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import ship
from .records import broken, filled, unique

RULE = "struct<rule_id:string,title:string,text:string,exceptions:array<string>,priority:int>"


def rules_json(rules: Column) -> Column:
    """Rules as JSON with sorted names; canonical once X.canonical_json has escaped what is not ASCII."""
    rule = lambda r: F.struct(F.coalesce(r["exceptions"], F.array().cast("array<string>")).alias("exceptions"), r["priority"].alias("priority"), r["rule_id"].alias("rule_id"), r["text"].alias("text"), r["title"].alias("title"))
    return F.to_json(F.transform(rules, rule))


def _rules(*parts: Column) -> Column:
    return F.concat(*parts)


def _one(rule: Column) -> Column:
    return F.array(rule.cast(RULE))


def edited(kind: str, unrelated: Column, rule: Column, other: Column | None = None) -> tuple[Column, Column]:
    """Rules before and after: rule_addition, rule_removal, rule_rewrite (other: the new wording) or exemption (other: the new exception)."""
    unrelated = F.coalesce(unrelated, F.array().cast(f"array<{RULE}>"))
    with_rule = _rules(unrelated, _one(rule))
    if kind == "rule_addition":
        return unrelated, with_rule
    if kind == "rule_removal":
        return with_rule, unrelated
    if kind == "rule_rewrite":
        return with_rule, _rules(unrelated, _one(other))
    if kind == "exemption":
        changed = F.struct(rule["rule_id"].alias("rule_id"), rule["title"].alias("title"), rule["text"].alias("text"), F.array_append(F.coalesce(rule["exceptions"], F.array().cast("array<string>")), other).alias("exceptions"), rule["priority"].alias("priority"))
        return with_rule, _rules(unrelated, _one(changed))
    raise ValueError(f"unknown change {kind}")


def shift_rows(rows: DataFrame, kind: str, before: Column, after: Column, rule_id: Column, before_version: str | None = None, after_version: str | None = None) -> DataFrame:
    """Two rows for each (asset_id, observation): variant, rules, label, rule_id, policy_version, group_id and code.

    A rule's addition turns safe into unsafe by that rule; the other changes turn unsafe into safe. Versions name the kind, the
    variant and a digest of the policy unless given; the group's digest covers everything of the pair. Code: repeated rule
    ids, a rule that the unsafe policy lacks, or versions that do not differ.
    """
    ship(rows.sparkSession)
    added = kind == "rule_addition"
    sides = rows.withColumn("__b", before).withColumn("__a", after).withColumn("__r", rule_id)
    label = lambda unsafe: F.struct(F.lit("unsafe" if unsafe else "safe").alias("label"), (F.col("__r") if unsafe else F.lit(None).cast("string")).alias("rule_id"))
    payload = F.to_json(
        F.struct(
            label(added).alias("after_outcome"), F.col("__a").alias("after_policy"), F.col("asset_id").cast("string").alias("asset_id"), label(not added).alias("before_outcome"),
            F.col("__b").alias("before_policy"), F.col("observation").alias("observation"), F.lit(kind).alias("transformation"),
        ),
        {"ignoreNullFields": "false"},
    )
    canonical = X.canonical_json(ascii_only=True)
    named = sides.withColumns({"__jb": canonical(rules_json(F.col("__b"))), "__ja": canonical(rules_json(F.col("__a"))), "__p": canonical(payload)})
    version = lambda given, variant, text: F.lit(given) if given else F.concat(F.lit(f"{kind}-{variant}-"), F.substring(F.sha2(text, 256), 1, 12))
    group = F.concat(F.lit(f"{kind}-group-"), F.substring(F.sha2("__p", 256), 1, 16))
    parts = [
        F.struct(F.lit(v).alias("variant"), F.col(r).alias("rules"), label(u)["label"].alias("label"), label(u)["rule_id"].alias("rule_id"), version(g, v, F.col(j)).alias("policy_version"))
        for v, r, u, g, j in (("before", "__b", not added, before_version, "__jb"), ("after", "__a", added, after_version, "__ja"))
    ]
    both = named.withColumn("__x", F.array(*parts)).withColumn("group_id", group)
    ids = lambda c: F.transform(c, lambda r: r["rule_id"])
    unsafe = F.col("__a" if added else "__b")
    code = broken(
        (unique(ids(F.col("__b"))) & unique(ids(F.col("__a"))), "repeated_rule"),
        (F.array_contains(ids(unsafe), F.col("__r")), "rule_not_in_policy"),
        (F.col("__x")[0]["policy_version"] != F.col("__x")[1]["policy_version"], "equal_versions"),
    )
    coded = both.withColumn("code", code)
    return coded.select("asset_id", "observation", F.lit(kind).alias("transformation"), "group_id", "code", F.explode("__x").alias("x")).select("asset_id", "observation", "transformation", "group_id", "code", "x.*")


def changes(rows: DataFrame, kind: str, legacy_versions: bool = False) -> DataFrame:
    """shift_rows for rows with asset_id, observation, rule, unrelated, and other (the new rule of a rewrite, the text of an exemption).

    An exemption must be new and not blank. legacy_versions: a removal's old fixed version names.
    """
    if legacy_versions and kind != "rule_removal":
        raise ValueError("only removals had fixed version names")
    other = F.col("other") if kind in ("rule_rewrite", "exemption") else None
    before, after = edited(kind, F.col("unrelated"), F.col("rule"), other)
    names = ("with-rule", "without-rule") if legacy_versions else (None, None)
    made = shift_rows(rows, kind, before, after, F.col("rule.rule_id"), *names)
    if kind != "exemption":
        return made
    bad = rows.where(~(filled("other") & ~F.coalesce(F.array_contains("rule.exceptions", F.col("other")), F.lit(False)))).select("asset_id", F.lit("exemption_not_new").alias("bad"))
    return made.join(bad, "asset_id", "left").withColumn("code", F.coalesce("bad", "code")).drop("bad")
