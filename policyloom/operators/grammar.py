"""Completion grammar, message rendering, policy pairs, URL rules and episode replay."""

from __future__ import annotations

import json
import re
from urllib.parse import parse_qsl, unquote, urlsplit
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

# --- completion grammar -------------------------------------------------------------------------------------------


#: The frames of completions and of a slow one's reasoning.
FAST = r"(?s)\A(safe|unsafe)\n{1,2}<answer>([^<]+)</answer>\z"
SLOW = r"(?s)\A(safe|unsafe)\n{1,2}<reasoning>\n(.+)\n</reasoning>\n<answer>([^<]+)</answer>\z"
STEPS = r"(?s)\A\[Step 1\] Content Summary\n(.*?)\n\n\[Step 2\] Check Risk Categories\n(.*?)\n\n\[Step 3\] Final Judgment\n(.*)\z"


def _blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def completion(text: Column, thinking: Column, titles: Column) -> Column:
    """Struct (valid, label, answers) of a completion against its active titles.

    Answers are Safe, or distinct active titles. A slow completion also checks every active rule once, in order, with a
    verdict and, unless the rule does not apply, a reason; its answers are just the titles that were hit.
    """
    slow = thinking == "slow"
    pick = lambda fast, long: F.when(slow, F.regexp_extract(text, SLOW, long)).otherwise(F.regexp_extract(text, FAST, fast))
    label = pick(1, 1)
    answers = F.filter(F.transform(F.split(pick(2, 3), r"\r\n|[\n\r]"), F.trim), lambda a: a != "")
    reasoning = F.regexp_extract(text, SLOW, 2)
    step = lambda k: F.regexp_extract(reasoning, STEPS, k)
    lines = F.filter(F.split(step(2), r"\r\n|[\n\r]"), lambda c: c != "")

    def checked(line: Column) -> Column:
        """Title and verdict of a line; nulls where it has none."""
        title = F.get(F.filter(titles, lambda t: line.startswith(F.concat(F.lit("- "), t, F.lit(": ")))), F.lit(0))
        rest = F.substring(line, F.length(title) + 5, F.length(line))
        verdict = F.when(rest == "NOT APPLICABLE.", "NOT APPLICABLE")
        for v in P.VERDICTS:
            bare = F.lit(v == "NOT APPLICABLE") | ~_blank(F.substring(rest, len(v) + 3, 1 << 30))
            verdict = verdict.when(rest.startswith(f"{v}. ") & bare, v)
        return F.struct(title.alias("title"), verdict.alias("verdict"))

    checks = F.transform(lines, checked)
    hits = F.transform(F.filter(checks, lambda c: c["verdict"] == "HIT"), lambda c: c["title"])
    ok_answers = F.when(label == "safe", answers == F.array(F.lit("Safe"))).otherwise(
        (F.size(answers) > 0) & (F.size(F.array_distinct(answers)) == F.size(answers)) & (F.size(F.array_except(answers, titles)) == 0) & ~F.array_contains(answers, "Safe")
    )
    ok_checks = ~F.exists(checks, lambda c: c["title"].isNull() | c["verdict"].isNull()) & (F.transform(checks, lambda c: c["title"]) == titles)
    ok_steps = ~_blank(step(1)) & ~_blank(step(3)) & ok_checks & F.when(label == "safe", F.size(hits) == 0).otherwise(answers == hits)
    valid = (label != "") & ok_answers & F.when(slow, ok_steps).otherwise(F.lit(True))
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), label.alias("label"), answers.alias("answers"))


def semantic_mismatch(parsed: Column, expected_label: Column, expected_answers: Column) -> Column:
    """Code of the first difference to what a sample expects, null if none; answers in order."""
    return F.when(parsed["label"] != expected_label, "semantic_label_mismatch").when(parsed["answers"] != expected_answers, "semantic_answer_mismatch")


# --- messages -----------------------------------------------------------------------------------------------------


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


#: The heading of a rendered policy and the mark of an exception.
POLICY_HEADING, EXCEPTION_MARK = "当前生效规则：", "例外："


def policy_text(rules: Column) -> Column:
    """Rules by priority and id, each followed by its exceptions, a line each."""
    ordered = F.array_sort(F.transform(rules, lambda r: F.struct(r["priority"], r["rule_id"], r["title"], r["text"], r["exceptions"])))
    line = lambda r: F.concat(F.lit("["), r["rule_id"], F.lit("] "), r["title"], F.lit(": "), r["text"])
    marked = lambda r: F.transform(r["exceptions"], lambda e: F.concat(F.lit(EXCEPTION_MARK), e))
    return F.array_join(F.concat(F.array(F.lit(POLICY_HEADING)), F.flatten(F.transform(ordered, lambda r: F.concat(F.array(line(r)), marked(r))))), "\n")


def training_messages(system: Column, user: Column, trajectory: Column | None, final: Column) -> Column:
    """System, user, the trajectory's messages, and the final completion."""
    head = F.array(message("system", system), message("user", user))
    middle = [trajectory] if trajectory is not None else []
    return F.concat(head, *middle, F.array(message("assistant", final)))


def prompt_rows(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """Prompt-only rows: the first two messages, and the third's content as the solution."""
    return rows.withColumn("prompt", F.slice(messages, 1, 2)).withColumn("solution", F.get(F.col(messages), F.lit(2))["content"])


# --- policy pairs -------------------------------------------------------------------------------------------------

#: Labels before and after each change of a policy.
OUTCOMES = {"rule_addition": ("safe", "unsafe"), "rule_removal": ("unsafe", "safe"), "rule_rewrite": ("unsafe", "safe"), "exemption": ("unsafe", "safe")}


def policy_pairs(rows: DataFrame, asset: str, kind: str, before: Column, after: Column) -> DataFrame:
    """Two rows an asset, before and after a change of its policy, with labels, versions and a common group id. before, after: policy JSON."""
    first, second = OUTCOMES[kind]
    group = F.concat(F.lit(f"{kind}-group-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), F.col(asset).cast("string"), before, after), 256), 1, 16))
    version = lambda variant, policy: F.concat(F.lit(f"{kind}-{variant}-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), F.lit(variant), policy), 256), 1, 12))
    variants = [F.struct(F.lit(v).alias("variant"), p.alias("policy"), F.lit(o).alias("label"), version(v, p).alias("policy_version")) for v, p, o in (("before", before, first), ("after", after, second))]
    flat = rows.select(F.col(asset), F.lit(kind).alias("transformation"), group.alias("group_id"), F.explode(F.array(*variants)).alias("x"))
    return flat.select(asset, "transformation", "group_id", "x.*")


# --- URLs ---------------------------------------------------------------------------------------------------------


def url_verdict(url: str, allowed: set[str]) -> str:
    """The first rule that a source URL breaks, else ok."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "invalid"
    labels = host.split(".")
    if parts.scheme.lower() != "https":
        return "not_https"
    if not host or host == "localhost" or host.endswith((".localhost", ".local")) or ":" in host:
        return "local_or_ip"
    if all(re.fullmatch(P.NUMERIC_LABEL, x) for x in labels):
        return "numeric_host"
    if len(host) > 253 or not all(re.fullmatch(P.DNS_LABEL, x, re.ASCII) for x in labels):
        return "bad_host"
    if host not in allowed:
        return "not_allowed"
    if parts.username is not None or parts.password is not None:
        return "credentials"
    if port not in (None, 443):
        return "port"
    if parts.fragment:
        return "fragment"
    path = parts.path
    for _ in range(3):  # a few rounds, so that doubly encoded paths are seen through
        path = unquote(path)
    if not set(normalize("NFKC", path).casefold().split("/")).isdisjoint(P.BLOCKED_SEGMENTS):
        return "account_page"
    names = ("".join(filter(str.isalnum, k.casefold())) for k, _ in parse_qsl(parts.query, keep_blank_values=True))
    return "secret_parameter" if any(n in P.SENSITIVE_PARAMETERS for n in names) else "ok"


def url_check(allowed: set[str]):
    """UDF of url_verdict; null URLs are invalid."""

    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: "invalid" if u is None else url_verdict(u, allowed))

    return run


# --- episodes -----------------------------------------------------------------------------------------------------


def replay(steps: DataFrame, episode: str, order: str, kind: str, most_turns: int, label_ok: str, rule_ok: str) -> DataFrame:
    """Rewards of episodes whose steps are tool, final, bad_arguments or invalid actions.

    A tool costs; a final action earns a point each for label and rule and ends the episode; so does reaching the turn limit.
    Anything else, and every step after the end, is an invalid action: it costs more and ends the episode. Bad arguments of a
    known tool take a turn, what is no action takes none. Folded natively over the episode's steps in order.
    """
    ordered = steps.groupBy(episode).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("kind"), F.col(label_ok).alias("l"), F.col(rule_ok).alias("r")))).alias("steps"))
    start = F.struct(F.lit(0).alias("turns"), F.lit(False).alias("done"), F.lit(0.0).alias("reward"), F.lit("open").alias("status"))

    def step(state: Column, x: Column) -> Column:
        played = ~state["done"] & x["kind"].isin("tool", "final", "bad_arguments")
        bad = ~played | (x["kind"] == "bad_arguments")
        tool = ~bad & (x["kind"] == "tool")
        turns = state["turns"] + played.cast("int")
        limit = tool & (turns >= most_turns)
        gain = F.when(bad, P.INVALID_COST).when(tool, P.TOOL_COST).otherwise(x["l"].cast("double") + x["r"].cast("double"))
        status = F.when(bad, "invalid").when(limit, "turn_limit").when(tool, "tool").otherwise("final")
        return F.struct(turns.alias("turns"), (bad | limit | ~tool).alias("done"), (state["reward"] + gain).alias("reward"), status.alias("status"))

    return ordered.select(episode, F.aggregate("steps", start, step).alias("s")).select(episode, "s.*")


def dumps(value) -> str:
    """Canonical JSON for literals."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
