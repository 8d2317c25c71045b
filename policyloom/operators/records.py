"""Record checks: the first rule that a row breaks names its code, null if it breaks none. All are native columns or joins."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..runtime import ship
from .joins import duplicates


def broken(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule that does not hold; a rule that cannot be decided does not hold."""
    code = F.lit(None).cast("string")
    for holds, name in reversed(rules):
        code = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(code)
    return code


def filled(text: Column | str) -> Column:
    """Holds a character other than white space."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"(?U)\S")


def unique(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def finite(value: Column) -> Column:
    """Whether a number is neither NaN nor infinite; null counts as finite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(True))


# --- samples, blueprints, policies, seeds -------------------------------------------------------------------------


def sample_code() -> Column:
    """Of moderation samples: ids, query, tools and the hidden expectation."""
    tools, answers, label = _list("tool_names"), _list("expected_answers"), F.col("expected_label")
    return broken(
        (F.col("thinking_type").isin("fast", "slow") & F.col("tool_policy").isin("auto", "required") & (label.isNull() | label.isin("safe", "unsafe")), "unknown_value"),
        (filled("sample_id") & filled("policy_id"), "blank_id"),
        (filled("query"), "blank_query"),
        (F.forall(tools, filled), "blank_tool"),
        (unique(tools), "repeated_tool"),
        (F.forall(answers, filled), "blank_answer"),
        ((F.col("tool_policy") != "required") | (F.size(tools) > 0), "required_without_tools"),
        (unique(answers), "repeated_answer"),
        (label.isNotNull() | (F.size(answers) == 0), "answers_without_label"),
        (label.isNull() | (label != "safe") | (F.size(answers) == 0), "safe_with_answers"),
        (label.isNull() | (label != "unsafe") | (F.size(answers) > 0), "unsafe_without_answers"),
    )


def blueprint_code() -> Column:
    """Of blueprints: ids, active rules, exception target, and the intended decision in policy order."""
    ids, titles, answers = _list("active_rule_ids"), _list("active_rule_titles"), _list("intended_answers")
    target, text, rule, answer = (F.col(c) for c in ("target_exception_rule_id", "target_exception", "primary_rule_id", "primary_answer"))
    safe = F.col("intended_label") == "safe"
    none = rule.isNull() & answer.isNull() & (F.size(answers) == 0)
    return broken(
        (F.col("intended_label").isin("safe", "unsafe"), "unknown_value"),
        (filled("blueprint_id") & filled("family_id"), "blank_id"),
        (F.col("blueprint_id") != F.col("family_id"), "equal_ids"),
        (filled("policy_id"), "blank_policy"),
        ((F.size(ids) > 0) & F.forall(ids, filled), "blank_rule"),
        (unique(ids), "repeated_rule"),
        (F.size(titles) == F.size(ids), "titles_without_rules"),
        (F.forall(titles, filled), "blank_title"),
        (unique(titles), "repeated_title"),
        (unique(answers), "repeated_answer"),
        (F.size(F.array_except(answers, titles)) == 0, "inactive_answer"),
        (F.filter(titles, lambda t: F.array_contains(answers, t)) == answers, "answer_order"),
        (target.isNull() == text.isNull(), "half_exception"),
        (target.isNull() | (safe & (F.col("difficulty") == "exception")), "exception_of_other_row"),
        (target.isNull() | F.array_contains(ids, target), "inactive_exception"),
        (text.isNull() | filled(text), "blank_exception"),
        (~safe | none, "safe_with_answers"),
        (safe | F.array_contains(ids, rule), "inactive_primary_rule"),
        (safe | (F.get(titles, (F.array_position(ids, rule) - 1).cast("int")) == answer), "primary_title"),
        (safe | F.array_contains(answers, answer), "primary_not_intended"),
    )


def policy_violations(policies: DataFrame) -> DataFrame:
    """(policy_id, rule_id, code) of policies with rules; a rule id has one definition everywhere."""
    whole = policies.select("policy_id", broken((filled("policy_id"), "blank_policy"), (F.size("rules") > 0, "no_rules")).alias("code")).where("code is not null")
    twice = duplicates(policies, "policy_id").select("policy_id", F.lit("repeated_policy").alias("code"))
    head = whole.unionByName(twice).select("policy_id", F.lit(None).cast("string").alias("rule_id"), "code")
    rules = policies.withColumn("__row", F.monotonically_increasing_id()).select("policy_id", "__row", F.explode("rules").alias("r")).select("policy_id", "__row", "r.*")
    blank = rules.where(~(filled("rule_id") & filled("title") & filled("text"))).select("policy_id", "rule_id", F.lit("blank_rule_field").alias("code"))
    ids = rules.groupBy("__row", "policy_id", "rule_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("policy_id", "rule_id", F.lit("repeated_rule").alias("code"))
    titles = rules.groupBy("__row", "policy_id", "title").agg(F.count(F.lit(1)).alias("n"), F.max("rule_id").alias("rule_id")).where("n > 1").select("policy_id", "rule_id", F.lit("repeated_title").alias("code"))
    text = F.to_json(F.struct("exceptions", "priority", "text", "title"))
    kinds = rules.groupBy("rule_id").agg(F.countDistinct(text).alias("n"), F.min("policy_id").alias("policy_id")).where("n > 1").select("policy_id", "rule_id", F.lit("inconsistent_rule").alias("code"))
    return head.unionByName(blank).unionByName(ids).unionByName(titles).unionByName(kinds)


def seed_codes(seeds: DataFrame, sources: dict[str, int] = P.SOURCE_QUOTAS) -> DataFrame:
    """Seeds with the first rule they break: a known source, a fresh id, a fresh text, the hash of the text. Of equals, the one of least ordinal is sound."""
    by_id = seeds.groupBy("source", "source_id").agg(F.min("ordinal").alias("__first_id"))
    by_text = seeds.groupBy("content_hash").agg(F.min("ordinal").alias("__first_text"))
    rows = seeds.join(by_id, ["source", "source_id"]).join(by_text, "content_hash")
    code = broken(
        (F.col("source").isin(*sources), "unknown_source"),
        (F.col("ordinal") == F.col("__first_id"), "repeated_source_id"),
        (F.col("ordinal") == F.col("__first_text"), "repeated_content_hash"),
        (F.col("content_hash") == F.sha2("text", 256), "wrong_content_hash"),
    )
    return rows.withColumn("code", code).drop("__first_id", "__first_text")


# --- public assets, cases and sources -----------------------------------------------------------------------------

#: Fields of import rows and of crawled sources, review states, licence names that say nothing.
COMMON_FIELDS = ("input_type", "max_records", "source_dataset", "license_id", "usage_scope", "license_review_status", "terms_review_status", "content_review_status")
LOCAL_FIELDS = ("local_html_path", "source_type", "source_url", "allowed_domains", "retrieved_at")
CRAWLED_FIELDS = ("crawler_output_dir", "source")
SOURCE_FIELDS = ("url", "allowed_domains", "source_type", "license", "license_review_status", "terms_review_status", "content_review_status")
MANIFEST_FIELDS = ("url", "source_type", "license", "terms_review", "license_review_status", "terms_review_status", "content_review_status")
REVIEW_STATES = ("pending", "approved", "review_required", "rejected")
CONTENT_STATES = ("pending", "approved", "rejected")
NO_LICENSE = ("", "unknown", "not_reviewed", "not-reviewed", "tbd")
RECORD_CAP = 50_000


def published_ok() -> Column:
    """A published case has all three reviews approved."""
    return (F.col("publication_status") != "published") | F.forall(F.array("license_review_status", "terms_review_status", "content_review_status"), lambda s: s == "approved")


def media_paths_ok(paths: Column) -> Column:
    """At least one path, each relative, without back slashes and without steps upwards."""
    safe = lambda p: (p != "") & ~p.startswith("/") & ~p.contains("\\") & ~F.array_contains(F.split(p, "/"), "..")
    return F.coalesce((F.size(paths) > 0) & F.forall(paths, safe), F.lit(False))


def terms_status(status: Column, old: Column) -> Column:
    """The explicit status of terms; where it is pending, what an older manifest said."""
    return F.when((status != "pending") | (old == "not_reviewed"), status).when(old == "reviewed", "approved").when(old == "review_required", "pending").otherwise(old)


def _text(row: Column, name: str) -> Column:
    """A field of a JSON object if it is a string."""
    value = F.try_variant_get(F.try_parse_json(row), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.get_json_object(row, f"$.{name}"))


def _extra(row: Column, *allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.json_object_keys(row), F.array(*[F.lit(x) for part in allowed for x in part])))


def import_row_code(row: Column) -> Column:
    """Of one configured import as JSON text: its kind's fields, governance, and for crawled ones agreement with their source."""
    kind, source = _text(row, "input_type"), F.get_json_object(row, "$.source")
    local, crawled = kind == "local_html", kind == "crawler_artifact"
    cap = F.try_variant_get(F.try_parse_json(row), "$.max_records", "variant")
    count = F.get_json_object(row, "$.max_records").try_cast("long")
    needed = lambda *names: F.forall(F.array(*[_text(row, n) for n in names]), filled)
    same = [_text(row, mine).eqNullSafe(_text(source, theirs)) for mine, theirs in (("license_id", "license"), *[(f"{k}_review_status",) * 2 for k in ("license", "terms", "content")])]
    agree = same[0] & same[1] & same[2] & same[3]
    return broken(
        (F.json_object_keys(row).isNotNull(), "not_an_object"),
        (local | crawled, "unknown_input_type"),
        (~local | (_extra(row, COMMON_FIELDS, LOCAL_FIELDS) == 0), "unknown_field"),
        (~crawled | (_extra(row, COMMON_FIELDS, CRAWLED_FIELDS) == 0), "unknown_field"),
        ((F.schema_of_variant(cap) == "BIGINT") & count.between(1, RECORD_CAP), "record_cap"),
        (needed("source_dataset", "license_id", "usage_scope", "license_review_status", "terms_review_status", "content_review_status"), "blank_field"),
        (~F.lower(_text(row, "license_id")).isin(*NO_LICENSE), "ungoverned_license"),
        (_text(row, "usage_scope").isin("smoke_only", "research_only"), "usage_scope"),
        (_text(row, "license_review_status").isin(*REVIEW_STATES) & _text(row, "terms_review_status").isin(*REVIEW_STATES), "review_status"),
        (_text(row, "content_review_status").isin(*CONTENT_STATES), "content_review_status"),
        (~local | needed("local_html_path", "source_url", "retrieved_at"), "blank_field"),
        (~crawled | needed("crawler_output_dir"), "blank_field"),
        (~crawled | (F.json_object_keys(source).isNotNull() & (_extra(source, SOURCE_FIELDS) == 0) & (F.size(F.json_object_keys(source)) == len(SOURCE_FIELDS))), "source_fields"),
        (~crawled | agree, "governance_disagrees"),
        (~crawled | (_text(row, "usage_scope") == "research_only"), "usage_scope"),
    )


def manifest_source(row: Column) -> Column:
    """A manifest row, a bare URL or an object, as struct (url, code, source_type, license, terms_review, three review statuses) with defaults."""
    bare = F.json_object_keys(row).isNull()
    defaults = (("source_type", "unknown"), ("license", "not_reviewed"), ("terms_review", "not_reviewed"), ("license_review_status", "pending"), ("terms_review_status", "pending"), ("content_review_status", "pending"))
    url = F.when(bare, row).otherwise(_text(row, "url"))
    code = broken((bare | (_extra(row, MANIFEST_FIELDS) == 0), "unknown_field"), (url.isNotNull(), "no_url"))
    fields = [F.when(bare, F.lit(d)).otherwise(F.coalesce(_text(row, n), F.lit(d))).alias(n) for n, d in defaults]
    return F.struct(url.alias("url"), code.alias("code"), *fields)


# --- codes of errors ----------------------------------------------------------------------------------------------

#: Parts of validation messages and their codes, in order; states and names of errors worth another try.
MESSAGE_CODES = (
    ("must belong to the active policy", "inactive_answer"), ("checks an inactive policy rule", "inactive_answer"),
    ("missing or duplicate titles", "answer_format"), ("must answer Safe", "answer_format"),
    ("missing the content summary", "slow_structure"), ("required reasoning steps", "slow_structure"), ("reasoning steps must not be empty", "slow_structure"),
    ("only active-rule lines", "slow_rule_evidence"), ("invalid evidence", "slow_rule_evidence"),
    ("must not contain a hit", "slow_verdict_consistency"), ("match every HIT rule", "slow_verdict_consistency"),
    ("policy order", "slow_rule_order"), ("grammar", "output_grammar"),
)
RETRYABLE_HTTP = (408, 409, 425, 429)
RETRYABLE_STATES = ("ABORTED", "DEADLINE_EXCEEDED", "INTERNAL", "RESOURCE_EXHAUSTED", "UNAVAILABLE")
RETRYABLE_NAMES = ("connection", "timeout", "transport")


def message_code(message: Column) -> Column:
    """The stable code of a validation message."""
    code = F.lit("completion_validation")
    for part, name in reversed(MESSAGE_CODES):
        code = F.when(message.contains(part), name).otherwise(code)
    return code


def retryable(http: Column, state: Column, error: Column) -> Column:
    """Whether a provider's failure is worth another try: by HTTP code, else by state, else by the error's name."""
    named = F.lit(False)
    for part in RETRYABLE_NAMES:
        named = named | F.lower(error).contains(part)
    return F.when(http.isNotNull(), http.isin(*RETRYABLE_HTTP) | http.between(500, 599)).when(state.isNotNull(), state.isin(*RETRYABLE_STATES)).otherwise(F.coalesce(named, F.lit(False)))


# --- digests of ordered tables ------------------------------------------------------------------------------------


def list_digest(rows: DataFrame, item: Column, order: list[str]) -> DataFrame:
    """SHA-256 of '[item,item,...]' and a line end, over rows in order: one row.

    The digest chains over all items, so one task reads them in order; it streams and holds none.
    """
    ship(rows.sparkSession)

    def run(batches):
        mark, first = hashlib.sha256(b"["), True
        for batch in batches:
            for text in batch.column(0).to_pylist():
                mark.update(("" if first else ",").encode() + text.encode("utf-8"))
                first = False
        mark.update(b"]\n")
        yield pa.RecordBatch.from_arrays([pa.array([mark.hexdigest()])], names=["digest"])

    placed = rows.select(item.alias("__item"), *order).repartition(1).sortWithinPartitions(*order)
    return placed.select("__item").mapInArrow(run, "digest string")


def policy_json() -> Column:
    """A policy as canonical JSON: sorted names, no blanks."""
    rule = lambda r: F.struct(F.coalesce(r["exceptions"], F.array().cast("array<string>")).alias("exceptions"), r["priority"].alias("priority"), r["rule_id"].alias("rule_id"), r["text"].alias("text"), r["title"].alias("title"))
    return F.to_json(F.struct("policy_id", F.transform("rules", rule).alias("rules")))


def policy_hash(policies: DataFrame, order: str = "position") -> DataFrame:
    """Digest of a list of policies in order."""
    return list_digest(policies, policy_json(), [order])


def source_hashes(seeds: DataFrame, order: str = "ordinal") -> DataFrame:
    """Digests of seeds without their texts, and of their keys with the hashes of their texts: one row."""
    named = sorted(c for c in seeds.columns if c not in ("text", order))
    snapshot = F.to_json(F.struct(*named), {"ignoreNullFields": "false"})
    text = F.to_json(F.struct(F.array("source", "source_id").alias("key"), F.sha2("text", 256).alias("text_sha256")))
    left = list_digest(seeds, snapshot, [order]).withColumnRenamed("digest", "metadata_sha256")
    return left.join(list_digest(seeds, text, [order]).withColumnRenamed("digest", "text_sha256"), F.lit(True))


# --- state of an interrupted run ----------------------------------------------------------------------------------


def resume_violations(plan: DataFrame, state: DataFrame, samples: DataFrame, metadata: DataFrame, rejected: DataFrame, most_attempts: int) -> DataFrame:
    """(code, n) of what a stored run breaks; an empty result may be resumed.

    plan: blueprint_id, policy_id, thinking_type, intended_label, intended_answers. state: blueprint_id, attempts, status
    (completed, terminal or pending). samples: sample_id and the fields a blueprint fixes. rejected: blueprint_id, attempt.
    """
    tries = rejected.groupBy(F.col("blueprint_id").alias("b")).agg(F.count(F.lit(1)).alias("lost"), F.min("attempt").alias("low"), F.max("attempt").alias("high"), F.countDistinct("attempt").alias("kinds"))
    history = state.join(tries, F.col("blueprint_id") == F.col("b"), "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    done = F.col("status") == "completed"
    state_code = broken(
        (F.col("attempts").between(0, most_attempts), "attempt_count"),
        ((F.col("lost") == 0) | ((F.col("low") == 1) & (F.col("high") == F.col("lost")) & (F.col("kinds") == F.col("lost"))), "attempt_history"),
        (~done | (F.col("attempts") == F.col("lost") + 1), "completed_history"),
        (done | (F.col("attempts") == F.col("lost")), "pending_history"),
        ((F.col("status") == "terminal") == (~done & (F.col("attempts") == most_attempts)), "terminal_ids"),
    )
    met = samples.alias("s").join(plan.alias("p"), F.expr("s.sample_id = p.blueprint_id"), "left").join(state.alias("t"), F.expr("s.sample_id = t.blueprint_id"), "left")
    sample_code = broken(
        (F.col("p.blueprint_id").isNotNull(), "unknown_sample"),
        (F.col("t.status") == "completed", "sample_not_completed"),
        ((F.col("s.policy_id") == F.col("p.policy_id")) & (F.col("s.thinking_type") == F.col("p.thinking_type")) & (F.col("s.expected_label") == F.col("p.intended_label"))
         & (F.col("s.expected_answers") == F.col("p.intended_answers")), "sample_differs"),
    )
    parts = [
        history.select(state_code.alias("code")),
        met.select(sample_code.alias("code")),
        state.join(plan, "blueprint_id", "left_anti").select(F.lit("unknown_state").alias("code")),
        plan.join(state, "blueprint_id", "left_anti").select(F.lit("missing_state").alias("code")),
        state.where("status = 'completed'").join(samples.withColumnRenamed("sample_id", "blueprint_id"), "blueprint_id", "left_anti").select(F.lit("missing_sample").alias("code")),
        samples.join(metadata, "sample_id", "left_anti").select(F.lit("missing_metadata").alias("code")),
        metadata.join(samples, "sample_id", "left_anti").select(F.lit("unknown_metadata").alias("code")),
        rejected.join(plan, "blueprint_id", "left_anti").select(F.lit("unknown_rejection").alias("code")),
        duplicates(samples, "sample_id").select(F.lit("repeated_sample").alias("code")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def budget_code(max_requests: int | None, max_cost: float | None) -> Column:
    """Of stored totals (request_count, input_tokens, output_tokens, estimated_cost_usd, accounting_complete) that a budget is to go on from."""
    whole = [F.coalesce(F.col(c) >= 0, F.lit(False)) for c in ("request_count", "input_tokens", "output_tokens", "estimated_cost_usd")]
    sound = whole[0] & whole[1] & whole[2] & whole[3] & finite(F.col("estimated_cost_usd")) & F.col("accounting_complete").isNotNull()
    return broken(
        (sound, "invalid_accounting"),
        (F.lit(True) if max_requests is None else F.col("request_count") <= max_requests, "request_budget_below_usage"),
        (F.lit(True) if max_cost is None else F.col("estimated_cost_usd") <= max_cost, "cost_budget_below_usage"),
    )
