"""The tool environment: declarations, stores, and the execution of calls as joins; and the lookups of an episode.

Calls are rows with JSON arguments; each kind of call is one join against its store, so a batch of calls costs three joins,
however many there are. Results are canonical JSON, as a trajectory holds them.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..runtime import stored
from . import similarity
from .joins import duplicates

#: Names, descriptions and parameters of the tools.
TOOLS = {
    "search_cases": (
        "Search similar moderation or public regulatory cases. Returns evidence, not a safety label.",
        {"query": {"type": "string", "description": "Concise content or behavior to match."}, "top_k": {"type": "integer", "minimum": 1, "maximum": 5}},
        ["query"],
    ),
    "verify_claim": (
        "Search trusted claim evidence. Returns support status and sources, not a safety label.",
        {
            "claim": {"type": "string", "description": "The exact claim to verify."},
            "product_type": {"type": "string", "description": "Optional product category."},
            "top_k": {"type": "integer", "minimum": 1, "maximum": 5},
        },
        ["claim"],
    ),
    "inspect_destination": (
        "Inspect a link, handle, QR destination, or obfuscated contact indicator. Copy the indicator verbatim from the supplied conversation.",
        {"indicator": {"type": "string", "description": "The destination indicator from the content."}},
        ["indicator"],
    ),
}
MOST_RESULTS, USUAL_RESULTS, LEAST_CLAIM_SCORE = 5, 3, 2
CASES = "case_id string, text string, summary string, source_type string, source_id string"
CLAIMS = "evidence_id string, claim string, product_type string, stance string, summary string, source_type string, source_id string"
DESTINATIONS = "destination_id string, indicators array<string>, destination_type string, risk_signals array<string>, source_type string, source_id string"
STORES = {"cases.jsonl": (CASES, "case_id"), "claim_evidence.jsonl": (CLAIMS, "evidence_id"), "destinations.jsonl": (DESTINATIONS, "destination_id")}


def _declaration(name: str) -> dict:
    description, properties, required = TOOLS[name]
    return {"name": name, "description": description, "parameters": {"type": "object", "properties": properties, "required": required, "additionalProperties": False}}


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _listed(names: Column, render) -> Column:
    """A JSON list of what each name stands for; an unknown or repeated name is an error."""
    known = F.create_map(*[F.lit(x) for n in TOOLS for x in (n, _compact(render(n)))])
    sound = (F.size(F.array_distinct(names)) == F.size(names)) & F.forall(names, lambda n: F.map_contains_key(known, n))
    made = F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.element_at(known, n)), ","), F.lit("]"))
    return F.when(sound, made).otherwise(F.raise_error(F.lit("tool names must be known and unique")).cast("string"))


def tools_json(names: Column) -> Column:
    """The tools of a training row."""
    return _listed(names, lambda n: {"type": "function", "function": _declaration(n)})


def declarations_json(names: Column) -> Column:
    """The same tools as a provider declares them, without the wrapper."""
    return _listed(names, _declaration)


# --- stores -------------------------------------------------------------------------------------------------------


def load_stores(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], str]:
    """The three stores of a folder, strictly read, and the digest of their names and bytes in fixed order."""
    from ..sources.readers import read_jsonl

    mark, stores = hashlib.sha256(), {}
    for name, (schema, key) in STORES.items():
        mark.update(name.encode())
        for row in spark.read.format("binaryFile").load(f"{root}/{name}").select("content").toLocalIterator():  # a file at a time
            mark.update(row[0])
        stores[name.split(".")[0]] = read_jsonl(spark, f"{root}/{name}", schema, key)
    return stores, mark.hexdigest()


def store_violations(cases: DataFrame, claims: DataFrame, destinations: DataFrame) -> DataFrame:
    """(store, key, code): repeated ids, and indicators that are empty or lead to several destinations once normalised."""
    parts = [duplicates(df, key).select(F.lit(store).alias("store"), F.col(key).alias("key"), F.lit("repeated_id").alias("code")) for store, df, key in (("cases", cases, "case_id"), ("claims", claims, "evidence_id"), ("destinations", destinations, "destination_id"))]
    flat = destinations.select("destination_id", F.explode("indicators").alias("raw")).withColumn("indicator", X.normalize_indicator(F.col("raw")))
    parts.append(flat.where("indicator = ''").select(F.lit("destinations").alias("store"), F.col("raw").alias("key"), F.lit("empty_indicator").alias("code")))
    shared = flat.where("indicator <> ''").groupBy("indicator").agg(F.countDistinct("destination_id").alias("n")).where("n > 1")
    parts.append(shared.select(F.lit("destinations").alias("store"), F.col("indicator").alias("key"), F.lit("shared_indicator").alias("code")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


# --- execution ----------------------------------------------------------------------------------------------------


#: Every field that a call or an action may have; each is taken out of its arguments once.
_FIELDS = ("query", "claim", "product_type", "top_k", "indicator", "rule_id", "kinds", "label", "confidence", "risk_level", "route", "next_action")


def _parsed(args: Column) -> Column:
    """Struct (keys, value, kinds) of a JSON object: its field names, and of each field known here the text and the type (null where absent)."""
    values = F.struct(*[F.get_json_object(args, f"$.{n}").alias(n) for n in _FIELDS])
    kinds = F.transform(F.array(F.try_parse_json(args)), lambda v: F.struct(*[F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")).alias(n) for n in _FIELDS]))[0]
    return F.struct(F.json_object_keys(args).alias("keys"), values.alias("value"), kinds.alias("kind"))


def _kind(args: Column, name: str) -> Column:
    return args["kind"][name]


def _only(args: Column, *names: str) -> Column:
    return F.size(F.array_except(args["keys"], F.array(*map(F.lit, names)))) == 0


def _field(args: Column, name: str) -> Column:
    return args["value"][name]


def _bound(args: Column, judge) -> Column:
    """judge of parsed arguments, which are parsed once and bound as a lambda's variable."""
    return F.transform(F.array(_parsed(args)), judge)[0]


def _text_ok(args: Column, name: str) -> Column:
    return F.coalesce((_kind(args, name) == "STRING") & (F.length(_field(args, name)) > 0), F.lit(False))


def _count_ok(args: Column, name: str = "top_k") -> Column:
    """An absent count, or a whole number of results."""
    given = F.array_contains(args["keys"], name)
    return ~given | F.coalesce((_kind(args, name) == "BIGINT") & _field(args, name).try_cast("int").between(1, MOST_RESULTS), F.lit(False))


def call_code(name: Column, args: Column) -> Column:
    """unknown_tool, invalid_arguments, or null for a call that can be executed."""
    product = lambda a: F.coalesce(_kind(a, "product_type").isin("STRING", "VOID"), F.lit(True))
    sound = lambda a: a["keys"].isNotNull() & (
        F.when(name == "search_cases", _only(a, "query", "top_k") & _text_ok(a, "query") & _count_ok(a))
        .when(name == "verify_claim", _only(a, "claim", "product_type", "top_k") & _text_ok(a, "claim") & product(a) & _count_ok(a))
        .when(name == "inspect_destination", _only(a, "indicator") & _text_ok(a, "indicator"))
    )
    known = F.coalesce(name.isin(*TOOLS), F.lit(False))
    return F.when(~known, "unknown_tool").when(~F.coalesce(_bound(args, sound), F.lit(False)), "invalid_arguments")


def _ranked(calls: DataFrame, records: DataFrame, key: str, text: Column, fields: list[str], least: int) -> DataFrame:
    """call_id and the JSON list of its best records, best first."""
    found = similarity.overlap_top_k(calls, records, "call_id", F.col("asked"), key, text, MOST_RESULTS, least).join(calls.select("call_id", "top_k"), "call_id").where("rank <= top_k")
    rows = found.join(records.select(*{key, *fields}), key).groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*sorted(fields)).alias("r")))).alias("rows"))
    return rows.select("call_id", F.to_json(F.transform("rows", lambda x: x["r"])).alias("found"))


def execute(calls: DataFrame, cases: DataFrame, claims: DataFrame, destinations: DataFrame) -> DataFrame:
    """Results of calls (call_id, name, arguments): call_id, status and content.

    search_cases and verify_claim rank by shared tokens, claims from two on; at most five records a call, so results are small.
    inspect_destination looks a normalised indicator up. Arguments are strict: a count is a JSON whole number.
    """
    coded = stored(calls.select("call_id", "name", "arguments", call_code(F.col("name"), F.col("arguments")).alias("code")), "coded-calls")
    given = lambda name: F.get_json_object("arguments", f"$.{name}")
    count = F.coalesce(given("top_k").try_cast("int"), F.lit(USUAL_RESULTS)).alias("top_k")
    sound = coded.where("code is null")
    searches = sound.where("name = 'search_cases'").select("call_id", given("query").alias("asked"), count)
    product = F.when(F.length(given("product_type")) > 0, given("product_type"))
    checks = sound.where("name = 'verify_claim'").select("call_id", F.concat_ws(" ", given("claim"), product).alias("asked"), count)
    looks = sound.where("name = 'inspect_destination'").select("call_id", X.normalize_indicator(given("indicator")).alias("indicator"))
    by_case = _ranked(searches, cases, "case_id", F.col("text"), ["case_id", "summary", "source_id", "source_type"], 1)
    by_claim = _ranked(checks, claims, "evidence_id", F.concat_ws(" ", "claim", "product_type"), ["evidence_id", "stance", "summary", "source_id", "source_type"], LEAST_CLAIM_SCORE)
    record = F.struct("destination_id", "destination_type", "risk_signals", "source_id", "source_type")
    index = destinations.select(record.alias("r"), F.explode("indicators").alias("raw")).select("r", X.normalize_indicator(F.col("raw")).alias("indicator")).where("indicator <> ''")
    index = index.groupBy("indicator").agg(F.min("r").alias("r"))
    by_place = looks.join(index, "indicator").select("call_id", F.to_json("r").alias("found"))
    met = coded.join(by_case.unionByName(by_claim).unionByName(by_place), "call_id", "left")
    status = F.when(F.col("code").isNotNull(), "error").when(F.col("found").isNull(), "not_found").otherwise("ok")
    body = (
        F.when(F.col("code").isNotNull(), F.concat(F.lit('"error":"'), F.col("code"), F.lit('"')))
        .when(F.col("name") == "inspect_destination", F.concat(F.lit('"result":'), F.coalesce("found", F.lit("null"))))
        .otherwise(F.concat(F.lit('"results":'), F.coalesce("found", F.lit("[]"))))
    )
    return met.select("call_id", status.alias("status"), F.concat(F.lit("{"), body, F.lit(',"status":"'), status, F.lit('"}')).alias("content"))


# --- the lookups of an episode ------------------------------------------------------------------------------------

#: The actions of an episode and the kinds of evidence.
ACTIONS = ("get_rule_detail", "search_case", "inspect_evidence", "final_decision")
EVIDENCE_KINDS = ("ocr", "asr", "frame", "metadata", "case")
FINAL_FIELDS = ("label", "rule_id", "confidence", "risk_level", "route", "next_action")


def action(text: Column, rule_ids: Column) -> Column:
    """Struct (tool, arguments, kind) of an action in JSON, judged against a task's rules.

    kind is tool or final for a sound action, bad_arguments for a known tool that cannot be run as asked, and invalid for
    what is no action at all.
    """
    tool, args = F.get_json_object(text, "$.tool"), F.get_json_object(text, "$.arguments")

    def sound(a: Column) -> Column:
        rule = _only(a, "rule_id") & _text_ok(a, "rule_id") & F.array_contains(rule_ids, _field(a, "rule_id"))
        search = _only(a, "query", "top_k") & _text_ok(a, "query") & _field(a, "query").rlike(r"(?U)\S") & _count_ok(a)
        kinds = F.from_json(_field(a, "kinds"), "array<string>")
        evidence = _only(a, "kinds") & (_kind(a, "kinds") == "ARRAY<STRING>") & (F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(*map(F.lit, EVIDENCE_KINDS)))) == 0)
        fits = F.when(tool == "get_rule_detail", rule).when(tool == "search_case", search).when(tool == "inspect_evidence", evidence).otherwise(_final_ok(a, rule_ids))
        return F.when(a["keys"].isNotNull(), F.coalesce(fits, F.lit(False)))

    fits = F.when(tool.isin(*ACTIONS) & F.try_parse_json(text).isNotNull(), _bound(args, sound))
    kind = F.when(fits.isNull(), "invalid").when(~fits, "bad_arguments").when(tool == "final_decision", "final").otherwise("tool")
    real = kind != "invalid"
    return F.struct(F.when(real, tool).alias("tool"), F.when(real, args).alias("arguments"), kind.alias("kind"))


def _final_ok(args: Column, rule_ids: Column) -> Column:
    """A decision of known fields and values whose rule, if any, is active."""
    maybe = lambda name, *allowed: F.coalesce((_kind(args, name) == "VOID") | ((_kind(args, name) == "STRING") & (_field(args, name).isin(*allowed) if allowed else F.lit(True))), F.lit(True))
    number = (_kind(args, "confidence") == "BIGINT") | (_kind(args, "confidence") == "DOUBLE") | _kind(args, "confidence").startswith("DECIMAL")
    route = F.coalesce((_kind(args, "route") == "STRING") & _field(args, "route").isin(*P.ROUTES), F.lit(True))
    rule = _field(args, "rule_id")
    return (
        _only(args, *FINAL_FIELDS) & F.coalesce((_kind(args, "label") == "STRING") & _field(args, "label").isin("safe", "unsafe"), F.lit(False))
        & F.coalesce(number & _field(args, "confidence").try_cast("double").between(0, 1), F.lit(False))
        & maybe("rule_id") & (rule.isNull() | F.array_contains(rule_ids, rule)) & maybe("risk_level", "P0", "P1", "P2", "P3") & route & maybe("next_action")
    )


def rule_json(rule: Column) -> Column:
    """One rule as an observation."""
    return F.to_json(F.struct(rule["rule_id"].alias("rule_id"), rule["title"].alias("title"), rule["text"].alias("text"), rule["exceptions"].alias("exceptions"), rule["priority"].alias("priority")))


def observe(actions: DataFrame, cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """What lookups return: step_id and observation (JSON) of sound tool actions.

    actions: step_id, asset_id, rules, tool, arguments. A case search lists cases without a common token too, smallest id
    first; evidence keeps its own order (ordinal).
    """
    given = lambda name: F.get_json_object("arguments", f"$.{name}")
    details = actions.where("tool = 'get_rule_detail'").select("step_id", rule_json(F.get(F.filter("rules", lambda r: r["rule_id"] == given("rule_id")), F.lit(0))).alias("observation"))
    asked = actions.where("tool = 'search_case'").select("step_id", given("query").alias("asked"), F.coalesce(given("top_k").try_cast("int"), F.lit(USUAL_RESULTS)).alias("top_k"))
    ranked = similarity.overlap_top_k_with_zeros(asked, cases, "step_id", F.col("asked"), "case_id", F.col("text"), MOST_RESULTS).join(asked.select("step_id", "top_k"), "step_id").where("rank <= top_k")
    rows = ranked.join(cases.select("case_id", "text"), "case_id").groupBy("step_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct("case_id", "text").alias("r")))).alias("rows"))
    searched = rows.select("step_id", F.to_json(F.transform("rows", lambda x: x["r"])).alias("observation"))
    wanted = actions.where("tool = 'inspect_evidence'").select("step_id", "asset_id", F.explode(F.array_distinct(F.from_json(given("kinds"), "array<string>"))).alias("kind"))
    seen = wanted.join(evidence, ["asset_id", "kind"], "left").groupBy("step_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("evidence_id").isNotNull(), F.struct("ordinal", F.struct("evidence_id", "asset_id", "kind", "content").alias("r"))))).alias("rows")
    )
    inspected = seen.select("step_id", F.to_json(F.transform("rows", lambda x: x["r"])).alias("observation"))
    return details.unionByName(searched).unionByName(inspected)
