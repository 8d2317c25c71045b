"""Whole jobs over files: source catalogues and manifests, seed collection, imports of public cases, SFT and RL bundles."""

from __future__ import annotations

import json
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import capped, exports, grammar, records
from .operators.joins import duplicates
from .runtime import ship, stored
from .sources import readers, writers

#: Byte caps of an artifact, a response, a robots file, an imported file and a whole import, and record caps.
ARTIFACT_BYTES, RESPONSE_BYTES, ROBOTS_BYTES, FILE_BYTES, TOTAL_BYTES = 50 << 20, 5 << 20, 256 << 10, 20 << 20, 2 << 30
USUAL_RECORDS, MOST_RECORDS = 5000, 100_000
PINNED_ADAPTERS = ("hf_aegis_v2", "hf_civil_comments", "esci_query_parquet")
CATALOG = "source string, dataset_url string, artifact_url string, license string, usage_scope string, source_role string, adapter string, enabled boolean, dataset_id string, revision string, split string, max_records long"
RULES = "array<struct<rule_id:string,title:string,text:string,exceptions:array<string>,priority:int>>"
TASK = f"asset_id string, policy_version string, active_policy {RULES}, initial_observation string, images array<string>, videos array<string>, max_turns int"
ORACLE = "asset_id string, policy_version string, label string, rule_id string, risk_level string, next_action string"
CASE = "case_id string, text string"
EVIDENCE = "evidence_id string, asset_id string, kind string, content string"


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A YAML document of the shared file system; a repeated key is an error. Configuration is small and is read on the driver."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len(keys) != len(set(keys)):
            raise ValueError("repeated YAML key")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    document = yaml.load(bytes(rows[0][0]).decode("utf-8"), Loader=Loader)
    if not isinstance(document, dict):
        raise ValueError("a YAML document must be a mapping")
    return document


def _rows(spark: SparkSession, items, schema: str, what: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    if not isinstance(items, list) or not items or not all(isinstance(x, dict) for x in items):
        raise ValueError(f"{what} must be a list of mappings")
    if unknown := {k for x in items for k in x} - set(names):
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return spark.createDataFrame([tuple(x.get(n) for n in names) for x in items], schema)


def catalog_code() -> Column:
    """Of a catalogue row: needed texts, the record cap, and for external adapters a pinned revision and the train split."""
    external = F.col("adapter").isin(*PINNED_ADAPTERS)
    parquet = F.col("adapter") == "esci_query_parquet"
    optional = lambda c: F.col(c).isNull() | records.filled(c)
    return records.broken(
        (F.forall(F.array("source", "dataset_url", "artifact_url", "license", "usage_scope", "source_role", "adapter"), lambda x: F.length(x) > 0) & F.col("enabled").isNotNull(), "missing_field"),
        (optional("dataset_id") & optional("revision") & optional("split"), "blank_field"),
        (F.col("max_records").between(1, MOST_RECORDS), "record_cap"),
        (~external | F.col("revision").rlike("^[0-9a-f]{40}$"), "unpinned_revision"),
        (~external | (F.col("split") == "train"), "not_train"),
        (~external | parquet | F.col("dataset_id").isNotNull(), "no_dataset"),
        (~parquet | (F.col("dataset_id") == "parquet"), "not_parquet"),
        (~parquet | F.col("artifact_url").rlike(r"^https://[^/?#]+"), "not_https"),
    )


def load_source_catalog(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Sources of a catalogue file in order; every row must be sound and every name new. version: what the file must say it is."""
    document = read_yaml(spark, path)
    if version is not None and document.get("version") != version:
        raise ValueError("unsupported source catalogue")
    items = document.get("sources")
    rows = _rows(spark, [{"max_records": USUAL_RECORDS} | x if isinstance(x, dict) else x for x in items] if isinstance(items, list) else items, CATALOG, "sources")
    if not rows.where(catalog_code().isNotNull()).isEmpty() or not duplicates(rows, "source").isEmpty():
        raise ValueError("a source is not sound or is named twice")
    order = spark.createDataFrame([(x["source"], k) for k, x in enumerate(items)], "source string, position int")
    return rows.join(F.broadcast(order), "source")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a crawl manifest with defaults filled in: unknown fields, repeated URLs or domains and URLs that break a rule are errors."""
    document = read_yaml(spark, path)
    domains, items = document.get("allowed_domains"), document.get("sources")
    if not isinstance(domains, list) or not domains or not all(isinstance(d, str) and d.strip() for d in domains) or len(set(domains)) != len(domains):
        raise ValueError("allowed_domains must be distinct names")
    if not isinstance(items, list) or not items:
        raise ValueError("a manifest needs sources")
    lines = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in items], "row string")
    rows = lines.select(records.manifest_source(F.col("row")).alias("s")).select("s.*")
    ship(spark)
    checked = rows.withColumn("verdict", grammar.url_check(set(domains))(F.col("url")))
    if not checked.where("code is not null or verdict <> 'ok'").isEmpty() or not duplicates(rows, "url").isEmpty():
        raise ValueError("a source is not sound or is listed twice")
    return rows.drop("code").withColumn("terms_review_status", records.terms_status(F.col("terms_review_status"), F.col("terms_review")))


def bounded_files(spark: SparkSession, path: str, most_bytes: int = FILE_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """Files with their contents; a file or a sum beyond its cap is an error, found from lengths before any content is read."""
    files = spark.read.format("binaryFile").load(path)
    largest, total = files.agg(F.max("length"), F.sum("length")).first()
    if (largest or 0) > most_bytes or (total or 0) > total_bytes:
        raise ValueError("files exceed their byte cap")
    return files.select("path", "content")


def robots_allow(crawler: str):
    """UDF (robots text, url) of whether a crawler may fetch a URL."""

    @F.pandas_udf("boolean")
    def run(robots: pd.Series, urls: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}

        def one(text, url):
            if text not in known:
                known[text] = RobotFileParser()
                known[text].parse((text or "").splitlines())
            return known[text].can_fetch(crawler, url)

        return pd.Series([one(t, u) for t, u in zip(robots, urls)], dtype=bool)

    return run


# --- seeds --------------------------------------------------------------------------------------------------------


def seed_manifest(seeds: DataFrame) -> DataFrame:
    """Seeds by source and licence."""
    return seeds.groupBy("source", "license").agg(F.count(F.lit(1)).alias("n"))


def collect_seeds(spark: SparkSession, catalog: DataFrame, parts: dict[str, DataFrame], path: str, retrieved_at: str, enabled: list[str] | None = None) -> DataFrame:
    """The whole ingest: allowed sources, their adapted rows in order and up to each cap, first of equal texts, seeds and then the manifest written."""
    chosen = [r.asDict() for r in readers.governed(catalog, enabled).orderBy("position").collect()]
    made = []
    for spec in chosen:
        rows = parts[spec["source"]].orderBy("ordinal").limit(spec["max_records"])
        fixed = {"provenance_url": spec["dataset_url"], "license": spec["license"], "usage_scope": spec["usage_scope"], "source_role": spec["source_role"], "retrieved_at": retrieved_at, "adapter_version": "v1"}
        made.append(rows.withColumns({k: F.lit(v) for k, v in fixed.items()}))
    if not made:
        raise ValueError("no source is enabled")
    seeds = readers.union_seeds(made)
    writers.write_jsonl(seeds, f"{path}/seeds")
    stored = spark.read.schema(seeds.select(*sorted(seeds.columns)).schema).json(f"{path}/seeds")
    writers.write_jsonl(seed_manifest(stored), f"{path}/_manifest")
    return stored


# --- imports ------------------------------------------------------------------------------------------------------


def cases_of(rows: DataFrame, governance: dict) -> DataFrame:
    """Sanitised cases of page texts (source_item, position, text): ids, hashes, and publication only after all three reviews."""
    approved = all(governance[f"{k}_review_status"] == "approved" for k in ("license", "terms", "content"))
    fields = {k: F.lit(v) for k, v in governance.items()} | {"publication_status": F.lit("published" if approved else "quarantined"), "data_classification": F.lit("public")}
    made = rows.withColumn("content_hash", F.sha2("text", 256)).withColumns(fields)
    return made.withColumn("source_item_id", F.sha2(F.concat_ws("\x1f", "source_dataset", "source_url", "content_hash"), 256)).withColumn("case_id", F.concat(F.lit("case-"), F.substring("source_item_id", 1, 24)))


def import_cases(spark: SparkSession, config: str, path: str) -> DataFrame:
    """Local regulatory pages of a configuration into one bundle: cases and a report, the report last.

    Every row is checked before any is read. All sources are read in one plan, each at most up to its own cap; one allocation gives every source what the
    global cap leaves to it, in configured order, and the report names the sources that it cuts short or leaves out.
    """
    document = read_yaml(spark, config)
    items = document.get("regulatory_cases") or []
    left = document.get("max_records")
    if not isinstance(left, int) or isinstance(left, bool) or not 1 <= left <= records.RECORD_CAP:
        raise ValueError("max_records must be 1 to 50000")
    if not items:
        raise ValueError("nothing to import")
    listed = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(items)], "position int, row string")
    bad = listed.select("position", records.import_row_code(F.col("row")).alias("code")).where("code is not null").orderBy("position").first()
    if bad:
        raise ValueError(f"import row {bad.position}: {bad.code}")
    found = None
    for place, item in enumerate(items):
        if item["input_type"] != "local_html":
            raise ValueError("crawled artifacts are imported by readers.verified_artifacts and cases_of")
        host = urlsplit(item["source_url"]).hostname
        if grammar.url_verdict(item["source_url"], set(item["allowed_domains"])) != "ok":
            raise ValueError(f"the source URL at {host} is not allowed")
        files = bounded_files(spark, item["local_html_path"], document.get("max_file_bytes", FILE_BYTES), document.get("max_total_bytes", TOTAL_BYTES))
        pages = files.select(F.xxhash64("path").alias("page_id"), "path", F.col("content").cast("string").alias("html"), F.sha2("content", 256).alias("source_content_hash"))
        texts = readers.page_cases(pages, "page_id", "html", most=min(left, item["max_records"]))
        rows = texts.join(pages.drop("html"), "page_id").select(F.lit(str(place)).alias("source"), "path", "position", "text", "source_content_hash")
        found = rows if found is None else found.unionByName(rows)
    found = stored(found, "import-texts")
    listed = spark.createDataFrame([(str(k), k, x["max_records"]) for k, x in enumerate(items)], "source string, place long, most long")
    counts = listed.join(found.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").fillna(0, ["n"])
    allocation = stored(capped.allocate(counts, left), "import-allocation")
    named = {status: [items[r.place]["source_dataset"] for r in allocation.where(F.col("status") == status).orderBy("place").collect()] for status in ("truncated", "skipped")}
    taken, made = stored(capped.allocated_rows(found, allocation, ["path", "position"]), "import-rows"), None
    for place, item in enumerate(items):
        governance = {k: item[k] for k in ("source_dataset", "source_url", "retrieved_at", "license_id", "usage_scope", "license_review_status", "terms_review_status", "content_review_status")}
        rows = cases_of(taken.where(F.col("source") == str(place)).select("position", "text", "source_content_hash"), governance)
        made = rows if made is None else made.unionByName(rows)
    if not duplicates(made, "content_hash").isEmpty():
        raise ValueError("two cases hold the same text")
    writers.write_jsonl(made, f"{path}/cases")
    report = import_report(spark.read.json(f"{path}/cases")).withColumns({f"{status}_sources": F.lit(json.dumps(names)) for status, names in named.items()})
    writers.write_jsonl(report, f"{path}/_report")
    return report


def import_report(cases: DataFrame) -> DataFrame:
    """Counts of cases by publication, and the distinct licences with their scopes: one row."""
    licenses = F.array_sort(F.collect_set(F.struct("license_id", "usage_scope")))
    return cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("publication_status") == "published").alias("n_published"), F.count_if(F.col("publication_status") == "quarantined").alias("n_quarantined"), F.to_json(licenses).alias("licenses"))


# --- bundles ------------------------------------------------------------------------------------------------------


def distinct_path(out: str, *inputs: str) -> str:
    """The output path; one that equals, holds or lies below an input is an error."""
    clean = lambda p: p.rstrip("/") + "/"
    for p in inputs:
        if clean(out).startswith(clean(p)) or clean(p).startswith(clean(out)):
            raise ValueError("output and input paths must not overlap")
    return out


def load_tasks(spark: SparkSession, path: str, steps: bool = False) -> DataFrame:
    """Tasks, or trajectories with their steps, strictly read."""
    if not steps:
        return readers.read_jsonl(spark, path, TASK).withColumnsRenamed({"active_policy": "rules", "initial_observation": "observation"})
    schema = f"task struct<{','.join(':'.join(f.split(' ', 1)) for f in TASK.split(', '))}>, steps array<struct<action:string,observation:string>>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.select("task.*", "steps").withColumnsRenamed({"active_policy": "rules", "initial_observation": "observation"}).withColumn("max_turns", F.coalesce("max_turns", F.lit(3)))


def load_oracles(spark: SparkSession, path: str) -> DataFrame:
    """Oracles, strictly read; a repeated key is an error."""
    rows = readers.read_jsonl(spark, path, ORACLE)
    if not duplicates(rows, "asset_id", "policy_version").isEmpty():
        raise ValueError("repeated oracle key")
    return rows


def load_lookup_stores(spark: SparkSession, cases: str, evidence: str) -> tuple[DataFrame, DataFrame]:
    """Cases and evidence of trajectories; evidence keeps its order in the file as ordinal."""
    kept = readers.read_jsonl(spark, cases, CASE, "case_id")
    lines = readers.numbered_lines(spark, evidence).where(F.trim("value") != "")
    rows = lines.select("line", F.from_json("value", EVIDENCE, {"mode": "FAILFAST"}).alias("e")).select(F.col("line").alias("ordinal"), "e.*")
    return kept, rows


def sft_bundle(spark: SparkSession, track: str, tasks: str, oracles: str, out: str, cases: str | None = None, evidence: str | None = None, seed: int = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> dict:
    """Training rows of direct demonstrations (track_a) or trajectories (track_b), split and written with their manifest."""
    if track not in ("track_a", "track_b") or (track == "track_b") != (cases is not None and evidence is not None):
        raise ValueError("track_b needs cases and evidence, track_a takes none")
    distinct_path(out, tasks, oracles, *[p for p in (cases, evidence) if p])
    known = load_oracles(spark, oracles)
    if track == "track_a":
        rows = exports.track_a(load_tasks(spark, tasks), known)
    else:
        rows = exports.trajectories(load_tasks(spark, tasks, True), known, *load_lookup_stores(spark, cases, evidence))
    return exports.write_bundle(spark, rows, out, {"track": track}, seed, ratios)


def rl_bundle(spark: SparkSession, mode: str, tasks: str, oracles: str, out: str, seed: int = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> dict:
    """Prompt-only rows, split and written with their manifest; decisions stay out of the student's messages."""
    if not 0 <= seed < 1 << 63:
        raise ValueError("seed must be 0 to 2^63 - 1")
    distinct_path(out, tasks, oracles)
    rows = exports.track_a(load_tasks(spark, tasks), load_oracles(spark, oracles))
    if not rows.where("code is not null").isEmpty():
        raise ValueError("a row breaks a rule")
    return exports.write_bundle(spark, exports.rl_rows(rows, mode), out, {"track": "track_a", "mode": mode}, seed, ratios)
