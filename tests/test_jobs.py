"""Jobs over files, the tool stores, teachers and the command line."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from policyloom import cli, jobs
from policyloom.operators import exports, records, tools

RULES = [{"rule_id": "R1", "title": "Fraud", "text": "No deceit.", "exceptions": ["Satire"], "priority": 2}, {"rule_id": "R2", "title": "Spam", "text": "No bulk mail.", "exceptions": [], "priority": 1}]
ORACLES = [
    {"asset_id": "a1", "policy_version": "v1", "label": "unsafe", "rule_id": "R1", "risk_level": "P1", "next_action": None},
    {"asset_id": "a2", "policy_version": "v1", "label": "safe", "rule_id": None, "risk_level": None, "next_action": "hold"},
]


def lines(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def task(asset, **more):
    return {"asset_id": asset, "policy_version": "v1", "active_policy": RULES, "initial_observation": f"text of {asset}", "images": [], "videos": [], "max_turns": 3} | more


def rows_of(path):
    return [json.loads(x) for f in path.glob("rows/split=*/*.json") for x in f.read_text(encoding="utf-8").splitlines()]


def test_sft_and_rl_bundles(spark, tmp_path):
    tasks, oracles = lines(tmp_path / "tasks.jsonl", [task("a1"), task("a2")]), lines(tmp_path / "oracles.jsonl", ORACLES)
    args = ["--tasks", tasks, "--oracles", oracles]
    assert cli.main(["sft", "--track", "track_a", *args, "--out", str(tmp_path / "sft")]) == 0
    made = rows_of(tmp_path / "sft")
    decisions = sorted(json.loads(r["messages"][2]["content"])["arguments"]["label"] for r in made)
    assert decisions == ["safe", "unsafe"] and all([m["role"] for m in r["messages"]] == ["system", "user", "assistant"] for r in made)
    manifest = json.loads(spark.read.text(str(tmp_path / "sft/_manifest")).first()[0])
    assert sum(manifest["split_counts"].values()) == 2 and manifest["track"] == "track_a"
    assert cli.main(["rl", "--mode", "opsd", *args, "--out", str(tmp_path / "rl")]) == 0
    assert all(len(r["messages"]) == 2 and "privileged_solution" in r["teacher_prompt"] for r in rows_of(tmp_path / "rl"))
    # A missing oracle, and an output inside an input, are refused.
    short = lines(tmp_path / "one.jsonl", ORACLES[:1])
    assert cli.main(["sft", "--track", "track_a", "--tasks", tasks, "--oracles", short, "--out", str(tmp_path / "x")]) == 1
    with pytest.raises(ValueError):
        jobs.distinct_path(f"{tmp_path}/a/b", f"{tmp_path}/a")


def test_trajectory_bundle_recomputes_observations(spark, tmp_path):
    cases = lines(tmp_path / "cases.jsonl", [{"case_id": "c2", "text": "fake offer"}, {"case_id": "c1", "text": "tea"}, {"case_id": "c3", "text": "offer"}])
    evidence = lines(tmp_path / "evidence.jsonl", [{"evidence_id": "e2", "asset_id": "a2", "kind": "ocr", "content": "x"}, {"evidence_id": "e1", "asset_id": "a2", "kind": "case", "content": "y"}])
    search = {"action": '{"tool":"search_case","arguments":{"query":"fake offer","top_k":3}}', "observation": '[{"case_id":"c2","text":"fake offer"},{"case_id":"c3","text":"offer"},{"case_id":"c1","text":"tea"}]'}
    inspect = {"action": '{"tool":"inspect_evidence","arguments":{"kinds":["case","ocr"]}}', "observation": '[{"content":"x","kind":"ocr","evidence_id":"e2","asset_id":"a2"},{"evidence_id":"e1","asset_id":"a2","kind":"case","content":"y"}]'}
    told = [{"task": task("a1"), "steps": [search]}, {"task": task("a2"), "steps": [inspect, search]}]
    trail, oracles = lines(tmp_path / "trail.jsonl", told), lines(tmp_path / "oracles.jsonl", ORACLES)
    jobs.sft_bundle(spark, "track_b", trail, oracles, str(tmp_path / "out"), cases, evidence)
    assert sorted(len(r["messages"]) for r in rows_of(tmp_path / "out")) == [5, 7]
    told[0]["steps"][0]["observation"] = "[]"
    with pytest.raises(ValueError):
        jobs.sft_bundle(spark, "track_b", lines(tmp_path / "trail2.jsonl", told), oracles, str(tmp_path / "out2"), cases, evidence)


def test_teachers_may_look_up_once(spark):
    tasks = spark.createDataFrame([("a1", "v1", RULES, "x", 3), ("a2", "v1", RULES, "y", 3), ("a3", "v1", RULES, "z", 1), ("a4", "v1", RULES, "z", 3)], f"asset_id string, policy_version string, rules {jobs.RULES}, observation string, max_turns int")
    oracles = spark.createDataFrame([(f"a{k}", "v1", "unsafe", "R1", None, None) for k in range(1, 5)], "asset_id string, policy_version string, label string, rule_id string, risk_level string, next_action string")

    def provider(frame):
        final = '{"tool":"final_decision","arguments":{"label":"unsafe","rule_id":"R1","confidence":1}}'
        look = '{"tool":"get_rule_detail","arguments":{"rule_id":"R2"}}'
        asset = frame["task"].map(lambda t: json.loads(t)["asset_id"])
        wrong = final.replace("R1", "R2")
        reply = [look if p == "first" and a in ("a2", "a3") else wrong if a == "a4" else final for p, a in zip(frame["phase"], asset)]
        return frame[["step_id"]].assign(reply=reply)

    empty = spark.createDataFrame([], "case_id string, text string"), spark.createDataFrame([], "ordinal long, evidence_id string, asset_id string, kind string, content string")
    got = {r.asset_id: r for r in exports.teacher_samples(tasks, oracles, *empty, provider).collect()}
    assert [got[f"a{k}"].code for k in range(1, 5)] == [None, None, "no_turn_for_lookup", "decision_differs"]
    assert len(got["a1"].messages) == 3 and len(got["a2"].messages) == 5 and got["a2"].trajectory_type == "one_lookup"
    assert json.loads(got["a2"].messages[3].content.removeprefix(exports.OBSERVATION_MARK))["title"] == "Spam"


def test_tool_stores(spark, tmp_path):
    case = {"case_id": "c1", "text": "Fake offer", "summary": "s", "source_type": "t", "source_id": "i"}
    claim = {"evidence_id": "e1", "claim": "cures all", "product_type": "tea", "stance": "refutes", "summary": "s", "source_type": "t", "source_id": "i"}
    place = {"destination_id": "d1", "indicators": ["Shop-1.example"], "destination_type": "site", "risk_signals": [], "source_type": "t", "source_id": "i"}
    for name, row in (("cases", case), ("claim_evidence", claim), ("destinations", place)):
        lines(tmp_path / f"{name}.jsonl", [row])
    stores, mark = tools.load_stores(spark, str(tmp_path))
    expected = hashlib.sha256(b"".join(n.encode() + (tmp_path / n).read_bytes() for n in tools.STORES))
    assert mark == expected.hexdigest() and tools.store_violations(*stores.values()).count() == 0
    calls = [(1, "search_cases", '{"query":"OFFER"}'), (2, "verify_claim", '{"claim":"cures","product_type":"tea"}'), (3, "verify_claim", '{"claim":"cures"}'), (4, "inspect_destination", '{"indicator":"shop1 EXAMPLE"}'), (5, "x", "{}"), (6, "search_cases", "no"), (7, "search_cases", '{"query":"q","top_k":2.0}')]
    got = {r.call_id: r for r in tools.execute(spark.createDataFrame(calls, "call_id long, name string, arguments string"), *stores.values()).collect()}
    assert [got[k].status for k in range(1, 8)] == ["ok", "ok", "not_found", "ok", "error", "error", "error"]
    assert json.loads(got[2].content)["results"] == [{"evidence_id": "e1", "source_id": "i", "source_type": "t", "stance": "refutes", "summary": "s"}]
    assert got[6].content == '{"error":"invalid_arguments","status":"error"}' and json.loads(got[4].content)["result"]["risk_signals"] == []
    twice = stores["destinations"].unionByName(stores["destinations"].withColumn("destination_id", F.lit("d2")))
    assert [r.code for r in tools.store_violations(stores["cases"], stores["claim_evidence"], twice).collect()] == ["shared_indicator"]


def test_prompts_keep_placeholders_of_rules(spark):
    rules = F.array(F.struct(F.lit("R1").alias("rule_id"), F.lit("T").alias("title"), F.lit("{{OUTPUT_FORMAT}}").alias("text"), F.array().cast("array<string>").alias("exceptions")))
    made = spark.range(1).select(exports.guard_prompt(rules, F.lit("fast"), F.array().cast("array<string>")).alias("p")).first().p
    assert "### T\n{{OUTPUT_FORMAT}}" in made and made.endswith("then the answer.")
    with pytest.raises(Exception, match="way of thinking"):
        spark.range(1).select(exports.guard_prompt(rules, F.lit("odd"), F.array().cast("array<string>"))).collect()


def test_catalog_and_manifest(spark, tmp_path):
    row = "{source: a, dataset_url: u, artifact_url: u, license: CC0-1.0, usage_scope: s, source_role: r, adapter: sms, enabled: true}"
    good = tmp_path / "c.yaml"
    good.write_text(f"version: v9\nsources:\n  - {row}\n  - {row.replace('source: a', 'source: b')}\n")
    assert [(r.source, r.position, r.max_records) for r in jobs.load_source_catalog(spark, str(good), "v9").orderBy("position").collect()] == [("a", 0, 5000), ("b", 1, 5000)]
    for text in (f"sources:\n  - {row}\n  - {row}\n", "sources: []\n", f"sources:\n  - {row}\nsources: []\n", "sources:\n  - {source: a, odd: 1}\n"):
        bad = tmp_path / "bad.yaml"
        bad.write_text(text)
        with pytest.raises(ValueError):
            jobs.load_source_catalog(spark, str(bad))
    listed = tmp_path / "m.yaml"
    listed.write_text("allowed_domains: [a.example.com]\nsources:\n  - https://a.example.com/x\n  - {url: 'https://a.example.com/y', terms_review: reviewed}\n")
    assert sorted(r.terms_review_status for r in jobs.load_manifest(spark, str(listed)).collect()) == ["approved", "pending"]
    assert cli.main(["manifest", "--path", str(listed)]) == 0
    listed.write_text("allowed_domains: [a.example.com]\nsources:\n  - https://b.example.com/x\n")
    assert cli.main(["manifest", "--path", str(listed)]) == 1


def test_import_takes_records_up_to_the_cap(spark, tmp_path):
    page = tmp_path / "p.html"
    page.write_text("<article><p>A first long enough paragraph.</p><p>A second long enough paragraph.</p><p>short</p></article>")
    row = {"input_type": "local_html", "max_records": 5, "source_dataset": "one", "license_id": "CC0-1.0", "usage_scope": "research_only", "license_review_status": "approved", "terms_review_status": "approved", "content_review_status": "approved",
           "local_html_path": str(page), "source_url": "https://a.example.com/x", "allowed_domains": ["a.example.com"], "retrieved_at": "2026-01-01T00:00:00Z"}
    config = tmp_path / "c.yaml"
    config.write_text(json.dumps({"max_records": 1, "regulatory_cases": [row, row | {"source_dataset": "two"}]}))
    report = jobs.import_cases(spark, str(config), str(tmp_path / "out")).first()
    assert (report.n_cases, report.n_published, report.truncated_sources, report.skipped_sources) == (1, 1, '["one"]', '["two"]')
    # Two files of one source keep their own hashes, and one cap goes over all sources in order.
    (tmp_path / "two").mkdir()
    for k in (1, 2):
        (tmp_path / "two" / f"{k}.html").write_text(f"<article><p>file {k} has a paragraph of its own</p><p>and file {k} has another one</p></article>")
    config.write_text(json.dumps({"max_records": 4, "regulatory_cases": [row | {"local_html_path": str(tmp_path / "two"), "max_records": 3}, row | {"source_dataset": "two"}]}))
    report = jobs.import_cases(spark, str(config), str(tmp_path / "out3")).first()
    cases = spark.read.json(str(tmp_path / "out3" / "cases"))
    assert report.n_cases == cases.count() == 4 and json.loads(report.skipped_sources) == []
    assert cases.where("source_dataset = 'one'").select("source_content_hash").distinct().count() == 2
    config.write_text(json.dumps({"max_records": 1, "regulatory_cases": [row | {"license_id": "tbd"}]}))
    with pytest.raises(ValueError, match="ungoverned_license"):
        jobs.import_cases(spark, str(config), str(tmp_path / "out2"))
    with pytest.raises(ValueError, match="byte cap"):
        jobs.bounded_files(spark, str(page), 10)


def test_finite_numbers(spark):
    got = spark.sql("SELECT * FROM VALUES (1.0D), (double('NaN')), (double('-Infinity')), (null) t(x)").select(records.finite(F.col("x")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, True]
