import pandas as pd
import pytest
from pyspark.sql import functions as F

from policyloom.operators import generation as N
from policyloom.runtime import ship


def test_requests_and_blind_review(spark):
    blueprints = spark.createDataFrame([(1, "b1", "p", "s", "1"), (2, "b2", "p", None, None)], "ordinal int, blueprint_id string, policy_id string, source string, source_id string")
    policies = spark.createDataFrame([("p", ["r"])], "policy_id string, rules array<string>")
    texts = spark.createDataFrame([("s", "1", "t")], "source string, source_id string, text string")
    assert {(r.blueprint_id, r.source_text) for r in N.content_requests(blueprints, policies, texts).collect()} == {("b1", "t"), ("b2", None)}
    seen = N.review_requests(spark.createDataFrame([("b1", "p", "q", None, "unsafe")], "blueprint_id string, policy_id string, query string, response string, intended_label string"), policies)
    assert "intended_label" not in seen.columns
    assert [r.batch for r in N.batches(blueprints, 1).orderBy("ordinal").collect()] == [0, 1]
    with pytest.raises(ValueError):
        N.batches(blueprints, 5)


def test_replies_need_the_expected_ids(spark):
    df = spark.createDataFrame([('[{"blueprint_id":"b","query":"q"}]', ["b"]), ('[{"blueprint_id":"x","query":"q"}]', ["b"]), ("?", ["b"])], "reply string, ids array<string>")
    got = N.parse_replies(df, "reply", "ids", "struct<blueprint_id:string,query:string>").collect()
    assert [(r.blueprint_id, r.code) for r in got] == [("b", None), ("b", "parse_invalid_batch"), ("b", "parse_invalid_batch")]


def test_verdicts(spark):
    df = spark.createDataFrame([("safe", []), ("safe", ["x"]), ("unsafe", ["a"]), ("unsafe", ["b"]), ("unsafe", ["a", "a"])], "l string, a array<string>")
    code = N.verdict_code(F.col("l"), F.col("a"), F.lit("unsafe"), F.array(F.lit("a")))
    assert [r[0] for r in df.select(code).collect()] == ["semantic_mismatch", "semantic_review_invalid", "accepted", "semantic_mismatch", "semantic_review_invalid"]


def test_rounds_settle_in_order(spark):
    ship(spark)
    blueprints = spark.createDataFrame([(1, "b1"), (2, "b2"), (3, "b3")], "ordinal int, blueprint_id string")

    def provider(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"blueprint_id": frame.blueprint_id, "query": ["same" if i != "b3" else "bad" for i in frame.blueprint_id], "response": [None] * len(frame)}).astype({"response": object})

    out = N.run_rounds(blueprints, provider, lambda rows: F.when(F.col("query") == "bad", "wrong_language").otherwise("accepted"), 2)
    assert {r.blueprint_id: (r.attempt, r.code) for r in out.collect()} == {"b1": (1, "accepted"), "b2": (2, "exact_duplicate"), "b3": (2, "wrong_language")}
    row = N.manifest_status(blueprints, out).first()
    assert (row.accepted, row.rejected, row.pending, row.status, row.exit_code) == (1, 2, 0, "incomplete", 2)


def test_tools_and_quality(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"], "required"), (["b", "a"], ["a", "b"], "required"), (["c"], ["a"], "auto"), (["a"] * 3, ["a"], "auto"), ([], ["a"], "auto")], "called array<string>, tool_names array<string>, tool_policy string")
    assert [r.tool_code for r in N.tool_replay(df).collect()] == ["accepted", "required_tool_order", "tool_not_allowed", "too_many_tool_calls", "accepted"]
    runs = spark.createDataFrame([(True, True, True), (True, False, False)], "f boolean, e boolean, m boolean")
    assert N.quality_status(runs, F.col("f"), F.col("e"), F.col("m")).first().status == "pass"
