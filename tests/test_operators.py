from fractions import Fraction
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from policyloom.functions import patterns as P
from policyloom.operators import decisions, grammar, joins, ledger, planning, similarity
from policyloom.runtime import ship


def test_strict_join_refuses_gaps(spark):
    tasks, oracles = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string"), spark.createDataFrame([(1, "x")], "k int, o string")
    assert joins.complete_join(tasks, oracles, ["k"]).count() == 1
    for left, right in ((tasks, oracles), (oracles, tasks), (tasks.union(tasks), tasks.select("k", F.col("t").alias("o")))):
        with pytest.raises(joins.Incomplete):
            joins.complete_join(left, right, ["k"], strict=True)


def test_first_wins_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4)], "k string, o int")
    assert sorted(map(tuple, joins.first_wins(df, "k", "o").collect()), key=str) == [("a", 1), (None, 4)]


def test_source_lookup_falls_back_only_when_clear(spark):
    texts = spark.createDataFrame([("s", "1", "one"), ("t", "1", "uno"), ("s", "2", "two")], "source string, source_id string, text string")
    refs = spark.createDataFrame([("s", "1"), ("x", "1"), ("x", "2")], "source string, source_id string")
    got = {(r.source, r.source_id): r.source_text for r in joins.source_lookup(refs, texts).collect()}
    assert got == {("s", "1"): "one", ("x", "1"): None, ("x", "2"): "two"}


def test_top_k_with_zero_overlap(spark):
    queries = spark.createDataFrame([("q", "a b")], "q string, t string")
    records = spark.createDataFrame([("c1", "z"), ("c2", "a"), ("c3", "a b"), ("c4", "y"), ("c5", "x")], "c string, t2 string")
    got = similarity.overlap_top_k_with_zeros(queries, records, "q", F.col("t"), "c", F.col("t2"), 4)
    assert [(r.c, r.score) for r in got.orderBy("rank").collect()] == [("c3", 2), ("c2", 1), ("c1", 0), ("c4", 0)]


def test_near_pairs_and_greedy_acceptance(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "f"), (2, base + " x", "g"), (3, base + " x", "f"), (4, "other words entirely here now", "f"), (5, "w1", "f")]
    docs = spark.createDataFrame(rows, "id int, t string, fam string")
    pairs = {(r.left_id, r.right_id) for r in similarity.near_pairs(docs, "id", F.col("t"), 0.85).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3)}
    assert {(r.left_id, r.right_id) for r in similarity.near_pairs(docs, "id", F.col("t"), 0.85, "fam").collect()} == {(1, 2), (2, 3)}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "early int, late int")
    kept = {r.id: r.kept for r in similarity.greedy_accept(docs.select("id"), edges).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_near_pairs_carry_no_sets_and_copies_are_not_paired(spark):
    """Pairs against brute force with cells of one pair's work, a list of common shingles, and copies that stay one set."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 60, 3)] + [" ".join(base)] * 30 + ["one two", "one two", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows, pairs = similarity.near_representatives(docs, "id", F.col("t"), 0.85)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} if t else set() for t in texts]
    firsts = {r.id: r["first"] for r in rows.collect()}
    assert firsts == {i: sets.index(s) for i, s in enumerate(sets) if s}
    near = {(a, b) for a, b in combinations(sorted(set(firsts.values())), 2) if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert {(r.early, r.late) for r in pairs.collect()} == near and near
    _, kept, prefixes = similarity._keyed(docs, "id", F.col("t"), None, 5, 0.85)
    close = kept.alias("a").join(kept.alias("b"), F.col("a.key") < F.col("b.key")).select("a.key", F.col("b.key").alias("other"), "a.n", F.col("b.n").alias("m"))
    for work in (100, 1 << 20):
        found = similarity.verified(close, kept, 0.85, work)
        assert found.columns == ["key", "other", "jaccard"] and found.count() == sum(len(x & y) >= 0.85 * len(x | y) for x, y in combinations([s for s in sets if s], 2))
    plain, listed = ({(r.key, r.gram) for r in similarity.set_prefixes(kept, 0.85, c).collect()} for c in ([], [r[0] for r in kept.select(F.explode("grams")).distinct().limit(40).collect()]))
    assert len(plain) == len(listed) and plain != listed


def test_only_sets_that_pairs_name_are_fetched(spark):
    """Sets may be given by what makes them from their keys: it is asked for those of the pairs alone, and a set of nothing has no prefix."""
    sets = spark.createDataFrame([(k, list(range(k, k + 20))) for k in range(9)] + [(9, [])], "key long, grams array<long>")
    close = spark.createDataFrame([(0, 1, 20, 20), (2, 8, 20, 20)], "key long, other long, n int, m int")
    asked = []

    def fetch(ids):
        asked.extend(r.key for r in ids.collect())
        return similarity.among(sets, ids, "key")

    assert [(r.key, r.other) for r in similarity.verified(close, fetch, 0.85).collect()] == [(0, 1)] and sorted(asked) == [0, 1, 2, 8]
    assert {r.key for r in similarity.set_prefixes(sets, 0.85, []).collect()} == set(range(9))
    ids = spark.createDataFrame([(3,)], "key long")
    assert [r.key for r in similarity.among(sets, ids, "key").collect()] == [3] and similarity.among(sets, ids, "key", "left_anti").count() == 9



def test_source_similarity_views(spark):
    long = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(long, "hello", long), (long, "hello", None), (None, "x", None), ("Hello", "hello ", None)], "s string, q string, r string")
    assert [r[0] for r in df.select(similarity.source_similar(df, F.col("s"), F.col("q"), F.col("r"))).collect()] == [True, False, False, True]


def exact_apportion(weights, count):
    total = sum(weights)
    shares = [Fraction(w * count, total) for w in weights]
    out = [int(s) for s in shares]
    for k in sorted(range(len(weights)), key=lambda k: out[k] - shares[k])[: count - sum(out)]:
        out[k] += 1
    return out


@pytest.mark.parametrize("weights, count", [([400, 300, 300, 300, 200, 200, 200, 100], 100), ([1, 1, 1], 2), ([7], 5), ([500, 600, 400, 500], 500)])
def test_apportion(spark, weights, count):
    frame = planning.quota_frame(spark, {f"k{i}": w for i, w in enumerate(weights)})
    got = [r.quota for r in planning.apportion(frame, count).orderBy("position").collect()]
    assert got == exact_apportion(weights, count)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6))
def test_label_thinking_margins(amounts):
    named = {f"s{i}": v for i, v in enumerate(amounts)}
    try:
        cells = planning.label_thinking_cells(named)
    except ValueError:
        return
    assert all(sum(cells[k].values()) == v and min(cells[k].values()) >= 0 for k, v in named.items())
    assert sum(c[("safe", "fast")] + c[("safe", "slow")] for c in cells.values()) == sum(amounts) // 2


def test_source_forms_fill_within_capacity():
    got = planning.allocate_forms(P.SOURCE_QUOTAS, P.QUOTAS["content_form"])
    assert {s: sum(f.values()) for s, f in got.items()} == P.SOURCE_QUOTAS
    for form, room in P.QUOTAS["content_form"].items():
        assert sum(f.get(form, 0) for f in got.values()) <= room
    # Room that a first choice takes is given back when a later source has no other.
    assert planning.allocate_forms({"a": 1, "b": 1}, {"x": 1, "y": 1}, {"a": ("x", "y"), "b": ("x",)}) == {"a": {"x": 0, "y": 1}, "b": {"x": 1}}
    with pytest.raises(ValueError):
        planning.allocate_forms({"a": 3}, {"x": 1, "y": 1}, {"a": ("x", "y")})


def test_halves_alternate(spark):
    frame = spark.createDataFrame([("a", 3, 0), ("b", 2, 1), ("c", 5, 2), ("d", 1, 3)], "key string, quota long, position int")
    assert [(r.safe, r.unsafe) for r in planning.halves(frame).orderBy("position").collect()] == [(2, 1), (1, 1), (2, 3), (1, 0)]


def test_release_is_deterministic_and_seeded(spark):
    policies = spark.createDataFrame([("p", 0, ["R1", "R2"]), ("q", 1, ["R2", "R3"])], "policy_id string, position int, rule_ids array<string>")
    plan = lambda seed: {tuple(r) for r in planning.plan_release(spark, policies, 100, seed).collect()}
    first = plan("s")
    assert first == plan("s") and first != plan("t") and len(first) == 100
    with pytest.raises(ValueError):
        planning.plan_release(spark, policies, 99, "s")


def test_round_robin(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "s string, o int")
    assert [r.o for r in planning.round_robin(df, ["s"], "o", 3).orderBy("turn", "s").collect()] == [1, 4, 2]


@pytest.mark.parametrize("right", [[True], [False], [True, False, True], [True, True, True, True]])
def test_policy_following_equals_pairs(spark, right):
    df = spark.createDataFrame([("g", r) for r in right], "g string, r boolean")
    row = decisions.policy_following(df, F.col("g"), F.col("r")).first()
    pairs = [all(p) for p in combinations(right, 2)] or right
    assert (row.comparisons, row.matches) == (len(pairs), sum(pairs))


def test_rewards(spark):
    good = '{"tool":"final_decision","arguments":{"label":"unsafe","rule_id":"R1","confidence":0.9}}'
    cases = [
        (good, good, (1.0, 1.0, 1.0)),
        (good.replace("R1", "R2"), good, (1.0, 1.0, 0.0)),
        (good.replace("unsafe", "safe"), good, (1.0, 0.0, 0.0)),
        (good.replace("0.9", "1.9"), good, (0.0, 0.0, 0.0)),
        (good.replace("0.9", '"0.9"'), good, (0.0, 0.0, 0.0)),
        (good.replace('"label"', '"label":"safe","label"'), good, (0.0, 0.0, 0.0)),
        (good.replace("0.9", '0.9,"extra":1'), good, (0.0, 0.0, 0.0)),
        (good.replace("0.9", '0.9,"risk_level":"P9"'), good, (0.0, 0.0, 0.0)),
        (good.replace("0.9", '0.9,"risk_level":"P1","next_action":"x"'), good, (1.0, 1.0, 1.0)),
        ("not json", good, (0.0, 0.0, 0.0)),
        (None, good, (0.0, 0.0, 0.0)),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "c string, s string")
    assert [tuple(r) for r in df.select(*decisions.rewards(F.col("c"), F.col("s"))).collect()] == [w for *_, w in cases]


def slow(label="unsafe", checks="- Fraud: HIT. It sells.\n- Spam: NOT HIT. No.", answer="Fraud"):
    return f"{label}\n\n<reasoning>\n[Step 1] Content Summary\nA.\n\n[Step 2] Check Risk Categories\n{checks}\n\n[Step 3] Final Judgment\nB.\n</reasoning>\n<answer>{answer}</answer>"


@pytest.mark.parametrize(
    "text, thinking, valid",
    [
        ("safe\n<answer>Safe</answer>", "fast", True),
        ("unsafe\n\n<answer>Fraud\nSpam</answer>", "fast", True),
        ("unsafe\n<answer>Fraud\nFraud</answer>", "fast", False),
        ("unsafe\n<answer>Other</answer>", "fast", False),
        ("safe\n<answer>Fraud</answer>", "fast", False),
        ("safe\n<answer>Safe</answer>\n", "fast", False),
        (slow(), "slow", True),
        (slow(answer="Spam"), "slow", False),
        (slow(label="safe", answer="Safe"), "slow", False),
        (slow("safe", "- Fraud: NOT HIT. No.\n- Spam: NOT APPLICABLE.", "Safe"), "slow", True),
        (slow("safe", "- Spam: NOT APPLICABLE.\n- Fraud: NOT HIT. No.", "Safe"), "slow", False),
        (slow("safe", "- Fraud: NOT HIT. \n- Spam: NOT APPLICABLE.", "Safe"), "slow", False),
        (slow("safe", "- Fraud: OBSERVED BUT NOT UNSAFE. Quoted.\n- Spam: NOT APPLICABLE.", "Safe"), "slow", True),
        (slow("safe", "- Fraud: MAYBE. x\n- Spam: NOT APPLICABLE.", "Safe"), "slow", False),
    ],
)
def test_completion_grammar(spark, text, thinking, valid):
    df = spark.createDataFrame([(text, thinking)], "t string, k string")
    got = df.select(grammar.completion(F.col("t"), F.col("k"), F.array(F.lit("Fraud"), F.lit("Spam"))).alias("p")).first().p
    assert got.valid == valid


@pytest.mark.parametrize(
    "url, verdict",
    [
        ("https://a.org/x", "ok"), ("http://a.org/x", "not_https"), ("https://127.0.0.1/", "numeric_host"), ("https://localhost/", "local_or_ip"), ("https://b.org/", "not_allowed"),
        ("https://u:p@a.org/", "credentials"), ("https://a.org:8443/", "port"), ("https://a.org:443/", "ok"), ("https://a.org/#x", "fragment"), ("https://a.org/%2561ccount/", "account_page"),
        ("https://a.org/?api_key=1", "secret_parameter"), ("https://a.org/?q=1", "ok"), ("https://-a.org/", "bad_host"), ("https://a.org:x/", "invalid"),
    ],
)
def test_url_rules(url, verdict):
    assert grammar.url_verdict(url, {"a.org"}) == verdict


def test_replay(spark):
    rows = [(1, 0, "tool", True), (1, 1, "final", True), (2, 0, "bad", True), (2, 1, "tool", True), (3, 0, "tool", True), (3, 1, "tool", True), (4, 0, "final", False)]
    steps = spark.createDataFrame(rows, "e int, o int, k string, ok boolean")
    got = {r.e: (r.turns, r.done, round(r.reward, 6), r.status) for r in grammar.replay(steps, "e", "o", "k", 2, "ok", "ok").collect()}
    assert got == {1: (2, True, 1.92, "final"), 2: (0, True, -1.0, "invalid"), 3: (2, True, -0.16, "turn_limit"), 4: (1, True, 0.0, "final")}


def test_budget_refusal_is_final(spark):
    df = spark.createDataFrame([(1, 1, 4.0), (1, 2, 9.0), (1, 3, 0.0)], "g int, s int, c double")
    assert [r.granted for r in ledger.reservations(df, ["g"], "s", F.col("c"), 10.0, 5).orderBy("s").collect()] == [True, False, False]


def test_policy_pairs_and_rendering(spark):
    rows = spark.createDataFrame([("a", "{}", "{1}")], "k string, b string, c string")
    got = grammar.policy_pairs(rows, "k", "rule_addition", F.col("b"), F.col("c")).collect()
    assert [(r.variant, r.label) for r in got] == [("before", "safe"), ("after", "unsafe")] and got[0].group_id == got[1].group_id and got[0].policy_version != got[1].policy_version
    rules = spark.createDataFrame([([("R2", "B", "b", ["e"], 5), ("R1", "A", "a", [], 9)],)], "r array<struct<rule_id:string,title:string,text:string,exceptions:array<string>,priority:int>>")
    assert rules.select(grammar.policy_text(F.col("r"))).first()[0] == f"{grammar.POLICY_HEADING}\n[R2] B: b\n{grammar.EXCEPTION_MARK}e\n[R1] A: a"


def test_udf_queries_ship_code(spark):
    ship(spark)
    assert spark.createDataFrame([("https://a.org",), (None,)], "u string").select(grammar.url_check({"a.org"})("u")).collect() == [("ok",), ("invalid",)]


def test_sources_are_placed_by_quota_and_form(spark):
    policies = spark.createDataFrame([("p", 0, ["R1", "R2"]), ("q", 1, ["R2", "R3"])], "policy_id string, position int, rule_ids array<string>")
    rows = planning.plan_release(spark, policies, 100, "s").cache()
    seeds = spark.createDataFrame([(s, f"{s}-{k}") for s in P.SOURCE_QUOTAS for k in range(15)], "source string, source_id string")
    got = planning.assign_sources(rows, seeds, 100, "s").collect()
    named = [r for r in got if r.source]
    assert len(got) == 100 and len({r.source_id for r in named}) == len(named)
    counts = {s: sum(r.source == s for r in named) for s in P.SOURCE_QUOTAS}
    assert counts == planning.source_amounts(100) == {"uci_sms_spam": 10, "uci_youtube_spam": 5, "nemotron_aegis_v2": 6, "civil_comments": 5, "amazon_esci": 4}
    assert all(r.content_form in P.SOURCE_FORMS[r.source] for r in named)
    with pytest.raises(ValueError):
        planning.assign_sources(rows, seeds.limit(3), 100, "s")


def test_blueprints_are_whole(spark):
    rules = lambda *own: [{"rule_id": r, "title": f"title {r}", "text": "x", "exceptions": e} for r, e in own]
    kind = "policy_id string, position int, rules array<struct<rule_id: string, title: string, text: string, exceptions: array<string>>>"
    policies = spark.createDataFrame([("p", 0, rules(("R1", ["e1"]), ("R2", ["e2", "e3"]))), ("q", 1, rules(("R2", ["e2", "e3"]))), ("r", 2, rules(("R3", [])))], kind)
    seeds = spark.createDataFrame([(s, f"{s}-{k}", f"{s}{k}") for s in P.SOURCE_QUOTAS for k in range(12)], "source string, source_id string, content_hash string")
    got = planning.plan_blueprints(spark, policies, seeds, 100, "s").collect()
    assert len(got) == len({r.blueprint_id for r in got}) == len({r.family_id for r in got}) == 100
    count = lambda axis: sorted(sum(r[axis] == v for r in got) for v in {r[axis] for r in got})
    assert count("tone") == [12] * 4 + [13] * 4 and count("noise_profile") == [20] * 5 and sum(r.source_ref is not None for r in got) == 30
    assert all(r.source_ref is None or r.source_ref.content_hash == r.source_ref.source_id.replace("-", "") for r in got)
    targets = [r for r in got if r.target_exception]
    assert {r.slot for r in targets} == {r.slot for r in got if r.intended_label == "safe" and r.difficulty == "exception"}
    uses = [sum(r.target_exception == e for r in targets) for e in ("e1", "e2", "e3")]
    assert min(uses) > 0 and max(uses) - min(uses) <= 1
    assert all(r.target_exception_rule_id in r.active_rule_ids for r in targets) and {r.policy_id for r in targets if r.target_exception == "e2"} == {"p", "q"}
    for r in got:
        assert r.active_rule_titles == [f"title {x}" for x in r.active_rule_ids] and r.tool_capable is False
        assert r.intended_answers == ([f"title {r.primary_rule_id}"] if r.intended_label == "unsafe" else []) and (r.primary_rule_id is None) == (r.intended_label == "safe")


def test_a_source_is_ranked_from_lots_not_whole(spark):
    """The drawn records are the first of each source in order; no window over a whole source is planned."""
    seeds = spark.range(4000).select(F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("source"), F.col("id").cast("string").alias("source_id"))
    order = F.sha2(F.concat_ws("|", "source", "source_id"), 256)
    got = {(r.source, r.turn): r.source_id for r in planning.first_by_source(seeds, order, 7).collect()}
    rows = [(r.source, r.o, r.source_id) for r in seeds.select("source", "source_id", order.alias("o")).collect()]
    assert got == {(s, k + 1): i for s in ("big", "small") for k, (_, _, i) in enumerate(sorted(r for r in rows if r[0] == s)[:7])}
