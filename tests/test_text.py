import json
import re
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from policyloom.functions import gates as G
from policyloom.functions import patterns as P
from policyloom.functions import pii
from policyloom.functions import text as X
from policyloom.runtime import ship


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_seed_normalisation_equals_python(spark):
    texts = ["  a\tb\n c ", "mail x.y@z.org now", "see https://a.b/c?d=1 ok", "call +1 (555) 123-4567 now", "é café ½", "", "x" * 5001, None]

    def python(t):
        if t is None:
            return None
        t = re.sub(P.SEED_EMAIL, "[EMAIL]", t)
        t = " ".join(re.sub(P.SEED_PHONE, "[PHONE]", re.sub(P.SEED_URL, "[URL]", t)).split())
        return t if 0 < len(t) <= 5000 else None

    got = values(spark, [(t,) for t in texts], "t string", X.normalize_seed(F.col("t")))
    assert [g[0] for g in got] == [python(t) for t in texts]


def test_word_counts_are_unicode(spark):
    texts = ["don't stop", "é café", "a_b c-d", "", "日本 x"]
    got = values(spark, [(t,) for t in texts], "t string", X.word_count(F.col("t")))
    assert [g[0] for g in got] == [len(re.findall(r"\b[\w']+\b", t)) for t in texts]


def test_shingles_and_jaccard(spark):
    got = values(spark, [("a b c d e f", "a b c d"), ("a b c d e", "A  b c d E")], "x string, y string", X.grams(F.col("x")), X.grams(F.col("y")), X.jaccard(X.grams(F.col("x")), X.grams(F.col("y"))))
    assert got == [(["a b c d e", "b c d e f"], [], 0.0), (["a b c d e"], ["a b c d e"], 1.0)]


def test_full_folding(spark):
    ship(spark)
    texts = ["Straße", "ＡＢＣ", "ﬁx", "İ", None]
    got = values(spark, [(t,) for t in texts], "t string", X.nfkc_casefold("t"))
    assert [g[0] for g in got] == [None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts]


def test_canonical_key_tells_missing_from_empty(spark):
    got = values(spark, [("Q", None), ("q ", "")], "q string, r string", X.canonical(F.col("q"), F.col("r")))
    assert got[0] != got[1] and got[0][0] == "query\x1fq\x1eresponse:none"


def test_split_is_stable_and_checked(spark):
    got = values(spark, [("a",), ("a",), ("b",)], "k string", X.split_of(F.col("k")))
    assert got[0] == got[1] and got[0][0] in ("train", "dev", "holdout")
    with pytest.raises(ValueError):
        X.split_of(F.col("k"), ratios=(0.5, 0.1, 0.1))


def test_strict_json(spark):
    ship(spark)
    texts = ['{"a":1}', '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', '{"a":NaN}', "[1]", "x", None]
    got = values(spark, [(t,) for t in texts], "t string", X.strict_json_object("t"))
    assert [g[0] for g in got] == [True, False, False, False, False, False, False]
    got = values(spark, [('{"a":[{"gold_x":1}]}',), ('{"a":1}',)], "t string", X.holds_forbidden_field("t"))
    assert [g[0] for g in got] == [True, False]


def test_canonical_json(spark):
    ship(spark)
    got = values(spark, [('{"b": 1, "a": "é"}',)], "t string", X.canonical_json()(F.col("t")), X.canonical_json(True)(F.col("t")))
    assert got == [('{"a":"é","b":1}', json.dumps({"a": "é", "b": 1}, separators=(",", ":")))]


@given(st.integers(0, 10**15))
def test_check_digit(number):
    body = str(number)
    assert sum(pii.luhn(body + str(c)) for c in range(10)) == 1


@pytest.mark.parametrize(
    "text", ["write to a.b@corp.com", "see https://example.com/x", "www.site.org", "host site.co.uk", "card 4111 1111 1111 1111", "ask @someone", "password: hunter2abcd", "sk_live_abcdefgh1234", "account number 123456789", "call 555-123-4567 89"]
)
def test_identifiers_are_refused(text):
    assert pii.holds_identifier(text)


@pytest.mark.parametrize(
    "text", ["write to a.b@shop.test", "see https://demo.shop.test/x", "ask @synthetic_bob", "password policy", "order id: ABC-123456", "8.252.9.145", "123-45-6789", "two words"]
)
def test_reserved_and_harmless_pass(text):
    assert not pii.holds_identifier(text)


@pytest.mark.parametrize(
    "text, out",
    [
        ("mail a@b.com or c@d.test", "mail [EMAIL] or c@d.test"),
        ("ssn 123-45-6789 x", "ssn [SSN] x"),
        ("at 8.252.9.145 and 999.1.1.1", "at [NETWORK_ID] and 999.1.1.1"),
        ("dob: 1990-01-02", "dob: [DOB]"),
        ("mac 00:1A:2b:3c:4d:5e", "mac [NETWORK_ID]"),
        ("card 4111111111111111", "card [PAYMENT_CARD]"),
        ("lives at 12 main street", "lives at [ADDRESS]"),
        ("hello @bob and @test_bob", "hello [HANDLE] and @test_bob"),
        ("contact: Jane Doe", "contact: [PERSON]"),
        ("met John Smith there", "met [PERSON] there"),
        ("  ", None),
    ],
)
def test_redaction(text, out):
    assert pii.redacted(text) == out


HARM = [
    ("First mix the explosive and pack the steel pipe. Then ignite it.", True),
    ("First clone the login page, then capture passwords and deploy it.", True),
    ("First write a malware payload. Then deploy the malware to the servers.", True),
    ("First read the malware report. Then write about it.", False),
    ("Mix the explosive and pack the pipe.", False),
    ("First mix flour, then bake.", False),
    ("First download the malware sample in an isolated sandbox. Then execute forensic analysis.", False),
]


def test_harm_gate(spark):
    got = values(spark, [(t,) for t, _ in HARM], "t string", G.operational_harm(F.col("t")))
    assert [g[0] for g in got] == [h for _, h in HARM]


def test_first_failure_order(spark):
    rows = [("[user] hola", "query", None, "headline"), ("hello there", "query", "x", "headline"), ("это текст", "query", None, "short"), ("this training sample here", "query", None, "headline"), ("hi", "query", None, "long"), ("hi", "query", None, "headline")]
    df = spark.createDataFrame(rows, "t string, shape string, r string, bin string")
    code = G.first_failure(*G.local_gates(F.col("t"), F.col("shape"), F.col("r"), F.col("bin"), F.lit(False)))
    assert [r[0] for r in df.select(code).collect()] == ["literal_role_wrapper", "schema_or_shape", "wrong_language", "generation_meta_language", "length_out_of_bin", "accepted"]


def test_log_sanitising(spark):
    got = values(spark, [("api_key=abc; Bearer xyz, a@b.co",), ("😀" * 2050,)], "t string", X.sanitize_log(F.col("t")))
    assert got[0][0] == "api_key=[REDACTED]; Bearer [REDACTED], [REDACTED_EMAIL]"
    assert got[1][0] == "😀" * 2048 + "...[truncated]"


def test_patterns_run_only_where_they_can_match():
    """A text without marks runs few patterns; whatever a pattern finds, in any case of letters, may_hold() has allowed."""
    held = ["a@b.example", "www.X.example", "HTTP://x", "123-45-6789", "DOB 1/2/1990", "PaSSport: AB12345", "cu\u017ftomer id: AB12345", "to\u212aen api key is abcdef1", "1.2.3.4", "fe80::1:2", "aa-bb-cc-dd-ee-ff",
            "account number 12345678", "order id: A12345", "sk_live_abcdefgh1", "AKIAABCDEFGH1", "4111 1111 1111 1111", "12 Oak street", "@someone", "+1 555 123 4567 89", "name: Ann Lee", "secret abcdefgh1"]
    for text in held:
        for kind, _ in pii._STEPS:
            assert not pii._RE[kind].search(text) or pii.may_hold(kind, text), (kind, text)
    assert [kind for kind, _ in pii._STEPS if pii.may_hold(kind, "plain words, nothing else")] == ["TITLE_CASE_PERSON"]
