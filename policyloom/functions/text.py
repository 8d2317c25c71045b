"""Text functions as native columns; the few that Spark cannot express are Arrow-batched UDFs."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

#: What ids of stable_id() and of planned releases begin with.
ID_PREFIX = "pl"


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """NFKC and full case folding; ASCII texts take a short cut."""
    return text.map(lambda x: x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def exact_fold(text: Column) -> Column:
    """NFKC and full case folding in two lanes: texts of ASCII alone natively, the others through Arrow; a lane sees nulls for the rows of the other."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.coalesce(F.when(ascii_only, F.lower(text)), nfkc_casefold(F.when(~ascii_only, text)))


def fold(text: Column) -> Column:
    """Native folding: lower case with sharp s spelt out, equal to NFKC and case folding on texts without compatibility characters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def canonical(query: Column, response: Column | None = None, folded=fold) -> Column:
    """A key that equal candidates share; it tells a missing response from an empty one."""
    head = F.concat(F.lit("query\x1f"), squeeze(folded(query)))
    if response is None:
        return F.concat(head, F.lit("\x1eresponse:none"))
    return F.concat(head, F.when(response.isNull(), "\x1eresponse:none").otherwise(F.concat(F.lit("\x1eresponse\x1f"), squeeze(folded(response)))))


def combined(query: Column, response: Column) -> Column:
    """Query and response as one text."""
    return F.concat_ws("\n", query, response)


def tokens(text: Column, folded=fold) -> Column:
    """Runs of ASCII letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit("([a-z0-9]+)"), 1)


def token_set(text: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(tokens(text))


def word_or_cjk_set(text: Column) -> Column:
    """Distinct words with underscores, and single CJK characters."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(r"([A-Za-z0-9_]+|[㐀-鿿])"), 1))


def grams(text: Column, width: int = 5, folded=fold) -> Column:
    """Distinct runs of `width` tokens, none for shorter texts. The token array is bound once, as the lambda's variable."""
    return F.transform(
        F.array(tokens(text, folded)),
        lambda t: F.when(
            F.size(t) >= width,
            F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - width, F.lit(0))), lambda i: F.array_join(F.slice(t, i + 1, width), " "))),
        ).otherwise(F.array().cast("array<string>")),
    )[0]


def gram_hashes(text: Column, width: int = 5, folded=fold) -> Column:
    """The same runs as distinct 64-bit hashes: eight bytes each where they are stored, shuffled or joined. Tokens are hashed once, runs from their hashes."""
    return F.transform(
        F.array(F.transform(tokens(text, folded), lambda t: F.xxhash64(t))),
        lambda t: F.when(
            F.size(t) >= width,
            F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(width)]))),
        ).otherwise(F.array().cast("array<bigint>")),
    )[0]


def jaccard(left: Column, right: Column) -> Column:
    """Share of common elements of two sets; 0 if either is empty."""
    common = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(common / (F.size(left) + F.size(right) - common))


def word_count(text: Column) -> Column:
    """Words with apostrophes, Unicode."""
    return F.regexp_count(text, F.lit(r"(?U)\b[\w']+\b"))


def english_share(text: Column) -> Column:
    """ASCII letters among all letters; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    mixed = F.when(letters > 0, F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / letters)
    return F.when(F.octet_length(text) == F.length(text), F.when(text.rlike("[A-Za-z]"), F.lit(1.0))).otherwise(mixed)


def is_english(text: Column) -> Column:
    return F.coalesce(english_share(text) >= P.ENGLISH_RATIO, F.lit(False)) & text.rlike("[A-Za-z]")


def normalize_seed(text: Column) -> Column:
    """Seed text with e-mail addresses, URLs and phone numbers masked; null if empty or over the limit."""
    # A pattern runs only where the text has what each of its matches has.
    def mask(text: Column, need, pattern: str, name: str) -> Column:
        return F.transform(F.array(text), lambda t: F.when(need(t), F.regexp_replace(t, "(?U)" + pattern, name)).otherwise(t))[0]

    masked = mask(text, lambda t: t.contains("@"), P.SEED_EMAIL, "[EMAIL]")
    masked = mask(masked, lambda t: t.contains("://"), P.SEED_URL, "[URL]")
    masked = mask(masked, lambda t: t.rlike(r"(?U)\d"), P.SEED_PHONE, "[PHONE]")
    clean = squeeze(masked)
    return F.when(F.length(clean).between(1, P.TEXT_LIMIT), clean)


def sanitize_log(text: Column, limit: int = P.CANDIDATE_LIMIT) -> Column:
    """Secrets, bearer tokens and addresses masked, long texts truncated."""
    masked = F.regexp_replace(text, P.java(P.LOG_SECRET), "$1=[REDACTED]")
    masked = F.regexp_replace(masked, P.java(P.LOG_BEARER), "Bearer [REDACTED]")
    masked = F.regexp_replace(masked, P.java(P.LOG_EMAIL), "[REDACTED_EMAIL]")
    return F.when(F.length(masked) > limit, F.concat(F.substring(masked, 1, limit), F.lit("...[truncated]"))).otherwise(masked)


def normalize_indicator(text: Column) -> Column:
    """Letters and digits only, folded."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def split_of(name: Column, seed: int = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> Column:
    """train, dev or holdout by a hash of seed and name, so that a name never changes sides."""
    if abs(sum(ratios) - 1) > 1e-12 or any(not 0 <= r <= 1 for r in ratios):
        raise ValueError("ratios must lie in 0..1 and sum to 1")
    at = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}\0"), name.cast("string")), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return F.when(at < ratios[0], "train").when(at < ratios[0] + ratios[1], "dev").otherwise("holdout")


def canonical_json(ascii_only: bool = False):
    """UDF: JSON text with sorted keys and no blanks; null for text that is no JSON."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)
            except (TypeError, ValueError):
                return None

        return text.map(one)

    return run


@F.pandas_udf(T.BooleanType())
def strict_json_object(text: pd.Series) -> pd.Series:
    """Whether a text is one JSON object without repeated keys at any depth and without NaN or infinities."""

    def unique(pairs):
        names = [k for k, _ in pairs]
        if len(names) != len(set(names)):
            raise ValueError("repeated key")
        return dict(pairs)

    def reject(_):
        raise ValueError("not finite")

    def one(x):
        try:
            return isinstance(json.loads(x, object_pairs_hook=unique, parse_constant=reject), dict)
        except (TypeError, ValueError):
            return False

    return text.map(one)


@F.pandas_udf(T.BooleanType())
def holds_forbidden_field(text: pd.Series) -> pd.Series:
    """Whether a JSON text has a key at any depth that only the evaluation side may know."""

    def found(value) -> bool:
        if isinstance(value, dict):
            return any(k in P.FORBIDDEN_FIELDS or k.startswith("gold") or found(v) for k, v in value.items())
        return isinstance(value, list) and any(map(found, value))

    def one(x):
        try:
            return found(json.loads(x))
        except (TypeError, ValueError):
            return False

    return text.map(one)


def stable_id(namespace: str, payload_json: Column, digits: int = 24, prefix: str = ID_PREFIX) -> Column:
    """A name from the hash of a canonical JSON payload."""
    return F.concat(F.lit(f"{prefix}-{namespace}-"), F.substring(F.sha2(payload_json, 256), 1, digits))
