"""The ordered gates on candidate texts as native columns; the first that fails names the code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import is_english, word_count


def _any(text: Column, *patterns: str) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(P.java(p))
    return found


def role_wrapper(text: Column) -> Column:
    return _any(text, P.ROLE_WRAPPER)


def meta_language(text: Column) -> Column:
    """Speaks of data sets or labels instead of being content."""
    # One word of these stands in whatever the patterns match, so most texts are read once.
    possible = _any(text, r"\b(?:dataset|training|oracle|annotat|active|rule|generate|label|safe|unsafe)")
    return possible & (_any(text, *P.META_LANGUAGE) | (_any(text, P.LABEL_CONTEXT) & _any(text, *P.LABEL_DECISION)))


def harm_clauses(text: Column) -> Column:
    """Clauses between sentence marks and sequence words."""
    cut = F.transform(F.split(text, P.java(P.CLAUSE_SPLIT)), lambda c: F.btrim(c, F.lit(" ,:\n\t")))
    return F.filter(cut, lambda c: c != "")


def _sum(clauses: Column, weight) -> Column:
    return F.aggregate(clauses, F.lit(0), lambda acc, c: acc + weight(c))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(P.java(pattern)))


def operational_harm(text: Column) -> Column:
    """Step-by-step instructions for weapons, credential theft or malware: at least two sequence words and two relationships.

    Each kind needs a word of its own, which a text without it cannot have in any clause; so clauses are split and judged only where the text has one.
    """
    parts = (_any(text, P.EXPLOSIVE_DOMAIN), _any(text, P.CREDENTIAL_ACTION), _any(text, P.MALWARE_DOMAIN))
    judged = F.transform(F.array(harm_clauses(text)), lambda clauses: _harmful(text, clauses))[0]
    return (_count(text, P.SEQUENCE) >= 2) & F.when(parts[0] | parts[1] | parts[2], judged).otherwise(False)


def _harmful(text: Column, clauses: Column) -> Column:
    """Whether bound clauses hold two relationships of one kind."""
    weapons = _sum(clauses, lambda c: F.when(_any(c, P.EXPLOSIVE_DOMAIN), _count(c, P.EXPLOSIVE_CONSTRUCTION) + _count(c, P.EXPLOSIVE_ASSEMBLY)).otherwise(0))
    theft = _sum(clauses, lambda c: F.when(_any(text, P.CREDENTIAL_THEFT) | _any(c, P.CREDENTIAL_OBJECT), _count(c, P.CREDENTIAL_ACTION)).otherwise(0))
    targeted_deploy = lambda c: _any(c, P.MALWARE_DEPLOY) & _any(c, P.ATTACK_TARGET)
    links = lambda c: sum(
        (
            x.cast("int")
            for x in (
                _any(c, P.MALWARE_SAMPLE) & _any(c, P.DOWNLOAD),
                _any(c, P.MALWARE_CREATION, P.MALWARE_ASSEMBLY),
                _any(c, P.MALWARE_PERSISTENCE),
                _any(c, P.MALWARE_EXECUTE, P.EXECUTE_PRONOUN),
                _any(c, P.LOADER_CONNECT),
                _any(c, P.MALWARE_DEPLOY_OBJECT) | targeted_deploy(c),
            )
        ),
        F.lit(0),
    )
    offensive = F.exists(
        clauses,
        lambda c: _any(c, P.MALWARE_CREATION, P.MALWARE_ASSEMBLY, P.MALWARE_PERSISTENCE, P.MALWARE_DEPLOY_OBJECT, P.LOADER_CONNECT, P.EXECUTE_PRONOUN)
        | (_any(c, P.MALWARE_EXECUTE) & _any(c, P.ATTACK_TARGET))
        | targeted_deploy(c),
    )
    defensive = _any(text, P.MALWARE_SAMPLE) & _any(text, P.DEFENSIVE) & _any(text, P.DOWNLOAD) & _any(text, P.EXECUTE) & ~offensive
    flow = F.exists(clauses, lambda c: _any(c, P.MALWARE_DOMAIN) & ~_any(c, P.MALWARE_REPORT))
    malware = ~defensive & flow & (_sum(clauses, links) >= 2)
    return (weapons >= 2) | (theft >= 2) | malware


def length_bin_ok(text: Column, bin_name: Column, words=word_count) -> Column:
    """Whether a text's words fit its bin; the bins overlap."""
    n = words(text)
    ok = F.lit(False)
    for name, (low, high) in P.LENGTH_BINS.items():
        ok = F.when(bin_name == name, n.between(low, high)).otherwise(ok)
    return ok


def first_failure(*gates: tuple[Column, str]) -> Column:
    """Code of the first gate whose condition holds, else accepted."""
    code = F.lit("accepted")
    for failed, name in reversed(gates):
        code = F.when(F.coalesce(failed, F.lit(False)), name).otherwise(code)
    return code


def local_gates(text: Column, shape: Column, response: Column, bin_name: Column, identifier: Column, words=word_count) -> list[tuple[Column, str]]:
    """Gates 1 to 7, which look at one row alone. identifier: the personal-data flag, native or exact."""
    return [
        (((shape == "query") & response.isNotNull()) | ((shape == "query_response") & response.isNull()), "schema_or_shape"),
        (role_wrapper(text), "literal_role_wrapper"),
        (~is_english(text), "wrong_language"),
        (meta_language(text), "generation_meta_language"),
        (identifier, "pii_or_external_identifier"),
        (operational_harm(text), "operational_harm"),
        (~length_bin_ok(text, bin_name, words), "length_out_of_bin"),
    ]
