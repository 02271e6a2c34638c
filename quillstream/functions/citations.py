"""Citations: labels, extraction, validation against the retrieved sources, enforcement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the form of a citation, and sentences that mark answers without evidence
CITATION = r"\[(BNS|ICA)\s+§([0-9A-Za-z-]+)\]"
#: Answer used when a citation has no source; answers that own up to missing evidence.
REFUSAL = "I could not provide a grounded answer from the supplied legal evidence because the generated response contained a citation that was not among the retrieved sources."
NO_HITS = "i could not retrieve relevant legal provisions"
INSUFFICIENT = ("retrieved evidence is insufficient", "cannot provide a grounded answer")


def act_code(act: Column) -> Column:
    low = F.lower(F.coalesce(act, F.lit("")))
    return F.when(low.contains("nyaya") | low.contains("bns"), "BNS").when(low.contains("contract") | low.contains("ica"), "ICA").otherwise(F.coalesce(F.nullif(act, F.lit("")), F.lit("SOURCE")))


def label(act: Column, section: Column) -> Column:
    code = act_code(act)
    return F.when(F.coalesce(section, F.lit("")) == "", F.concat(F.lit("["), code, F.lit("]"))).otherwise(F.concat(F.lit("["), code, F.lit(" §"), section, F.lit("]")))


def extracted(answer: Column) -> Column:
    """Labels in the order of their first occurrence, in canonical form."""
    pairs = F.arrays_zip(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)).alias("a"), F.regexp_extract_all(answer, F.lit(CITATION), F.lit(2)).alias("s"))
    return F.array_distinct(F.transform(pairs, lambda p: F.concat(F.lit("["), p["a"], F.lit(" §"), p["s"], F.lit("]"))))


def valid(cited: Column, allowed: Column) -> Column:
    return F.filter(cited, lambda c: F.array_contains(allowed, c))


def unsupported(cited: Column, allowed: Column) -> Column:
    return F.filter(cited, lambda c: ~F.array_contains(allowed, c))


def sections(cited: Column) -> Column:
    return F.transform(cited, lambda c: F.regexp_extract(c, r"§([0-9A-Za-z-]+)\]", 1))


def has_text(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, r"\[[A-Z]+\s+§[0-9A-Za-z-]+\]", "")) != ""


def insufficient(answer: Column, n_docs: Column, n_unsupported: Column) -> Column:
    low = F.lower(answer)
    return (n_unsupported > 0) | (n_docs == 0) | low.startswith(NO_HITS) | low.contains(INSUFFICIENT[0]) | low.contains(INSUFFICIENT[1])
