"""Scalar functions on text: cleaning, tokens, line classifiers, headings, ids. All are column expressions but NFKC."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the line patterns of statutory documents
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
LEGISLATIVE_REFERENCE = r"(?i)^\s*\d+\s+of\s+\d{4}\.?\s*$"
SECTION_START = r"^\s*(\d{1,3})\s*\.\s*(.*)$"
CHAPTER_LINE = r"(?i)^\s*CHAPTER\s*([IVXLCDM]+)\s*$"
CHAPTER_HEADING = r"(?i)^#\s+Chapter\s+([IVXLCDM]+)\s*[—-]\s*(.+?)\s*$"
SECTION_HEADING = r"(?i)^##\s+Section\s+([0-9]+(?:-[A-Za-z]+)?|[0-9]+[A-Za-z]+)\s*(?:(?:—|-)\s*(.*?))?\s*$"
SPECIAL_HEADING = r"(?i)^##\s+(Preamble|Related Judgements|Schedule)\s*$"
MARGINAL_NOTE = r"(?i)^\s*\*\*Marginal note:\*\*\s*(.*?)\s*$"
SUBSECTION = r"^\s*\((\d+)\)\s*(.*)$"
SUBCLAUSE = r"(?i)^\s*\(([ivxlcdm]+)\)\s*(.*)$"
CLAUSE = r"(?i)^\s*\(([a-z])\)\s*(.*)$"
EXPLANATION = r"(?i)^\s*Explanation(?:\s+\d+)?\s*[\.:—–-]?\s*(.*)$"
ILLUSTRATION = r"(?i)^\s*Illustrations?\s*[\.:—–-]?\s*(.*)$"
PROVISO = r"(?i)^\s*Provided(?:\s+further)?\s+that\b\s*(.*)$"
BOLD_MARKER = r"(?i)^\s*(?:[-*+]\s+)?\*\*\s*(\([0-9]+\)|\([a-z]\)|\([ivxlcdm]+\))\s*\*\*(?:\s+(.*))?\s*$"
BOLD_TYPE = r"(?i)^\s*\*\*(Explanation|Illustration|Exception)\s*:?\*\*(?:\s+(.*))?\s*$"
SOURCE_PAGES = r"(?i)<!--\s*source_pages=([^;]+?)(?:;\s*section=([^ ]+))?\s*-->"
MD_MARKER = r"(?i)^\s*\*\*\s*(\(\d+\)|\([a-z]\)|\([ivxlcdm]+\))\s*\*\*\s*(.*)$"
MD_TYPES = (
    ("Explanation", r"(?i)^\s*(?:\*\*)?Explanation(?:\s+\d+)?(?:\*\*)?\s*(?:[-–—:]|\s*:\s*)?\s*(.*)$"),
    ("Exception", r"(?i)^\s*(?:\*\*)?Exception(?:\s+\d+)?(?:\*\*)?\s*(?:[-–—:]|\s*:\s*)?\s*(.*)$"),
    ("Illustration", r"(?i)^\s*(?:\*\*)?Illustration(?:\*\*)?\s*(.*)$"),
)
GARBAGE = (
    r"\b[A-Za-z]{2,}(?:Act|Clause|Section)\w*\b",
    r"\b(?:ThisAct|thisAct|General ClausesAct)\b",
    r"\b(?:bynotification|intoforce)\b",
    r"\b[A-Za-z](?:and|is|person|writing)\b",
)
INVISIBLE = "[­​﻿]"


def nfkc(text: Column) -> Column:
    """Unicode NFKC, for which Spark has no function."""

    def normalized(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return F.pandas_udf(normalized, "string")(text)


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc(text), INVISIBLE, ""))


def squeeze(text: Column) -> Column:
    """Runs of spaces and tabs become one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), "[ \t]+", " "))


def clean_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def approx_tokens(text: Column) -> Column:
    """Four characters to a token, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4.0)).cast("long")


def approx_tokens_floor0(text: Column) -> Column:
    """The same, but none for an empty text."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(text: Column) -> Column:
    """The tokens in one string, a space between them: no string is made for each of them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def is_noise(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER) | line.rlike(LEGISLATIVE_REFERENCE)


def upper_ratio(line: Column) -> Column:
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(line, F.lit(r"\p{Lu}")) / letters).otherwise(F.lit(0.0))


def is_chapter_title(line: Column, ratio: float = 0.8) -> Column:
    return (F.regexp_count(line, F.lit(r"\p{L}")) > 0) & (upper_ratio(line) >= ratio) & ~line.rlike(SECTION_START) & ~line.rlike(CHAPTER_LINE)


def chapter_title(lines: Column) -> Column:
    """Join title lines; letter-spaced capitals become words; no space before punctuation."""
    one = F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))
    joined = F.regexp_replace(one, r"(?<=\b[A-Z])\s+(?=[A-Z]\b)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s+([,.;:])", "$1"), r"\s+&\s+", " & "))


def join_lines(lines: Column) -> Column:
    """Strip, drop empties, join by a space, no space before punctuation."""
    # not F.trim itself: its second parameter would get the place in the array, as characters to be taken off
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+([,.;:!?])", "$1"))


def classify(line: Column) -> Column:
    """struct(kind, marker, content) of a line by the first pattern that matches."""
    out = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("marker"), line.alias("content"))
    rules = [("subsection", SUBSECTION, None), ("subclause", SUBCLAUSE, None), ("clause", CLAUSE, None), ("explanation", EXPLANATION, "Explanation"), ("illustration", ILLUSTRATION, "Illustration"), ("proviso", PROVISO, "Provided that")]
    for kind, pattern, marker in reversed(rules):
        mark = F.lit(marker) if marker else F.concat(F.lit("("), F.regexp_extract(line, pattern, 1), F.lit(")"))
        made = F.struct(F.lit(kind).alias("kind"), mark.alias("marker"), F.regexp_extract(line, pattern, 1 if marker else 2).alias("content"))
        out = F.when(line.rlike(pattern), made).otherwise(out)
    return out


def canonical_line(line: Column) -> Column:
    """`**(1)** t`, `**Explanation:** t` and so on; other lines trimmed."""
    line = F.trim(line)

    def shown(head: Column, text: Column) -> Column:
        return F.when(F.trim(text) == "", head).otherwise(F.concat(head, F.lit(" "), F.trim(text)))

    out = line
    for name, pattern in reversed(MD_TYPES):
        out = F.when(line.rlike(pattern), shown(F.lit(f"**{name}:**"), F.regexp_extract(line, pattern, 1))).otherwise(out)
    marker = F.concat(F.lit("**"), F.regexp_extract(line, MD_MARKER, 1), F.lit("**"))
    return F.when(line.rlike(MD_MARKER), shown(marker, F.regexp_extract(line, MD_MARKER, 2))).otherwise(out)


def source_pages(line: Column) -> Column:
    parts = F.split(F.regexp_extract(line, SOURCE_PAGES, 1), ",")
    return F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("int")), lambda p: p.isNotNull())


def safe_id(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def scrub_headers(line: Column, headers: Column) -> Column:
    """Take the document's chapter headers out of a line, whatever their case and spacing, and squeeze it."""
    quoted = lambda h: F.concat(F.lit("(?i)"), F.regexp_replace(F.regexp_replace(h, r"([\\\[\](){}.*+?^$|-])", r"\\$1"), r"\s+", r"\\s+"))
    return F.trim(F.regexp_replace(F.aggregate(headers, line, lambda s, h: F.regexp_replace(s, quoted(h), "")), "[ \t]+", " "))


def context(act: Column, chapter_no: Column, chapter: Column, section: Column, note: Column) -> Column:
    """The lines Act, Chapter, Section and Marginal note that head a chunk; absent ones are skipped."""
    return F.concat_ws("\n", F.concat(F.lit("Act: "), act), F.concat(F.lit("Chapter "), chapter_no, F.lit(" — "), chapter), F.concat(F.lit("Section "), section), F.concat(F.lit("Marginal note: "), note))
