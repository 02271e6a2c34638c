"""Data-quality rules: every rule is a condition of a bad row; the result has one row for each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.scratch import small, written

SPECIAL = ("preamble", "related_judgements", "schedule")
REQUIRED = ("chunk_id", "act", "chapter_number", "chapter_title", "section_number", "section_title", "subsection", "content_type", "content", "citation_id", "citation_text", "source_file")


def report(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule_id, n_bad, passed: all rules in one pass over the rows."""
    one = rows.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("rule_id"), F.col(n).alias("n_bad")) for n in rules])).alias("x")
    return one.select(long).select("x.*", (F.col("x.n_bad") == 0).alias("passed"))


def chunk_rules() -> dict[str, Column]:
    """Rules on one chunk; columns chunk_id, content, content_type, section_number, subsection, citation_text."""
    content, empty = F.col("content"), lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return {
        "dq11_keys": F.col("chunk_id").isNull() | content.isNull(),
        "dq13_content": empty("content"),
        "dq14_section": empty("section_number") & ~F.col("content_type").isin(*SPECIAL),
        "dq15_citation": empty("citation_text"),
        "dq16_nested_subsection": F.col("subsection").rlike(r"\)\s*\("),
        "dq17_chapter_heading": content.rlike(r"(?im)^#\s+Chapter\b"),
        "dq18_separator": content.rlike(r"(?m)^\s*---+\s*$"),
        "dq19_marginal_notes": F.regexp_count(content, F.lit(r"\*\*Marginal note:\*\*")) > 1,
        "dq20_tokens": T.approx_tokens_floor0(content) > 650,
        "dq21_citation_suffix": F.col("citation_text").rlike(r"\([^)]+\)$") & empty("subsection"),
    }


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def is_unique(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_distinct")).withColumn("is_unique", F.col("n") == F.col("n_distinct"))


def vector_rules(dim: int) -> dict[str, Column]:
    v = F.col("embedding")
    return {
        "dq24_missing": v.isNull(),
        "dq24_dimension": F.size(v) != dim,
        "dq24_finite": F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))),
        "dq24_zero": ~F.exists(v, lambda x: x != 0),
    }


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Least, largest and mean component, non-zero and all components: a partial aggregate for each vector, then one row."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    each = vectors.select(F.array_min(d).alias("lo"), F.array_max(d).alias("hi"), F.aggregate(d, F.lit(0.0), lambda s, x: s + x).alias("s"), F.size(F.filter(d, lambda x: x != 0)).alias("nz"), F.size(d).alias("n"))
    return each.agg(F.round(F.min("lo"), 6).alias("min"), F.round(F.max("hi"), 6).alias("max"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.sum("nz").alias("nonzero"), F.sum("n").alias("total"))


def preserved(source: DataFrame, copy: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """field, n_changed over the keys that both have; null-safe."""
    other = copy.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = source.select(key, *fields).join(other, key)
    return report(joined, {f: ~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields}).select(F.col("rule_id").alias("field"), F.col("n_bad").alias("n_changed"))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side, key: keys of one side only."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key), key, "left_anti").select(F.lit(side).alias("side"), F.col(key).alias("id"))
    return only(a, b, "missing").unionByName(only(b, a, "extra"))


def _places(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """key and its place by `order`: range partitions, their counts, then numbers inside a partition."""
    ranged = written(rows.select(key, F.col(order).alias("o")).repartitionByRange("o").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy("o", key))
    return ranged.withColumn("nth", inside).join(small(counts.select("part", before.alias("before"))), "part").select(key, (F.col("before") + F.col("nth")).alias(name))


def same_order(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """n_moved: keys whose place differs, by the row number over each side's order."""
    return _places(a, key, order, "pa").join(_places(b, key, order, "pb"), key).agg(F.count_if(F.col("pa") != F.col("pb")).alias("n_moved"))


def missing_numbers(rows: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    """The numbers from lo to hi that rows lack."""
    full = rows.sparkSession.range(lo, hi + 1).withColumnRenamed("id", column)
    return full.join(rows.select(F.col(column).cast("long").alias(column)).distinct(), column, "left_anti")


def repeated_lines(lines: DataFrame, pattern: str, more_than: int = 2) -> DataFrame:
    return lines.where(F.col("text").rlike(pattern)).groupBy(F.trim("text").alias("text")).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def garbage(lines: DataFrame) -> DataFrame:
    """pattern, n: lines that match a pattern of broken extraction."""
    return report(lines, {f"garbage_{i + 1}": F.col("text").rlike(p) for i, p in enumerate(T.GARBAGE)}).select(F.col("rule_id").alias("pattern"), F.col("n_bad").alias("n"))


def section_sizes(sections: DataFrame, tiny: int = 80, giant: int = 25_000) -> DataFrame:
    """Sections (doc_id, section, text) that are empty, tiny or giant."""
    n = F.length(F.trim("text"))
    kind = F.when(n == 0, "empty").when(n < tiny, "tiny").when(n > giant, "giant")
    return sections.withColumn("finding", kind).where("finding is not null")


def request_valid() -> Column:
    """A request has 1 to 4000 characters, a known act and a conversation id of at most 128."""
    return F.col("question").isNotNull() & F.length("question").between(1, 4000) & F.col("act").isin("all", "bns", "ica") & (F.col("conversation_id").isNull() | (F.length("conversation_id") <= 128))


def golden_rules() -> dict[str, Column]:
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return {
        "id": blank("id"),
        "act": blank("act"),
        "query": blank("query"),
        "gold": F.coalesce(F.size("gold"), F.lit(0)) <= 0,
        "grade": F.exists("gold", lambda g: ~F.coalesce(g["relevance_grade"].isin(1, 2), F.lit(False))),
        "chunk_ids": F.exists("gold", lambda g: F.coalesce(F.size(g["chunk_ids"]), F.lit(0)) <= 0),
    }


def number_span(rows: DataFrame, column: str) -> tuple[int, int]:
    """The least and the largest number of a column; (0, -1) without any."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    return (0, -1) if lo is None else (int(lo), int(hi))


def section_number(raw: Column) -> Column:
    """A section number as it is compared: trimmed and upper-cased."""
    return F.upper(F.trim(raw))


def sequence_report(sections: DataFrame, lo: int, hi: int, strict: bool = False) -> DataFrame:
    """finding (missing, unexpected, duplicate), number: how the section numbers (number) depart from lo..hi, each once. strict: any finding fails the job."""
    numbers = sections.select(F.col("number").cast("long").alias("number"))
    missing = missing_numbers(numbers, "number", lo, hi).select(F.lit("missing").alias("finding"), "number")
    unexpected = numbers.where(~F.col("number").between(lo, hi)).distinct().select(F.lit("unexpected").alias("finding"), "number")
    twice = numbers.groupBy("number").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("finding"), "number")
    found = missing.unionByName(unexpected).unionByName(twice)
    if strict and (first := found.orderBy("finding", "number").first()) is not None:
        raise ValueError(f"section numbers aren't complete: {first['finding']} {first['number']}")
    return found


def duplicate_sections(sections: DataFrame) -> DataFrame:
    """doc_id, section, n: section numbers that a document has more than once, upper case or lower."""
    return sections.groupBy("doc_id", section_number(F.col("section")).alias("section")).agg(F.count("*").alias("n")).where("n > 1")


def counts_expected(counts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """check, n, expected, passed: totals that are known beforehand, such as sections, chapters, chunks of an act and of all."""
    one = None
    for name, (rows, expected) in counts.items():
        got = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", F.lit(expected).cast("long").alias("expected"), (F.col("n") == expected).alias("passed"))
        one = got if one is None else one.unionByName(got)
    return one


def missing_fields(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    """Required fields that the schema lacks."""
    return sorted(set(required) - set(rows.columns))


def missing_keys(records: DataFrame, key: str, fields: Column, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """key, missing (sorted): records, as maps of field to value, without a required field."""
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(fields)))
    return records.select(key, lacking.alias("missing")).where(F.size("missing") > 0)


def non_empty(rows: DataFrame, what: str) -> DataFrame:
    """rows, or an error if there is none."""
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows


def samples(bad: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """by, n, sample: how many bad rows, and the first `most` keys of them; no more than `most` keys leave a task."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(key))
    first = bad.withColumn("nth", nth).where(F.col("nth") <= most).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(key).cast("string").alias("k")))), lambda x: x["k"]), ",").alias("sample"))
    return bad.groupBy(by).agg(F.count("*").alias("n")).join(first, by).select(by, "n", "sample")


def roll_up(checks: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, n_failed, passed of the checks (by, check, passed), and a last row over all (by null)."""
    each = checks.groupBy(F.col(by).cast("string").alias(by)).agg(F.count_if(~F.col("passed")).alias("n_failed"), F.bool_and("passed").alias("passed"))
    return each.unionByName(each.agg(F.lit(None).cast("string").alias(by), F.sum("n_failed").alias("n_failed"), F.bool_and("passed").alias("passed")))
