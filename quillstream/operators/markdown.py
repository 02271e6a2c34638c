"""Markdown statutes: units for chunking, normalized sections, document assembly. Headings are forward-filled by document windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T

# fixed values: the headings of raw Markdown before normalization
ANY_CHAPTER = r"(?i)^#\s+Chapter\s+([IVXLCDM0-9]+)\s*(?::|-|—)?\s*(.*)$"
ANY_SECTION = r"(?i)^##\s+Section\s+(\d+[A-Za-z]?(?:-[A-Za-z]+)?)(?:\s*(?:[-–—.:]\s*)?(.*?))?\s*$"
SPECIAL_STARTS = {"## PREAMBLE": "Preamble", "## Related Judgements": "Related Judgements", "## Schedule": "Schedule"}
ACT_NUMBER = r"^## \[\d+ OF \d{4}\]$"


def _filled(value: Column, by: str = "doc_id") -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))


def units(lines: DataFrame) -> DataFrame:
    """lines (doc_id, pos, text) -> doc_id, unit, number, title, chapter, chapter_title, special, note, lines (array) of each unit.

    A chapter heading closes the unit before it; lines before the first unit of a chapter are dropped. The title falls
    back to the first marginal note.
    """
    line = F.trim("text")
    kind = F.when(line.rlike(T.CHAPTER_HEADING), "chapter").when(line.rlike(T.SECTION_HEADING), "section").when(line.rlike(T.SPECIAL_HEADING), "special")
    rows = lines.withColumn("kind", kind).withColumn("open", _filled(F.col("kind")))
    is_head = F.col("kind").isin("section", "special")
    rows = rows.withColumn("unit", F.sum(F.coalesce(is_head.cast("long"), F.lit(0))).over(Window.partitionBy("doc_id").orderBy("pos")))
    rows = rows.withColumn("chapter", _filled(F.when(F.col("kind") == "chapter", F.regexp_extract(line, T.CHAPTER_HEADING, 1)))).withColumn("chapter_title", _filled(F.when(F.col("kind") == "chapter", F.trim(F.regexp_extract(line, T.CHAPTER_HEADING, 2)))))
    rows = rows.where(F.col("open").isin("section", "special") & (F.col("kind").isNull() | (F.col("kind") != "chapter")))
    head = lambda c: F.max(F.when(is_head, c))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNull(), F.struct("pos", "text")))), lambda x: x["text"])
    note = F.min_by(F.regexp_extract(line, T.MARGINAL_NOTE, 1), F.when(line.rlike(T.MARGINAL_NOTE), F.col("pos")))
    special = F.when(F.col("kind") == "special", F.regexp_extract(line, T.SPECIAL_HEADING, 1))
    out = rows.groupBy("doc_id", "unit").agg(
        head(F.when(F.col("kind") == "section", F.regexp_extract(line, T.SECTION_HEADING, 1))).alias("number"), head(F.coalesce(special, F.trim(F.regexp_extract(line, T.SECTION_HEADING, 2)))).alias("title"), head(F.col("chapter")).alias("chapter"), head(F.col("chapter_title")).alias("chapter_title"),
        head(F.lower(F.replace(special, F.lit(" "), F.lit("_")))).alias("special"), note.alias("note"), body.alias("lines"),
    )
    return out.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "note", F.lit("")))


def chapter_headers(lines: DataFrame) -> DataFrame:
    """doc_id, headers: every chapter title of a document, to be scrubbed from running text."""
    title = F.trim(F.regexp_extract(F.trim("text"), T.CHAPTER_HEADING, 2))
    return lines.where(F.trim("text").rlike(T.CHAPTER_HEADING)).groupBy("doc_id").agg(F.array_sort(F.collect_set(title)).alias("headers"))


def normalized(lines: DataFrame) -> DataFrame:
    """lines (doc_id, pos, text) -> doc_id, ord, owner (section, special, chapter, preamble), chapter, number, title, note, pages, body.

    Each line is routed by the first rule that fits: source-page comment, other title (dropped), chapter, section, marginal note
    inside a section, special block, act number, content of what is open. Two special blocks in a row both stay. The last
    marginal note counts, the first gives a missing title. Body lines are canonical, blanks at the ends and in a row dropped.
    """
    raw, line = F.rtrim("text"), F.trim("text")
    special = F.coalesce(*[F.when(line == k, F.lit(v)) for k, v in SPECIAL_STARTS.items()])
    kind = (
        F.when(line.rlike(T.SOURCE_PAGES), "pages").when(raw.rlike(ANY_CHAPTER), "chapter").when(raw.startswith("# "), "title").when(raw.rlike(ANY_SECTION), "section")
        .when(special.isNotNull(), "special").when(line.rlike(ACT_NUMBER), "act")
    )
    rows = lines.withColumn("kind", kind).where("kind is null or kind <> 'title'")
    opens = F.col("kind").isin("chapter", "section", "special", "act")
    rows = rows.withColumn("open", _filled(F.when(opens, F.col("kind")))).withColumn("ord", F.sum(F.coalesce(opens.cast("long"), F.lit(0))).over(Window.partitionBy("doc_id").orderBy("pos")))
    rows = rows.withColumn("chapter", _filled(F.when(F.col("kind") == "chapter", F.regexp_extract(raw, ANY_CHAPTER, 1))))
    in_section = F.col("open") == "section"
    rows = rows.withColumn("is_note", F.coalesce(in_section & F.col("kind").isNull() & raw.rlike(T.MARGINAL_NOTE), F.lit(False)))
    owner = F.when(in_section, "section").when(F.col("open") == "special", "special").when(F.col("chapter").isNotNull(), "chapter").otherwise("preamble")
    rows = rows.withColumn("owner", owner)
    content = F.col("kind").isNull() & ~F.col("is_note")
    blank = line == ""
    before = F.lag(blank | ~content).over(Window.partitionBy("doc_id", "ord").orderBy("pos"))
    rows = rows.withColumn("shown", content & ~(blank & F.coalesce(before, F.lit(True))))
    note = F.regexp_extract(raw, T.MARGINAL_NOTE, 1)
    by_pos = lambda agg, value, ok: agg(value, F.when(ok, F.col("pos")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("pos", T.canonical_line(raw).alias("t"))))), lambda x: x["t"]), "\n")
    out = rows.groupBy("doc_id", "ord", "owner").agg(
        F.max("chapter").alias("chapter"), F.max(F.when(F.col("kind") == "section", F.regexp_extract(raw, ANY_SECTION, 1))).alias("number"),
        F.max(F.when(F.col("kind") == "section", T.clean_title(F.regexp_extract(raw, ANY_SECTION, 2))).when(F.col("kind") == "chapter", T.clean_title(F.regexp_extract(raw, ANY_CHAPTER, 2))).when(F.col("kind") == "special", special)).alias("heading"),
        by_pos(F.min_by, note, F.col("is_note")).alias("first_note"), by_pos(F.max_by, note, F.col("is_note")).alias("note"), by_pos(F.max_by, T.source_pages(line), F.col("kind") == "pages").alias("pages"), F.rtrim(body).alias("body"),
    )
    title = F.coalesce(F.nullif("heading", F.lit("")), "first_note")
    return out.select("doc_id", "ord", "owner", "chapter", "number", title.alias("title"), "note", "pages", "body")


def document_json(sections: DataFrame, digests: DataFrame) -> DataFrame:
    """doc_id, json: a document's digest, section list and counts; sections as `normalized` gives them."""
    item = F.struct("ord", "owner", "chapter", "number", "title", "note", "pages", "body")
    docs = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("sections"), F.count_if(F.col("owner") == "section").alias("n_sections"), F.countDistinct("chapter").alias("n_chapters"))
    return docs.join(digests, "doc_id", "left").select("doc_id", F.to_json(F.struct("sha256", "n_sections", "n_chapters", F.lit(False).alias("ocr"), F.lit(False).alias("llm"), "sections")).alias("json"))


def document_record(head: DataFrame, parts: dict[str, tuple[DataFrame, tuple[str, ...]]], values: dict[str, DataFrame] | None = None) -> DataFrame:
    """doc_id, json: a document's record: its head, lists of its parts in order, and objects of named values.

    head: doc_id and the fields of `document`. parts: name -> (rows with doc_id, the columns that order them); each row is an object of its columns but doc_id, a
    row of one column `value` that value itself. values: name -> rows (doc_id, name, value). All parts meet in one grouping by document, as rows that are JSON
    already; a part without rows is an empty list. Documents without a head are left out. A null order comes first; ties are in the order of the JSON.
    """
    every = None
    for n, (name, (rows, order)) in enumerate(parts.items()):
        fields = [c for c in rows.columns if c != "doc_id"]
        item = F.to_json(F.struct(*fields)) if fields != ["value"] else F.regexp_extract(F.to_json(F.struct("value")), r'(?s)^\{"value":(.*)\}$', 1)
        place = F.array(*[F.col(c).cast("double") for c in order]) if order else F.array().cast("array<double>")
        one = rows.select("doc_id", F.lit(n).alias("part"), place.alias("place"), item.alias("item"))
        every = one if every is None else every.unionByName(one)
    for n, (name, rows) in enumerate((values or {}).items(), len(parts)):
        item = F.regexp_extract(F.to_json(F.map_from_arrays(F.array("name"), F.array("value"))), r"(?s)^\{(.*)\}$", 1)
        every = every.unionByName(rows.select("doc_id", F.lit(n).alias("part"), F.array().cast("array<double>").alias("place"), item.alias("item")))
    grouped = every.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "place", "item"))).alias("all"))
    joined = head.select("doc_id", F.to_json(F.struct(*[c for c in head.columns if c != "doc_id"])).alias("head")).join(grouped, "doc_id", "left")
    text = [F.lit('{"document":'), F.col("head")]
    for n, name in enumerate([*parts, *(values or {})]):
        of = F.coalesce(F.expr(f"array_join(transform(filter(all, x -> x.part = {n}), x -> x.item), ',')"), F.lit(""))
        opens, closes = "[]" if n < len(parts) else "{}"
        text += [F.lit(f',"{name}":{opens}'), of, F.lit(closes)]
    return joined.select("doc_id", F.concat(*text, F.lit("}")).alias("json"))


#: Places of what a document holds outside its chapters when it is rendered.
FIRST, LAST = ("Preamble", "Related Judgements"), ("Schedule",)


def rendered(sections: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, markdown of a normalized document: title and act number, what stands before chapters, chapters with their sections and a rule after each, schedules.

    sections: doc_id, ord, owner (preamble, special, chapter, section), chapter, number, title, note, body, as `normalized` gives them;
    titles: doc_id, title, act_number. Three line feeds and more become two.
    """
    s = sections.withColumn("place", F.when(F.col("owner") == "preamble", 0).when((F.col("owner") == "special") & F.col("title").isin(*FIRST), 1).when((F.col("owner") == "special") & F.col("title").isin(*LAST), 3).when(F.col("owner") != "special", 2)).where("place is not null")
    chapters = Window.partitionBy("doc_id", "place").orderBy("ord")
    s = s.withColumn("ends", (F.col("place") == 2) & ~F.coalesce(F.lead("chapter").over(chapters).eqNullSafe(F.col("chapter")) & (F.lead("owner").over(chapters) == "section"), F.lit(False)))
    body = F.when(F.coalesce(F.col("body"), F.lit("")) == "", "").otherwise(F.concat("body", F.lit("\n\n")))
    head = (
        F.when(F.col("owner") == "special", F.concat(F.lit("## "), "title", F.lit("\n\n")))
        .when(F.col("owner") == "chapter", F.concat(F.lit("# Chapter "), "chapter", F.lit(" — "), F.coalesce("title", F.lit("")), F.lit("\n\n")))
        .when(F.col("owner") == "section", F.concat(F.lit("## Section "), "number", F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.concat(F.lit(" — "), F.trim("title"))).otherwise(""), F.lit("\n\n"), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("**Marginal note:** "), "note", F.lit("\n\n"))).otherwise("")))
        .otherwise("")
    )
    part = F.concat(head, body, F.when(F.col("ends"), F.lit("---\n\n")).otherwise(""))
    whole = s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ord", part.alias("p")))), lambda x: x["p"]), "").alias("rest"))
    top = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.when(F.col("act_number").isNotNull(), F.concat(F.lit("**Act number:** "), "act_number", F.lit("\n\n"))).otherwise(""))
    text = F.regexp_replace(F.concat(top, F.coalesce("rest", F.lit(""))), r"\n{3,}", "\n\n")
    return titles.join(whole, "doc_id", "left").select("doc_id", F.concat(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def normalize_files(lines: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rendered documents, counts): parse, render, and doc_id, n_chapters, n_sections of each."""
    parsed = normalized(lines)
    counts = parsed.groupBy("doc_id").agg(F.count_if(F.col("owner") == "chapter").alias("n_chapters"), F.count_if(F.col("owner") == "section").alias("n_sections"))
    return rendered(parsed, titles), counts
