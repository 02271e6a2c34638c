"""Chunks of a Markdown statute in one call: units, scrubbed lines, blocks, split blocks, packed groups, ids.

Each stage adds columns to the rows of the one before; headings and contexts are rows of their own, one a unit, and are joined by (doc_id, unit). Texts are put
together twice, by block and by chunk; splitting and packing decide by lengths alone. Every window and group is a unit or, for headings, a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import blocks

UNIT = ("doc_id", "unit")


def routed(lines: DataFrame) -> DataFrame:
    """lines (doc_id, pos, text) with kind (chapter, section, special; null for others), unit (number of the last section or special block), open (kind of the last heading)."""
    line = F.trim("text")
    kind = F.when(line.rlike(T.CHAPTER_HEADING), "chapter").when(line.rlike(T.SECTION_HEADING), "section").when(line.rlike(T.SPECIAL_HEADING), "special")
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("doc_id", "pos", "text", kind.alias("kind"))
    rows = rows.withColumn("unit", F.count_if(F.col("kind").isin("section", "special")).over(order)).withColumn("open", F.last("kind", ignorenulls=True).over(order))
    chapter = lambda i: F.last(F.when(F.col("kind") == "chapter", F.trim(F.regexp_extract(line, T.CHAPTER_HEADING, i))), ignorenulls=True).over(order)
    return rows.withColumn("chapter", chapter(1)).withColumn("chapter_title", chapter(2))


def headings(rows: DataFrame, act: str) -> DataFrame:
    """doc_id, unit, number, title, special, chapter, chapter_title, context of each unit of routed lines."""
    line = F.trim("text")
    special = F.when(F.col("kind") == "special", F.regexp_extract(line, T.SPECIAL_HEADING, 1))
    number = F.when(F.col("kind") == "section", F.regexp_extract(line, T.SECTION_HEADING, 1))
    heads = rows.where(F.col("kind").isin("section", "special")).select(*UNIT, number.alias("number"), F.coalesce(special, F.trim(F.regexp_extract(line, T.SECTION_HEADING, 2))).alias("title"), F.lower(F.replace(special, F.lit(" "), F.lit("_"))).alias("special"), "chapter", "chapter_title")
    body = rows.where("kind is null and open in ('section', 'special')")
    notes = body.where(F.col("text").rlike(T.MARGINAL_NOTE)).groupBy(*UNIT).agg(F.min_by(F.trim(F.regexp_extract("text", T.MARGINAL_NOTE, 1)), "pos").alias("note"))
    named = F.when(F.col("number").isNotNull(), F.concat(F.lit("Section "), "number", F.lit(" — "), "title")).otherwise(F.col("title"))
    context = F.concat_ws("\n", F.lit(f"Act: {act}"), F.concat(F.lit("Chapter "), "chapter", F.lit(" — "), "chapter_title"), named, F.concat(F.lit("Marginal note: "), "note"))
    return heads.join(notes, list(UNIT), "left").withColumn("context", context).drop("note")


def chapter_patterns(rows: DataFrame) -> DataFrame:
    """doc_id, patterns: an expression for each chapter heading of a document as it stands in running text, in the order of the headings."""
    escape = lambda c: F.regexp_replace(c, r"([\\\[\](){}.*+?^$|-])", r"\\$1")
    pattern = F.concat(F.lit(r"(?i)\bCHAPTER\s*"), F.col("chapter"), F.lit(r"\s+"), F.regexp_replace(escape(F.col("chapter_title")), r"\s+", r"\\s+"))
    found = rows.where("kind = 'chapter'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", pattern.alias("p")))).alias("p"))
    return found.select("doc_id", F.col("p.p").alias("patterns"))


def scrubbed(body: DataFrame, patterns: DataFrame) -> DataFrame:
    """The body lines without their document's chapter headings; only lines that name a chapter are looked through."""
    clean: Column = F.aggregate("patterns", F.col("text"), lambda s, p: F.regexp_replace(s, p, F.lit("")))
    names = F.col("text").rlike(r"(?i)\bchapter") & F.col("patterns").isNotNull()
    return body.join(patterns, "doc_id", "left").withColumn("text", F.when(names, clean).otherwise(F.col("text"))).drop("patterns")


def chunk_documents(lines: DataFrame, act: str, prefix: str, source_file: str, target: int = blocks.TARGET, most: int = blocks.MOST) -> DataFrame:
    """lines (doc_id, pos, text) of Markdown statutes -> a row for each chunk with its fields and, beside them, doc_id, unit, ordinal and tokens.

    Lines before the first unit and between a chapter heading and its first unit belong to no chunk. Blocks over `most` tokens are cut after .!?; and packed
    again; blocks are packed to `target` tokens with their context. Units without a line give no chunk. An empty table gives no rows.
    """
    rows = routed(lines)
    units = headings(rows, act)
    body = scrubbed(rows.where("kind is null and open in ('section', 'special')").select(*UNIT, "pos", "text"), chapter_patterns(rows))
    made = blocks.chunk_blocks(body, by=UNIT)
    of = (*UNIT, "ord", "marker", "content_type", "direct")
    pieces = blocks.split_sentences(made, target, most, by=of).drop("tokens")
    place = F.row_number().over(Window.partitionBy(*UNIT).orderBy("ord", "piece")).cast("long")
    pieces = pieces.withColumn("place", place).drop("ord", "piece").withColumnRenamed("place", "ord").join(units.select(*UNIT, F.length("context").alias("context_chars")), list(UNIT))
    groups = blocks.pack(pieces, list(UNIT), "context_chars", target)
    item = F.struct("ord", "marker", "content_type", "direct", "text")
    chunks = pieces.join(groups, [*UNIT, "ord"]).groupBy(*UNIT, F.col("grp").alias("ordinal")).agg(F.sort_array(F.collect_list(item)).alias("b")).join(units, list(UNIT))
    types, plain = F.array_distinct("b.content_type"), F.col("special").isNull()
    direct = F.expr("array_distinct(transform(filter(b, x -> x.direct and x.marker is not null), x -> x.marker))")
    chunk_id = F.when(plain, F.concat_ws("-", F.lit(prefix), F.concat(F.lit("ch"), F.lower(F.coalesce("chapter", F.lit("na")))), F.concat(F.lit("s"), T.safe_id(F.col("number"))), F.concat(F.lit("c"), "ordinal"))).otherwise(F.concat_ws("-", F.lit(prefix), F.lit("special"), "special", F.concat(F.lit("c"), "ordinal")))
    single = F.expr("if(size(b) = 1 and b[0].direct and b[0].marker is not null and b[0].content_type = 'provision', b[0].marker, '')")
    content = F.concat("context", F.lit("\n\n"), F.array_join("b.text", "\n\n"))
    out = chunks.select(
        "doc_id", "unit", "ordinal", chunk_id.alias("chunk_id"), F.lit(act).alias("act"), F.col("chapter").alias("chapter_number"), "chapter_title", F.col("number").alias("section_number"), F.col("title").alias("section_title"),
        F.nullif(F.array_join(direct, ", "), F.lit("")).alias("subsection"), F.when(~plain, F.col("special")).when(F.size(types) == 1, types[0]).otherwise("mixed").alias("content_type"), content.alias("content"), chunk_id.alias("citation_id"),
        F.when(plain, F.concat(F.lit(f"{prefix} §"), "number", single)).otherwise(F.concat(F.lit(f"{act}, "), "title")).alias("citation_text"), F.lit(source_file).alias("source_file"),
    )
    return out.withColumn("tokens", T.approx_tokens(F.col("content")))
