"""Logical blocks, chunk blocks, sentence splitting, token-budget packing, chunk ids, and chunks from Markdown in one call.

What a line is follows from windows over its section or unit: which block is open, what was set or cleared last. Where a decision feeds
back into the next one (leaving an illustration, filling a chunk) a fold runs in the JVM over numbers only: the section's numbered lines,
the lengths of a unit's blocks. Texts pass by these folds and are put together by group afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T

TARGET, MOST = 450, 650


def _upto(order, last: int = 0):
    return order.rowsBetween(Window.unboundedPreceding, last)


#: A section's events in order (pos; what: illustration, close or number; n): the places of the numbered lines that leave an
#: illustration, being the number after the last subsection's. Its state: whether an illustration is open, and that subsection.
_LEAVING = """aggregate(events, named_struct('inside', false, 'sub', cast(null as decimal(38)), 'out', cast(array() as array<bigint>)),
  (s, e) -> case when e.what = 'illustration' then named_struct('inside', true, 'sub', s.sub, 'out', s.out)
                 when e.what = 'close' then named_struct('inside', false, 'sub', s.sub, 'out', s.out)
                 when not s.inside then named_struct('inside', false, 'sub', e.n, 'out', s.out)
                 when e.n = s.sub + 1 then named_struct('inside', false, 'sub', e.n, 'out', concat(s.out, array(e.pos)))
                 else s end,
  s -> s.out)"""


def logical_blocks(lines: DataFrame) -> DataFrame:
    """lines (doc_id, section, pos, text), cleaned -> doc_id, section, ord, kind, marker, parent_type, parent_marker, text, first_pos, last_pos, n_lines.

    A line opens a block if a pattern of the classifier fits; inside an illustration numbered and lettered lines are its items, but for the number that follows the last
    subsection's. Clauses belong to the open subsection, else to the open proviso. Other lines continue the block; before any block they are section text.
    Blank and null lines don't count; the first line loses the section's number.
    """
    by = ["doc_id", "section"]
    order = Window.partitionBy(*by).orderBy("pos")
    rows = lines.where(F.trim("text") != "").withColumn("pos", F.col("pos").cast("long")).withColumn("nth", F.row_number().over(order))
    bare = F.trim(F.regexp_replace("text", F.concat(F.lit(r"^\s*"), F.col("section").cast("string"), F.lit(r"\s*\.\s*")), F.lit("")))
    rows = rows.withColumn("c", T.classify(F.when(F.col("nth") == 1, bare).otherwise(F.col("text")))).select(*by, "pos", "nth", "c.*")
    closes = F.col("kind").isin("explanation", "proviso")
    what = F.when(F.col("kind") == "illustration", "illustration").when(closes, "close").when(F.col("kind") == "subsection", "number")
    number = F.regexp_extract("marker", r"\d+", 0).try_cast("decimal(38)")
    events = rows.where(what.isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", what.alias("what"), number.alias("n")))).alias("events"))
    leaving = events.where("exists(events, e -> e.what = 'illustration')").select(*by, F.explode(F.expr(_LEAVING)).alias("pos"), F.lit(True).alias("leaves"))
    rows = rows.join(leaving, [*by, "pos"], "left").withColumn("leaves", F.coalesce("leaves", F.lit(False)))
    inside = F.coalesce(F.last(F.when(F.col("kind") == "illustration", True).when(closes | F.col("leaves"), False), ignorenulls=True).over(_upto(order, -1)), F.lit(False))
    rows = rows.withColumn("kind", F.when(inside & F.col("kind").isin("subsection", "subclause", "clause") & ~F.col("leaves"), "illustration_item").otherwise(F.col("kind")))
    subsection = F.last(F.when(F.col("kind") == "subsection", F.col("marker")), ignorenulls=True).over(_upto(order, -1))
    proviso = F.coalesce(F.last(F.when(F.col("kind") == "proviso", True).when(F.col("kind").isin("subsection", "explanation"), False), ignorenulls=True).over(_upto(order, -1)), F.lit(False))
    parent = lambda sub, pro, item: F.when(F.col("kind") == "illustration_item", item).when(F.col("kind").isin("clause", "subclause"), F.when(F.col("sub").isNotNull(), sub).when(F.col("pro"), pro))
    rows = rows.withColumn("sub", subsection).withColumn("pro", proviso).withColumn("opens", F.when((F.col("kind") != "text") | (F.col("nth") == 1), 1).otherwise(0))
    rows = rows.withColumn("parent_type", parent(F.lit("subsection"), F.lit("proviso"), F.lit("illustration"))).withColumn("parent_marker", parent(F.col("sub"), F.lit("Provided that"), F.lit("Illustration")))
    rows = rows.withColumn("ord", F.sum("opens").over(_upto(order)).cast("long"))
    head = lambda c: F.max(F.when(F.col("opens") == 1, c))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return rows.groupBy(*by, "ord").agg(
        head(F.when(F.col("kind") == "text", "section_text").otherwise(F.col("kind"))).alias("kind"), head(F.col("marker")).alias("marker"), head(F.col("parent_type")).alias("parent_type"),
        head(F.col("parent_marker")).alias("parent_marker"), T.join_lines(parts).alias("text"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_lines"),
    )


def chunk_blocks(lines: DataFrame, by: tuple[str, ...] = ("unit",)) -> DataFrame:
    """lines (by.., pos, text) -> by.., ord, marker, content_type, direct, text: the blocks of a unit that chunks are packed from.

    A line with a bold marker or type opens a block. The kind of a unit's first marker (number, letter, roman) is its top kind; markers of that kind are
    direct, but after an explanation or a proviso only numbers bring a numbered unit back to its top. Blank lines, rules and marginal notes are left out.
    """
    order = Window.partitionBy(*by).orderBy("pos")
    line = F.trim(F.regexp_replace("text", "[ \t]+", " "))
    rows = lines.select(*by, "pos", line.alias("line")).where((F.col("line") != "") & (F.col("line") != "---") & ~F.col("line").rlike(T.MARGINAL_NOTE))
    follows = F.regexp_extract("line", T.BOLD_MARKER, 2)
    marker = F.when(F.col("line").rlike(T.BOLD_MARKER) & ~F.ltrim(follows).rlike(r"^[,.;:)]"), F.regexp_extract("line", T.BOLD_MARKER, 1))
    rows = rows.withColumn("marker", marker).withColumn("type", F.when(F.col("marker").isNull() & F.col("line").rlike(T.BOLD_TYPE), F.lower(F.regexp_extract("line", T.BOLD_TYPE, 1))))
    kind = F.when(F.col("marker").rlike(r"^\(\d+\)$"), "numeric").when(F.length("marker") == 3, "alpha").when(F.col("marker").isNotNull(), "roman")
    rows = rows.withColumn("kind", kind).withColumn("top", F.first("kind", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("first", F.col("marker").isNotNull() & (F.count("marker").over(_upto(order)) == 1))
    numbers = (F.col("kind") == "numeric") & (F.col("top") == "numeric")
    proviso = F.lower(F.trim(F.regexp_replace("line", r"^\s*\*\*|\*\*\s*$", ""))).startswith("provided that")
    event = F.when(F.col("first") | numbers, False).when((F.col("type") == "explanation") | (F.col("marker").isNull() & F.col("type").isNull() & proviso), True)
    nested = F.coalesce(F.last(event, ignorenulls=True).over(_upto(order, -1)), F.lit(False))
    rows = rows.withColumn("direct", F.coalesce(F.col("first") | F.when(nested, numbers).otherwise(F.col("kind") == F.col("top")), F.lit(False)))
    head = F.col("marker").isNotNull() | F.col("type").isNotNull()
    rows = rows.withColumn("head", head).withColumn("grp", F.count_if(head).over(_upto(order)))
    rows = rows.withColumn("ord", F.col("grp") + F.when(F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 0).otherwise(1))
    of = lambda c: F.max(F.when(F.col("head"), c))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(*by, "ord").agg(of(F.col("marker")).alias("marker"), F.coalesce(of(F.col("type")), F.lit("provision")).alias("content_type"), F.coalesce(of(F.col("direct")), F.lit(False)).alias("direct"), text.alias("text"))


#: A fold over pieces of a text: add while the joined length stays within the budget, else begin a new group.
_PACK = """aggregate({lens}, named_struct('len', {base}, 'n', 0L, 'out', cast(array() as array<bigint>)),
  (s, x) -> if(s.n > 0 and ceil((s.len + {gap} + x) / 4.0) > {target},
    named_struct('len', {base} + {first} + x, 'n', 1L, 'out', concat(s.out, array(coalesce(element_at(s.out, -1), 0L) + 1))),
    named_struct('len', s.len + if(s.n = 0, {first}, {gap}) + x, 'n', s.n + 1, 'out', concat(s.out, array(if(size(s.out) = 0, 1L, element_at(s.out, -1)))))),
  s -> s.out)"""


def pack(blocks: DataFrame, key: str | list[str] = "doc_id", context_chars: int | str = 0, target: int = TARGET) -> DataFrame:
    """blocks (key, ord, text) -> key, ord, grp: greedy groups whose context and blocks, joined by blank lines, stay within `target` tokens.

    context_chars: the length of the context of all, or the column that holds that of each key. Only lengths enter the fold. A first block always enters, however long.
    """
    keys = [key] if isinstance(key, str) else list(key)
    lengths = F.array_sort(F.collect_list(F.struct("ord", F.length("text").cast("long").alias("len"))))
    base = F.max(F.col(context_chars) if isinstance(context_chars, str) else F.lit(context_chars)).cast("long")
    lists = blocks.groupBy(*keys).agg(lengths.alias("b"), base.alias("base"))
    groups = F.expr("transform(array(transform(b, x -> x.len)), lens -> " + _PACK.format(lens="lens", base="base", first="if(base > 0, 2L, 0L)", gap="2L", target=target) + ")[0]")
    return lists.select(*keys, F.posexplode(groups).alias("i", "grp"), "b").select(*keys, F.expr("b[i].ord").alias("ord"), "grp")


def split_sentences(texts: DataFrame, target: int = TARGET, most: int = MOST, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """texts (by.., text) -> by.., piece, text, tokens: texts over `most` tokens cut after .!?; and packed again by spaces."""
    parts = texts.withColumn("s", F.when(T.approx_tokens(F.col("text")) <= most, F.array("text")).otherwise(F.split("text", r"(?<=[.!?;])\s+")))
    rows = parts.select(*by, F.expr("transform(array(transform(s, x -> cast(length(x) as bigint))), lens -> " + _PACK.format(lens="lens", base="0L", first="0L", gap="1L", target=target) + ")[0]").alias("g"), "s")
    # a group is a run of sentences: its place and number of them cut it out of the array
    runs = F.expr("transform(sequence(1L, element_at(g, -1)), k -> named_struct('piece', k, 'text', array_join(slice(s, array_position(g, k), size(filter(g, x -> x = k))), ' ')))")
    merged = F.when(F.size("s") == 1, F.array(F.struct(F.lit(1).cast("long").alias("piece"), F.col("s")[0].alias("text")))).otherwise(runs)
    out = rows.select(*by, F.explode(merged).alias("p")).select(*by, "p.piece", "p.text")
    return out.withColumn("tokens", T.approx_tokens(F.col("text")))


def chunks(blocks: DataFrame) -> DataFrame:
    """Grouped blocks (act, prefix, chapter, section, special, unit, grp, ord, marker, content_type, direct, text) -> one row for each chunk with its ids."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "marker", "content_type", "direct", "text")))
    c = blocks.groupBy("act", "prefix", "chapter", "section", "special", "unit", "grp").agg(ordered.alias("b"))
    c = c.withColumn("ordinal", F.row_number().over(Window.partitionBy("prefix", "unit").orderBy("grp")))
    types = F.array_distinct(F.expr("b.content_type"))
    marks = F.expr("array_distinct(transform(filter(b, x -> x.direct and x.marker is not null), x -> x.marker))")
    one = F.expr("size(b) = 1 and b[0].marker is not null and b[0].direct and b[0].content_type = 'provision'")
    normal_id = F.concat_ws("-", F.col("prefix"), F.concat(F.lit("ch"), F.lower(F.coalesce("chapter", F.lit("na")))), F.concat(F.lit("s"), T.safe_id(F.coalesce("section", F.lit("")))), F.concat(F.lit("c"), F.col("ordinal")))
    special_id = F.concat_ws("-", F.col("prefix"), F.lit("special"), F.col("special"), F.concat(F.lit("c"), F.col("ordinal")))
    cite = F.when(F.col("special").isNotNull(), F.concat("act", F.lit(", "), F.col("special"))).otherwise(F.concat(F.upper("prefix"), F.lit(" §"), F.coalesce("section", F.lit("")), F.when(one, F.expr("b[0].marker")).otherwise("")))
    return c.select(
        F.when(F.col("special").isNotNull(), special_id).otherwise(normal_id).alias("chunk_id"),
        "section",
        F.nullif(F.array_join(marks, ", "), F.lit("")).alias("subsection"),
        F.when(F.col("special").isNotNull(), F.col("special")).when(F.size(types) == 1, types[0]).otherwise("mixed").alias("content_type"),
        F.array_join(F.expr("b.text"), "\n\n").alias("content"),
        cite.alias("citation_text"),
    )
