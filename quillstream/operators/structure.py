"""Layout and structure of documents given as positioned lines: margins, anchors, notes, sections, chapters.

Lines: doc_id, page, block_no, line_no, x0, y0, x1, y1, text, page_width, page_height. All windows are by document or page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import CHAPTER_LINE, SECTION_START, chapter_title, is_chapter_title, squeeze

MARGIN, HEADER, FOOTER = 0.19, 0.055, 0.055
NOTE_TOLERANCE, ANCHOR_DISTANCE = 28.0, 8.0


def region() -> Column:
    """header, footer, margin or body; odd pages have their margin on the right, even ones on the left."""
    w, h = F.col("page_width"), F.col("page_height")
    side = F.when(F.col("page") % 2 == 1, F.col("x0") >= w - w * MARGIN).otherwise(F.col("x1") <= w * MARGIN)
    return F.when(F.col("y0") < h * HEADER, "header").when(F.col("y1") > h * (1 - FOOTER), "footer").when(side, "margin").otherwise("body")


def geometry(lines: DataFrame) -> DataFrame:
    return lines.withColumn("height", F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))).withColumn("center_y", (F.col("y0") + F.col("y1")) / 2).withColumn("region", region())


def numbered(lines: DataFrame) -> DataFrame:
    """line_index: the place of each line in its document."""
    order = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "block_no", "line_no")
    return lines.withColumn("line_index", (F.row_number().over(order) - 1).cast("long"))


def candidates(lines: DataFrame, lo: int = 1, hi: int = 358) -> DataFrame:
    """Lines that may start a section, with their number."""
    number = F.regexp_extract("text", SECTION_START, 1).try_cast("int")
    return lines.withColumn("number", number).where(F.col("text").rlike(SECTION_START) & F.col("number").between(lo, hi))


def candidate_positions(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("page", "y0", "x0")
    return found.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def resolve_sequence(found: DataFrame, lo: int, hi: int) -> DataFrame:
    """doc_id, number, status, pos: for each number in turn the first candidate after the last one taken.

    An ordered fold over the numbers lo..hi; a document holds at most as many candidates as lines.
    """
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("number").cast("long").alias("number"), F.col("pos").cast("long").alias("pos"))).alias("c"))
    fold = f"""aggregate(sequence({lo}L, {hi}L),
      named_struct('prev', -1L, 'out', cast(array() as array<struct<number:bigint,status:string,pos:bigint>>)),
      (s, n) -> transform(array(filter(c, x -> x.number = n and x.pos > s.prev)), o -> named_struct(
        'prev', coalesce(array_min(transform(o, x -> x.pos)), s.prev),
        'out', concat(s.out, array(named_struct('number', n, 'status', if(size(o) = 0, 'missing-candidate', if(size(o) = 1, 'selected', 'duplicate-candidates')), 'pos', array_min(transform(o, x -> x.pos)))))))[0],
      s -> s.out)"""
    return lists.select("doc_id", F.explode(F.expr(fold)).alias("x")).select("doc_id", "x.*")


def neighbours(found: DataFrame, resolved: DataFrame, reach: int = 2) -> DataFrame:
    """The candidates whose number is within `reach` of a missing one."""
    near = resolved.where("status = 'missing-candidate'").select("doc_id", F.explode(F.expr(f"sequence(number - {reach}, number + {reach})")).alias("number")).distinct()
    return found.join(near, ["doc_id", "number"], "left_semi")


def section_ranges(lines: DataFrame, starts: Column) -> DataFrame:
    """section: the number of the last start at or before each line; lines before the first are dropped."""
    order = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(starts, ignorenulls=True).over(order)).where("section is not null")


def anchored(margin: DataFrame, anchors: DataFrame, most: float = ANCHOR_DISTANCE) -> DataFrame:
    """Each body anchor (page, number, y0, x0) with the nearest margin line of its page within `most` points."""
    m = margin.select("doc_id", "page", F.col("y0").alias("m_y0"), F.col("x0").alias("m_x0"), F.col("text").alias("m_text"))
    pairs = anchors.join(m, ["doc_id", "page"]).where(F.abs(F.col("y0") - F.col("m_y0")) <= most)
    order = Window.partitionBy("doc_id", "page", "number").orderBy(F.abs(F.col("y0") - F.col("m_y0")), "m_y0", "m_x0")
    return pairs.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def margin_groups(margin: DataFrame) -> DataFrame:
    """Groups of margin lines (with is_anchor): from an anchored line to the next; the whole page where none is; else lines before the first are dropped."""
    page = Window.partitionBy("doc_id", "page")
    gid = F.sum(F.col("is_anchor").cast("int")).over(page.orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, 0))
    rows = margin.withColumn("gid", gid).withColumn("top", F.max("gid").over(page)).where("gid > 0 or top = 0")
    return bounding_boxes(rows, "doc_id", "page", "gid")


def bounding_boxes(lines: DataFrame, *by: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), " ")
    return lines.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"))


def chapters_of(sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """The last chapter whose page is not after the section's: an as-of join by union and forward fill."""
    both = sections.select("doc_id", "page", F.lit(1).alias("side"), F.col("number").alias("section"), F.lit(None).cast("string").alias("chapter"), F.lit(0.0).alias("y")).unionByName(
        chapters.select("doc_id", "page", F.lit(0).alias("side"), F.lit(None).cast(sections.schema["number"].dataType).alias("section"), "chapter", "y")
    )
    order = Window.partitionBy("doc_id").orderBy("page", "side", "y").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("chapter", F.last("chapter", ignorenulls=True).over(order)).where("side = 1").select("doc_id", "section", "chapter")


def associate_notes(groups: DataFrame, sections: DataFrame, tol: float = NOTE_TOLERANCE) -> DataFrame:
    """Margin groups (doc_id, page, gid, y0, y1) with section, method, confidence; nulls where none fits.

    An interval of the page, else the section that runs on from an earlier page; a start within tol overrides both.
    """
    g = groups.withColumn("center", (F.col("y0") + F.col("y1")) / 2)
    page = Window.partitionBy("doc_id", "page").orderBy("s_y0")
    s = sections.select("doc_id", "page", F.col("number"), F.col("y0").alias("s_y0"))
    s = s.withColumn("s_next", F.lead("s_y0").over(page)).withColumn("s_first", F.min("s_y0").over(Window.partitionBy("doc_id", "page")))
    joined = g.join(s, ["doc_id", "page"], "left")
    inside = (F.col("center") >= F.col("s_y0") - tol) & (F.col("s_next").isNull() | (F.col("center") < F.col("s_next") - tol))
    d = F.abs(F.col("center") - F.col("s_y0"))
    per = joined.groupBy("doc_id", "page", "gid").agg(
        F.min(F.when(inside, F.struct(F.col("s_y0"), F.col("number"), d.alias("d")))).alias("own"),
        F.min(F.when(d <= tol, F.struct(d.alias("d"), F.col("s_y0"), F.col("number")))).alias("near"),
        F.count("number").alias("n"),
        F.max(F.col("center") < F.col("s_first")).alias("above"),
    )
    # the section that began last on an earlier page
    marks = s.select("doc_id", "page", F.lit(0).alias("side"), "s_y0", "number", F.lit(None).cast("long").alias("gid")).unionByName(per.select("doc_id", "page", F.lit(0).alias("side"), F.lit(-1.0).alias("s_y0"), F.lit(None).cast(s.schema["number"].dataType).alias("number"), F.col("gid").cast("long").alias("gid")))
    run = Window.partitionBy("doc_id").orderBy("page").rangeBetween(Window.unboundedPreceding, -1)
    active = marks.withColumn("active", F.max(F.when(F.col("number").isNotNull(), F.struct("page", "s_y0", "number"))).over(run)).where("gid is not null").select("doc_id", "page", "gid", F.col("active.number").alias("active"))
    per = per.withColumn("gid", F.col("gid").cast("long")).join(active, ["doc_id", "page", "gid"])
    method = (
        F.when(F.col("near").isNotNull(), "same-page-section-start-alignment").when(F.col("own").isNotNull(), "same-page-section-interval")
        .when((F.col("n") > 0) & F.col("above") & F.col("active").isNotNull(), "previous-page-active-section").when((F.col("n") == 0) & F.col("active").isNotNull(), "continuation-page-active-section")
    )
    conf = F.when(F.col("near").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("near.d") / tol)).when(F.col("own").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("own.d") / (2 * tol))).when(method == "previous-page-active-section", 0.70).when(method.isNotNull(), 0.65)
    number = F.when(F.col("near").isNotNull(), F.col("near.number")).when(F.col("own").isNotNull(), F.col("own.number")).when(method.isNotNull(), F.col("active"))
    return per.select("doc_id", "page", "gid", number.alias("section"), method.alias("method"), F.round(conf, 4).alias("confidence"))


def detect_chapters(lines: DataFrame, ahead: int = 5) -> DataFrame:
    """doc_id, line_index, number, title: a chapter line and the title lines among the next five.

    The look-ahead ends at a chapter or section line, and once a title has begun at the first line that is none.
    """
    order = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(1, ahead)
    kind = F.when(F.col("text").rlike(CHAPTER_LINE) | F.col("text").rlike(SECTION_START), "stop").when(is_chapter_title(F.col("text")), "title").otherwise("other")
    rows = lines.withColumn("kind", kind).withColumn("next", F.collect_list(F.struct("kind", "text")).over(order)).where(F.col("text").rlike(CHAPTER_LINE))
    fold = """aggregate(next, named_struct('open', true, 'got', cast(array() as array<string>)),
      (s, x) -> if(not s.open or x.kind = 'stop' or (x.kind = 'other' and size(s.got) > 0), named_struct('open', false, 'got', s.got),
        if(x.kind = 'title', named_struct('open', true, 'got', concat(s.got, array(x.text))), s)), s -> s.got)"""
    titled = rows.withColumn("titles", F.expr(fold))
    return titled.select("doc_id", "line_index", F.upper(F.regexp_extract("text", CHAPTER_LINE, 1)).alias("number"), F.nullif(chapter_title(F.col("titles")), F.lit("")).alias("title"))


def clean_blank_lines(lines: DataFrame) -> DataFrame:
    """Trim blank lines at head and tail of a document and collapse runs of them; lines: doc_id, pos, text."""
    doc = Window.partitionBy("doc_id")
    blank = F.trim("text") == ""
    rows = lines.withColumn("blank", blank).withColumn("first", F.min(F.when(~blank, F.col("pos"))).over(doc)).withColumn("last", F.max(F.when(~blank, F.col("pos"))).over(doc))
    rows = rows.where("pos between first and last").withColumn("before", F.lag("blank").over(doc.orderBy("pos")))
    return rows.where("not (blank and coalesce(before, false))").select("doc_id", "pos", F.when(F.col("blank"), "").otherwise(F.col("text")).alias("text"))


def on_change(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The rows where `column` differs from the row before in their document: where a header is written."""
    before = F.lag(column).over(Window.partitionBy("doc_id").orderBy(order))
    return rows.withColumn("emit", ~F.col(column).eqNullSafe(before) | (F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) == 1))


HEADING_CHARS = 3


def scored_candidates(found: DataFrame, lo: int = 1, hi: int = 358) -> DataFrame:
    """Candidates (number, text, x0, y0, page_width, page_height) with confidence and reasons: 1 in the range of numbers, and 0.05 more for each of text, place across and place down, at most 1."""
    rest = F.regexp_extract("text", SECTION_START, 2)
    x, h = F.col("x0") / F.greatest(F.col("page_width"), F.lit(1.0)), F.col("page_height")
    signs = [(F.length(F.trim(rest)) >= HEADING_CHARS, "has-section-text"), (x.between(0.05, 0.75), "broad-body-x-position"), (F.col("y0").between(h * HEADER, h * (1 - FOOTER)), "body-y-position")]
    inside = F.col("number").between(lo, hi)
    reasons = F.filter(F.array(F.lit("strict-section-syntax"), *[F.when(ok, F.lit(name)) for ok, name in signs]), lambda r: r.isNotNull())
    score = F.lit(1.0)
    for ok, _ in signs:
        score = score + F.when(ok, 0.05).otherwise(0.0)
    return found.withColumn("confidence", F.when(inside, F.least(score, F.lit(1.0))).otherwise(0.0)).withColumn("reason", F.when(inside, reasons).otherwise(F.array(F.lit("outside-BNS-section-range"))))


def _box(prefix: str = "") -> Column:
    return F.array(*[F.round(F.col(prefix + c), 2) for c in ("x0", "y0", "x1", "y1")])


def candidate_json(scored: DataFrame) -> DataFrame:
    """The candidates as JSON, coordinates to 2 places and confidence to 3."""
    return scored.select("doc_id", "line_index", F.to_json(F.struct(F.col("number"), F.col("page"), F.col("line_index"), _box().alias("bbox"), F.col("text"), F.round("confidence", 3).alias("confidence"), F.col("reason"))).alias("json"))


def section_records(lines: DataFrame, starts: DataFrame, notes: DataFrame) -> DataFrame:
    """One record for each section start: text, pages, start, end, notes.

    lines (doc_id, section, line_index, page, x0, y0, x1, y1, text) with the section they belong to; starts (doc_id,
    section, page, x0, y0, x1, y1); notes (doc_id, section, text). A section without lines ends where it starts. Text is the
    cleaned lines joined by line feeds, pages are distinct and sorted, notes sorted.
    """
    clean = squeeze(F.col("text"))
    line = F.struct("line_index", clean.alias("t"))
    body = lines.groupBy("doc_id", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(clean != "", line))), lambda x: x["t"]), "\n").alias("text"), F.array_sort(F.collect_set("page")).alias("pages"),
        F.max_by(F.struct("page", *[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")]), "line_index").alias("end"), F.count("*").alias("n_lines"),
    )
    of = notes.where("section is not null").groupBy("doc_id", "section").agg(F.array_sort(F.collect_list("text")).alias("notes"))
    start = F.struct("page", *[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])
    out = starts.select("doc_id", "section", start.alias("start")).join(body, ["doc_id", "section"], "left").join(of, ["doc_id", "section"], "left")
    return out.select("doc_id", "section", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"), "start", F.coalesce("end", "start").alias("end"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def note_counts(notes: DataFrame) -> DataFrame:
    """doc_id, n_notes, n_associated, n_unassociated."""
    return notes.groupBy("doc_id").agg(F.count("*").alias("n_notes"), F.count("section").alias("n_associated"), F.count_if(F.col("section").isNull()).alias("n_unassociated"))


def unassociated(notes: DataFrame) -> DataFrame:
    """A warning for each note that no section claims."""
    return notes.where("section is null").select("doc_id", "page", "gid", F.lit("unassociated-margin-note").alias("warning"))
