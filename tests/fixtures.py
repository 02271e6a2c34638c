"""Small invented inputs for operators whose input the test tables don't have, as rows that both engines can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES = ("doc_id long, page int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double", [])

CANDIDATES = ("doc_id long, number int, page int, y0 double, x0 double", [(1, n, 1 + i // 4, 100.0 + 40 * (i % 4), 72.0) for i, n in enumerate((1, 2, 2, 5, 3, 4, 7))] + [(2, 3, 1, 90.0, 72.0), (2, 1, 1, 120.0, 72.0), (2, 2, 2, 60.0, 72.0)])

SECTIONS = ("doc_id long, page int, number int, y0 double", [(1, 1, 1, 100.0), (1, 1, 2, 400.0), (1, 3, 3, 300.0), (2, 2, 1, 200.0)])
GROUPS = ("doc_id long, page int, gid int, y0 double, y1 double", [(1, 1, 1, 98.0, 112.0), (1, 1, 2, 300.0, 320.0), (1, 2, 1, 100.0, 120.0), (1, 3, 1, 60.0, 80.0), (1, 3, 2, 350.0, 380.0), (2, 1, 1, 50.0, 60.0)])
#: The association that follows from the rules, worked by hand.
NOTES = [
    (1, 1, 1, 1, "same-page-section-start-alignment", 0.8214), (1, 1, 2, 1, "same-page-section-interval", 0.0), (1, 2, 1, 2, "continuation-page-active-section", 0.65),
    (1, 3, 1, 2, "previous-page-active-section", 0.7), (1, 3, 2, 3, "same-page-section-interval", 0.0), (2, 1, 1, None, None, None),
]
CHAPTERS = ("doc_id long, page int, y double, chapter string", [(1, 1, 50.0, "I"), (1, 3, 350.0, "II"), (2, 5, 40.0, "I")])

TITLES = ("doc_id long, line_index long, text string", [(1, i, t) for i, t in enumerate(("intro", "CHAPTER I", "O F  F R A U D", "AND DECEIT , GENERALLY", "lower text", "MORE CAPS", "CHAPTER II", "plain line", "LATE TITLE", "1. Start of it", "CHAPTER III", "2. No title here"))])
#: doc_id, line_index, number, title, worked by hand.
TITLED = [(1, 1, "I", "OFFRAUD AND DECEIT, GENERALLY"), (1, 6, "II", "LATE TITLE"), (1, 10, "III", None)]

STRUCT = ("doc_id long, section long, pos int, text string", [(1, 7, i, t) for i, t in enumerate((
    "7. (1) Whoever does a thing", "shall answer , for it", "(a) by word;", "(iv) or sign;", "Explanation 2.—A sign is a mark.", "Illustrations", "(a) A waves to B.", "(3) C nods.", "(2) Whoever tries it", "Provided that no harm", "(b) is done."))])
#: doc_id, section, ord, kind, marker, parent_type, parent_marker, text, worked by hand.
BLOCKS = [
    (1, 7, 1, "subsection", "(1)", None, None, "Whoever does a thing shall answer, for it"), (1, 7, 2, "clause", "(a)", "subsection", "(1)", "by word;"), (1, 7, 3, "subclause", "(iv)", "subsection", "(1)", "or sign;"),
    (1, 7, 4, "explanation", "Explanation", None, None, "—A sign is a mark."), (1, 7, 5, "illustration", "Illustration", None, None, ""), (1, 7, 6, "illustration_item", "(a)", "illustration", "Illustration", "A waves to B."),
    (1, 7, 7, "illustration_item", "(3)", "illustration", "Illustration", "C nods."), (1, 7, 8, "subsection", "(2)", None, None, "Whoever tries it"), (1, 7, 9, "proviso", "Provided that", None, None, "no harm"),
    (1, 7, 10, "clause", "(b)", "subsection", "(2)", "is done."),
]
CLASSIFY = ("id long, text string", list(enumerate(("(1) first", "(iv) fourth", "(c) a roman letter", "(b) letter", "Explanation 2.—It is so", "Illustrations: these", "Provided further that not", "plain words", "(A) upper"))))
CLASSIFIED = [
    (0, "subsection", "(1)", "first"), (1, "subclause", "(iv)", "fourth"), (2, "subclause", "(c)", "a roman letter"), (3, "clause", "(b)", "letter"), (4, "explanation", "Explanation", "—It is so"),
    (5, "illustration", "Illustration", "these"), (6, "proviso", "Provided that", "not"), (7, "text", None, "plain words"), (8, "clause", "(A)", "upper"),
]
UNIT = ("unit long, pos int, text string", [(1, i, t) for i, t in enumerate((
    "**Marginal note:** Theft", "Opening words.", "**(1)** Whoever takes", "and keeps,", "**(a)** by force;", "---", "**Explanation:** Keeping counts.", "**(b)** inside", "**(2)** A second.", "Provided that it is kept", "**(c)** after", "**(3)**, not a marker", "**Illustration:** A takes."))])
UNIT_BLOCKS = [
    (1, 1, None, "provision", False, "Opening words."), (1, 2, "(1)", "provision", True, "**(1)** Whoever takes\nand keeps,"), (1, 3, "(a)", "provision", False, "**(a)** by force;"), (1, 4, None, "explanation", False, "**Explanation:** Keeping counts."),
    (1, 5, "(b)", "provision", False, "**(b)** inside"), (1, 6, "(2)", "provision", True, "**(2)** A second.\nProvided that it is kept"), (1, 7, "(c)", "provision", False, "**(c)** after\n**(3)**, not a marker"), (1, 8, None, "illustration", False, "**Illustration:** A takes."),
]
CANON = ("id long, text string", list(enumerate((" **(1)** words ", "**(a)**", "Explanation 3 — so", "**Exception** : not", "Illustration A did", "plain", "<!-- source_pages=3,4,x, 7; section=12 -->"))))
CANONICAL = [(0, "**(1)** words", ""), (1, "**(a)**", ""), (2, "**Explanation:** so", ""), (3, "**Exception:** not", ""), (4, "**Illustration:** A did", ""), (5, "plain", ""), (6, "<!-- source_pages=3,4,x, 7; section=12 -->", "3,4,7")]
BLANKS = ("doc_id long, pos int, text string", [(1, i, t) for i, t in enumerate(("", " ", "a", "", "", "b", "c", "", "d", " ", ""))])
PACKED = ("act string, prefix string, chapter string, section string, special string, unit long, grp long, ord long, marker string, content_type string, direct boolean, text string", [
    ("Penal Act", "pa", "IV", "16-A", None, 1, 1, 1, "(1)", "provision", True, "x"), ("Penal Act", "pa", "IV", "16-A", None, 1, 2, 2, "(2)", "provision", True, "y"), ("Penal Act", "pa", "IV", "16-A", None, 1, 2, 3, None, "explanation", False, "z"),
    ("Penal Act", "pa", None, "17", None, 2, 1, 1, None, "provision", False, "w"), ("Penal Act", "pa", None, None, "preamble", 3, 1, 1, None, "provision", False, "p")])
CHUNKS = [
    ("pa-chiv-s16_A-c1", "16-A", "(1)", "provision", "x", "PA §16-A(1)"), ("pa-chiv-s16_A-c2", "16-A", "(2)", "mixed", "y\n\nz", "PA §16-A"), ("pa-chna-s17-c1", "17", None, "provision", "w", "PA §17"),
    ("pa-special-preamble-c1", None, None, "preamble", "p", "Penal Act, preamble"),
]
ANSWERS = ("qid long, answer string, allowed string, retrieved string, gold string, direct string", [
    (1, "Theft is taking [BNS §303] and more [BNS §303]; see [ICA §73].", "[BNS §303];[ICA §73]", "303;73", "303;305", "303"), (2, "It is so [BNS  §1].", "[BNS §2]", "2", "2", "2"), (3, "[ICA §10]", "[ICA §10]", "10", "", ""),
    (4, "I could not retrieve relevant legal provisions.", "", "", "5", "5"), (5, "The retrieved evidence is insufficient here.", "[BNS §16-A]", "16-A", "16-A", ""), (6, "Plain words [XX §1].", "[BNS §9]", "9", "9", "9")])
GOLDEN = ("value string", [('{"acts":{"bns":{"questions":[{"id":"q1","act":"bns","query":"a","gold":[{"section_number":"1","relevance_grade":2,"chunk_ids":["c1","c2"]},{"section_number":"2","relevance_grade":1,"chunk_ids":["c2","c3"]}]}]}}}',), ('{"questions":[{"id":"q2","act":"ica","query":"b","gold":[{"section_number":"9","relevance_grade":1,"chunk_ids":["c9"]}]}]}',)])
GOLDEN_KEYS = [("q1", "c1", 2), ("q1", "c2", 2), ("q1", "c3", 1), ("q2", "c9", 1)]
MARKDOWN = ("doc_id long, pos int, text string", [(1, i, t) for i, t in enumerate((
    "# The Invented Act", "loose words", "## PREAMBLE", "", "Whereas it is fit,", "", "", "be it so.", "## Related Judgements", "A v. B", "# CHAPTER I — Of Theft", "opening of the chapter", "## Section 1", "**Marginal note:** Theft", "<!-- source_pages=3,4; section=1 -->",
    "**(1)**  Whoever takes", "", "", "Explanation 1 — taking is moving.", "**Marginal note:** Taking", "## Section 16-A. Other   things", "text", "## Schedule", "row"))])
#: owner, chapter, number, title, note, pages, body of its blocks, worked by hand.
NORMALIZED = [
    (1, 0, "preamble", None, None, None, None, "", "loose words"), (1, 1, "special", None, None, "Preamble", None, "", "Whereas it is fit,\n\nbe it so."), (1, 2, "special", None, None, "Related Judgements", None, "", "A v. B"),
    (1, 3, "chapter", "I", None, "Of Theft", None, "", "opening of the chapter"), (1, 4, "section", "I", "1", "Theft", "Taking", "3,4", "**(1)** Whoever takes\n\n**Explanation:** taking is moving."),
    (1, 5, "section", "I", "16-A", "Other things", None, "", "text"), (1, 6, "special", "I", None, "Schedule", None, "", "row"),
]
UNIT_LINES = ("doc_id long, pos int, text string", [(1, i, t) for i, t in enumerate((
    "dropped", "# Chapter I — Of Theft", "dropped too", "## Section 1", "**Marginal note:** Taking", "body", "**Marginal note:** Other", "## Schedule", "row", "# Chapter II - Of Fraud", "gone", "## Section 2 — Cheating", "last"))])
UNITS = [
    (1, 1, "1", "Taking", "I", "Of Theft", None, "**Marginal note:** Taking|body|**Marginal note:** Other"), (1, 2, None, "Schedule", "I", "Of Theft", "schedule", "row"), (1, 3, "2", "Cheating", "II", "Of Fraud", None, "last"),
]


def frame(spark: SparkSession, fixture: tuple[str, list]) -> DataFrame:
    return spark.createDataFrame(fixture[1], fixture[0])


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else repr(value)


def values(rows: list[tuple], names: str) -> str:
    """Rows as a SQL table expression with column names."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"
