"""One row must not end the application, and columns may have any name."""

import pytest

from quillstream.llm import ann_tree, langid, line_dedup, minhash, quotes, surrogates, winnowing, wrappers
from tests.llm.helpers import prose

ODD = ("a.b", "row", "doc", "rid", "text2", "keep")


def test_a_hundred_thousand_quote_marks(spark):
    rows = [(1, 1, "user", "Hello there, this is the first message."), (1, 2, "user", ">" * 100_000 + " Hello there, this is the first message.\nYes."), (1, 3, "user", "> > " * 20_000 + "x"), (1, 4, "user", "> Hello there, this is the first message.\n>> deeper\nNo.")]
    found = {r["turn"]: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(found[t]["text"], found[t]["n_quoted"], found[t]["n_linked"]) for t in (2, 3, 4)] == [("Yes.", 1, 1), ("", 1, 0), ("No.", 2, 1)]


def test_a_host_of_a_hundred_thousand_labels(spark):
    rows = [(1, "write to a@" + "x." * 100_000 + "com now"), (2, "write to jo.doe@mail.example.com, or call"), (3, "a@" * 50_000), (4, "x@foo.com... then")]
    found = {r["doc_id"]: r for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i]["n_entities"] for i in (2, 3, 4)] == [1, 0, 1]
    assert found[2]["text"].endswith(".com, or call") and "jo.doe" not in found[2]["text"] and found[4]["text"].endswith(".com... then")


@pytest.mark.parametrize("stage", ["language", "lines", "near", "benchmark"])
def test_columns_of_any_name(spark, stage):
    rows = [(i, prose(60, i) + "\nthe same line in every text of this table\n" + prose(20, 99 + i), "en", "s", *ODD) for i in range(6)] + [(9, None, "en", "s", *ODD)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *ODD])
    items = spark.createDataFrame([(1, prose(60, 2))], "item_id long, text string")
    run = {"language": langid.keep_identified, "lines": line_dedup.replace_texts, "near": minhash.keep_one, "benchmark": lambda d: winnowing.drop_contaminated(d, items)}[stage]
    got = run(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert {len(found)} <= {6, 7} and all(tuple(r)[4:] == ODD for r in found)


@pytest.mark.parametrize("element", ["article", "div class='story'"])
def test_headings_and_items_that_articles_share_stay(spark, element):
    """Eight pages of a host with the same section headings and two ingredients in common; menu, share line and footer are the template's."""
    page = lambda i: f"""<html><body><div><p>Site name</p><p>Home</p></div><{element}><h1>{prose(5, i)}</h1><p>{prose(30, 50 + i)}</p><h2>Introduction</h2><p>{prose(40, 100 + i)}</p>
      <ul><li>salt</li><li>{prose(3, 200 + i)}</li><li>butter</li></ul><h2>Methods</h2><p>{prose(40, 300 + i)}</p><p>Share this page</p></{element.split()[0]}><div><p>All rights reserved</p></div></body></html>"""  # noqa: E731
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    found = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in found:
        lines = r["text"].split("\n")
        assert [x for x in lines if x in ("Introduction", "salt", "butter", "Methods")] == ["Introduction", "salt", "butter", "Methods"] and len(lines) == 9
        assert "Share this page" not in lines and "Home" not in lines and "All rights reserved" not in lines


def test_calibration_rows_are_no_part_of_the_fit(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    index = ann_tree.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    held = {r["vec_id"] for r in index.held.collect()}
    assert len(held) == 100 and index.measured >= ann_tree.RECALL
    assert ann_tree.Index(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).total == 1
