"""Nearest neighbours, toxicity, wrappers, mixing, language ID, the pipeline."""

import html
import re
import struct
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstream.llm import ann_tree, langid, mixing, queries, toxicity, wrappers
from tests.llm.helpers import frame, prose


def brute_neighbours(rows, k=5):
    rows = [(i, np.asarray(v, float)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_search_of_few_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(0, 120, 30)] + [(50, [1.0, 0.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0, 0.0])]
    bad = [(150, None), (200, [0.0] * 4), (250, [1.0, float("nan"), 0.0, 0.0]), (300, [1.0, None, 0.0, 0.0]), (350, [1.0]), (None, [1.0] * 4), (400, [float("inf")] * 4)]
    got = ann_tree.search_report(vectors(spark, good + bad)).collect()
    want = brute_neighbours(good)
    assert {q: [(r.vec_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == {q: [(i, round(s, 9)) for i, s in v] for q, v in want.items()}
    assert {r.query_id for r in got} == set(want)


def test_search_of_nothing(spark):
    assert ann_tree.search_report(vectors(spark, [])).count() == 0
    assert ann_tree.search_report(vectors(spark, [(0, [1.0, 0.0])])).count() == 0


def test_repeated_rows_leave_room_for_copies(spark):
    rows = [(0, [1.0, 0.1])] + [(7, [1.0, 0.0])] * 6 + [(8, [1.0, 0.0]), (9, [0.0, 1.0])] * 2
    got = sorted((r["rank"], r.vec_id) for r in ann_tree.search_report(vectors(spark, rows)).collect() if r.query_id == 0)
    assert got == [(1, 7), (2, 8), (3, 9)]
    found = ann_tree._best(np.array([7] * 6 + [8]), np.array([[1.0, 0.0]] * 7), np.array([0]), np.array([[1.0, 0.0]]), 5)
    assert found["vec_id"].tolist() == [7, 8]


def test_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = queries.QUERIES["op1_ann_tree"](spark, sf).collect()
    want = brute_neighbours([(r.vec_id, r.embedding) for r in df.collect()])
    hits = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == 5 * len(want) and np.mean([(q, i) in hits for q, v in want.items() for i, _ in v]) >= 0.9


def test_ordinal_regression_learns_an_order():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        n = int(rng.integers(0, 3))
        rows.append(np.unique([*rng.integers(100, 1000, 20), *[1] * (n > 0), *[2] * (n > 1)]))
        grades.append(n)
    off = np.r_[0, np.cumsum([len(r) for r in rows])]
    model = toxicity.Ordinal(2000).fit(np.concatenate(rows), off, np.array(grades))
    above = model.above(np.array([5, 1, 1, 2]), np.array([0, 1, 2, 4]))
    assert (np.diff(above.sum(axis=1)) > 0).all() and model.t[0] <= model.t[1] and above[2, 1] > 0.5 > above[0, 0]


def test_toxicity_on_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 3 > 0"))
    found = toxicity.grade(docs, model).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 3 = 0"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    clean = [r.said for r in rows if not r.toxic]
    english = [r.said for r in rows if r.toxic and r.lang == "en"]
    assert np.mean(clean) < 0.05 and np.mean(english) > 0.5


def test_vectors_of_any_size_have_scores(spark):
    rows = [(i, [1e200 * (i + 1), 1e200, 0.0]) for i in range(60)] + [(100 + i, [1e-200 * (i + 1), -1e-200, 1e-250]) for i in range(60)]
    got = ann_tree.search_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute_neighbours([(i, np.asarray(v) / max(map(abs, v))) for i, v in rows])
    for q, near in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert len(mine) == 5 and [s for _, _, s in mine] == pytest.approx([s for _, s in near], abs=1e-15)


def test_repeated_vectors_count_once(spark):
    rows = [(50, [1.0, 0.0])] + [(7, [1.0, 0.1])] * 400 + [(8, [1.0, 0.2]), (9, [0.0, 1.0]), (7, [1.0, 0.0])]
    got = ann_tree.search_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 7), (2, 8), (3, 9)] and all(r.recall == 1.0 for r in got)


def test_toxicity_fits_one_text_of_an_id(spark):
    docs = frame(spark, [(i, f"{'trash ' * (i % 2)}{prose(30, i)}") for i in range(60)] + [(1, "zzz other")] * 500)
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).where("doc_id > 1").collect()}
    assert got[3].toxic and not got[4].toxic and toxicity.toxicity_report(docs, labels).count() == 560


def test_toxicity_of_very_long_texts(spark):
    docs = frame(spark, [(i, f"{'trash ' * (i % 2)}{prose(30, i)}") for i in range(60)] + [(100, prose(60_000, 1)), (101, prose(60_000, 2) + " trash")])
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert got[101].severity > got[100].severity


def test_toxicity_of_odd_rows(spark):
    docs = frame(spark, [(1, "scum trash"), (2, None), (3, ""), (None, "trash"), (1, "scum trash"), (5, "!!! 12")] + [(100 + i, f"{'trash ' * (i % 2)}{prose(30, i)}") for i in range(60)])
    labels = spark.createDataFrame([(100 + i, i % 3, i % 2) for i in range(60)] + [(None, 1, 1), (1, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert got[2].severity == 0 and got[3].severity == 0 and got[5].grade == 0 and got[101].toxic and not got[100].toxic
    none = toxicity.toxicity_report(docs, labels.where("false")).collect()
    assert len(none) == 66 and not any(r.toxic for r in none)


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>{}<footer>&copy; x</footer></body></html>'


def test_main_text():
    page = PAGE.format("<article><h1>A &amp; B</h1><p>One <b>two\n three</b> caf&eacute;<p>Four<br>five<aside>side</aside></p><ul><li>six<li>seven</ul></article><div id='comments'><p>nice</p></div>")
    assert wrappers.main_text(page) == "A & B\nOne two three café\nFour\nfive\nsix\nseven"
    assert wrappers.main_text(PAGE.format("<article><p>cut off")) == "cut off"
    assert wrappers.main_text(None) == "" and wrappers.main_text("") == "" and wrappers.main_text("<p>a < b</p>") == "a < b"


def learned(pages: list[str]):
    n, wrapper = wrappers.infer(pages)
    return wrappers.rules(wrapper, n) if n >= wrappers.MIN_SHARED else None


def test_wrappers_tell_template_texts():
    pages = [PAGE.format(f"<div><p>Same on every page of this site</p><div><p>{prose(40, i)}</p>{'<p>more ' + prose(9, 90 + i) + '</p>' * (i % 2)}</div></div>") for i in range(5)]
    n, wrapper = wrappers.infer(pages)
    assert n == 5 and "#TEXT" in wrappers.expression(wrapper, n) and "Same on every page" in wrappers.expression(wrapper, n)
    assert wrappers.main_text(pages[2], learned(pages)) == prose(40, 2) + "\nmore " + prose(9, 92)


def test_expressions_have_optional_and_repeated_groups():
    pages = ["<body><h1>a</h1><p>b</p><p>c</p></body>", "<body><h1>d</h1><p>e</p><ul><li>f</li></ul></body>", "<body><h2>g</h2><p>h</p><h2>i</h2><p>j</p><ul></ul></body>"]
    n, wrapper = wrappers.infer(pages)
    shown = wrappers.expression(wrapper, n)
    assert "(<h1>#TEXT)?" in shown and "((<h2>#TEXT)*(<p>#TEXT)+)+" in shown and "(<ul>(<li>#TEXT)?)?" in shown


def test_template_lines_inside_an_article(spark):
    share, more = "<p>Share <b>this</b> story</p>", "<div class='box'><p>Read more here</p></div>"
    pages = [PAGE.format(f"<article><h1>{prose(4, i)}</h1>{share}<p>{prose(30, 40 + i)}, <i>{prose(2, i)}</i>.</p>{more if i != 1 else ''}<p>{prose(9, 70 + i)}</p></article>") for i in range(5)]
    rows = [(i, f"http://a.b/{i}", p) for i, p in enumerate(pages)] + [(9, "http://c.d/", pages[0])]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    bodies = [(prose(4, i), f"{prose(30, 40 + i)}, {prose(2, i)}.", prose(9, 70 + i)) for i in range(5)]
    assert got[1] == "\n".join(bodies[1])
    assert [got[i].replace("\nRead more here", "") for i in range(5)] == ["\n".join(b) for b in bodies] and "Read more here" in got[0]  # page 1 lacks the box
    assert "Share this story" in got[9]  # a host of one page has no wrapper
    assert all(wrappers.main_text(p) != got[i] for i, p in enumerate(pages))  # without the wrapper the line stays
    boxed = [PAGE.format(f"<article><p>{prose(20, i)}</p>{more}</article>") for i in range(4)]
    assert wrappers.main_text(boxed[2], learned(boxed)) == prose(20, 2)
    same = [PAGE.format(f"<div>{prose(25, i)}</div><article><p>The same article</p></article>") for i in range(4)]
    assert wrappers.main_text(same[0], learned(same)) == "The same article"
    copies = [PAGE.format(f"<article><h1>{prose(2, i % 2)}</h1><p>{prose(30, i % 2)}</p></article><p>{i}</p>") for i in range(8)]
    assert learned(copies) is None  # copies of two articles are two pages


def test_groups_of_the_template_without_article():
    menu = lambda i: f"<ul><li><a href='/a'>{prose(1, 7)}</a></li><li><a href='/b'>{prose(1, 900 + i)}</a></li></ul>"
    notice = lambda i: f"<div><em>{prose(6, i % 2)}</em></div>"
    pages = [f"<body><header><p>Our site</p><h1>{prose(5, 300 + i)}</h1></header>{menu(i)}<section>{notice(i)}<p>{prose(30, i)}</p><p>See <a href='/x'>{prose(2, i)}</a> too</p></section></body>" for i in range(6)]
    for i, p in enumerate(pages):
        assert wrappers.main_text(p, learned(pages)) == "\n".join((prose(5, 300 + i), prose(30, i), f"See {prose(2, i)} too"))
    assert prose(1, 7) in wrappers.main_text(pages[0])


def test_names_that_say_more_than_advert():
    keep = [f"<p class='{c}'>{prose(9, i)}</p>" for i, c in enumerate(["ad hoc topics", "search results", "comments-open entry-title", "lead", "intro-2", ""])]
    drop = [f"<div class='{c}'>{prose(9, 50 + i)}</div>" for i, c in enumerate(["ad", "ad-box top", "post-comments", "site-footer clearfix", "widget advert_large", "Comments"])] + ["<div id='comment-12'>x</div>", "<p hidden>y</p>", "<p style='display: none'>z</p>"]
    for place in ("article", "section"):
        assert wrappers.main_text(f"<body><{place}>{''.join(keep)}{''.join(drop)}</{place}></body>") == "\n".join(prose(9, i) for i in range(6))


def test_pages_without_article_keep_headline_and_unique_texts():
    page = f"<body><h1>Title</h1><div><p>{prose(60, 1)}</p><div>{prose(200, 2)}</div><p>{prose(8, 3)}</p></div><p>The end</p></body>"
    assert wrappers.main_text(page) == "\n".join(("Title", prose(60, 1), prose(200, 2), prose(8, 3), "The end"))
    extra = "<h3>Only here</h3><blockquote>Said once</blockquote>"
    pages = [f"<body><div>All pages say this</div><h1>{prose(3, i)}</h1><div><p>{prose(50, 20 + i)}</p>{extra if i == 2 else ''}</div></body>" for i in range(4)]
    assert wrappers.main_text(pages[2], learned(pages)) == "\n".join((prose(3, 2), prose(50, 22), "Only here", "Said once"))
    two = f"<article><p>{prose(200, 1)}</p></article><article><p>short</p></article>"
    assert wrappers.main_text(two) == prose(200, 1) + "\nshort"


def test_broken_and_deep_pages():
    for tag in ("div", "b", "li", "span class='x'", "article", "p"):
        for n in (1_000, 30_000):
            open_ = f"<{tag}>" * n
            assert wrappers.main_text(f"<article>{open_}deep</article>after") == ("deep\nafter" if tag == "article" else "deep")
            deep = wrappers.parse(f"<article>{open_}deep</{tag.split()[0]}>end")
            assert wrappers.infer([f"<body>{open_}{i}</body>" for i in range(3)])[0] == 3 and deep is not None
    steps = "".join(f"<div>{i}" for i in range(200)) + "".join(f"</div>{i}" for i in range(200))
    assert wrappers.main_text(steps).split() == [str(i) for i in range(200)] * 2
    assert wrappers.main_text("<div>" * 100 + "<nav>menu<div>more</div></nav>text" + "<article><p>one</p>two</article>") == "one\ntwo"
    assert wrappers.main_text("<p title=it's>don't</p><p class=\"x>a</p> <p>b") and wrappers.main_text("x <y and z > w") == "x <y and z > w".replace("<y and z >", "").replace("  ", " ")
    assert wrappers.main_text("<p>one <a two <b>three</b> </p <p>four") == "one three\nfour"
    assert wrappers.main_text("<svg><p>kept</p><title>kept") == "kept\nkept" and wrappers.main_text("a<script>b") == "a"


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a href="', "</", "</p", "<svg>", "<b><p>", "</i><b>", "<td><li>", "<x y='", "<!", "&amp;", "<article><i></b>", '<p class="a b" id=c>x'])
def test_long_broken_pages_take_linear_time(piece):
    started = time.process_time()
    wrappers.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - started < 20


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = queries.QUERIES["op5_wrappers"](spark, sf).join(pages, "page_id").collect()
    assert len(got) == pages.count()
    for r in got:
        inside = re.sub(r"<(/?)(h1|p|br)>", "\n", r.html.split("<article>")[1].split("</article>")[0])
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.sub(r"[^\S\n]+", " ", inside).split("\n"))
        assert r.n_chars == len(r.text) and "".join(r.text.split()) == "".join("".join(lines).split())
    odd = spark.createDataFrame([(1, None, None), (2, "x", ""), (None, "http://a.b/c", "<article>x</article>"), (2, "x", "")], "page_id long, url string, html string")
    assert sorted(((r.page_id, r.text) for r in wrappers.extract(odd).collect()), key=str) == [(1, ""), (2, ""), (2, ""), (None, "x")]
    assert wrappers.extract(odd.where("false")).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 500, 500], [5, 2, 1]) == [30.0, pytest.approx(980 * 2 / 3), pytest.approx(980 / 3)]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5))) == list(range(n))


def test_dealing_keeps_totals_and_shards_even():
    slots = [1000, 300, 0, 7]
    shard = mixing.dealt(np.arange(1307), 1307, per_shard=64)
    sizes = np.bincount(shard)
    assert len(sizes) == 21 and sizes.max() - sizes.min() <= 1
    counts = np.bincount(shard[:1000], minlength=21)  # of the first source: as in draws without replacement
    assert counts.std() < 3 * np.sqrt(62 * 0.77 * 0.23) and counts.std() > 0 and sum(slots) == len(shard)


def spark_hash(seed: int, doc, text) -> int:
    """xxhash64(seed, doc_id, text) as the engine has it: each value hashed with the hash before as its seed, nulls passed over."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = h if doc is None else xxhash.xxh64_intdigest(struct.pack("<q", doc), h)
    h = h if text is None else xxhash.xxh64_intdigest(text.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def replayed_mix(rows: list[tuple], block: int) -> tuple[dict, dict]:
    """Of (doc_id, text, source): words taken by (source, doc_id), and targets by source, step by step."""
    by: dict = {}
    for doc, text, source in rows:
        by.setdefault(source, []).append((doc, text))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in by[s]) for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    taken: dict = {}
    for no, (s, g) in enumerate(zip(names, goal)):
        stream, seen = [], {}
        for doc, text in by[s]:
            h, nth = spark_hash(mixing.SEED, doc, text), seen.get((doc, text), 0)
            seen[doc, text] = nth + 1
            if nth:
                other = xxhash.xxh64_intdigest(struct.pack("<q", nth), xxhash.xxh64_intdigest(struct.pack("<q", h), 42))
                h = other - (1 << 64) if other >> 63 else other
            stream.append((h, doc, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), nth))
        words = [d for _, d, n, _ in sorted(stream) for d in [d] * n]
        left, n = round(g), len(words)
        n_blocks, full = -(-n // block), n // block
        j = 0
        while left > 0:
            epoch, place = divmod(j, n_blocks)
            if place < full:
                key = (((mixing.SEED % 1_000_003) * 1_000_003 + no) * 1_000_003 + epoch) % 2**64
                place = int(mixing.permuted(np.array([place]), np.array([full]), np.array([key], np.uint64))[0])
            part = words[place * block : (place + 1) * block][:left]
            for d in part:
                taken[s, d] = taken.get((s, d), 0) + 1
            left, j = left - len(part), j + 1
    return taken, dict(zip(names, goal))


def test_mix_equals_a_replay(spark):
    rows = [(i, prose(1 + i * 7 % 90, i), ("a", "b", None)[i % 3]) for i in range(60)] + [(7, "same row", "a")] * 40
    got: dict = {}
    for r in mixing.mixing_report(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), 16).collect():
        got[r.source, r.doc_id] = got.get((r.source, r.doc_id), 0) + r.taken
    assert {k: v for k, v in got.items() if v} == replayed_mix(rows, 16)[0]


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_mix(spark, block):
    rows = [(i, prose(1 + i * 7 % 90, i), ("a", "b", None, "zz")[i % 4]) for i in range(80)] + [(200, None, "a"), (201, "", "only-empty"), (None, "x y", "b"), (0, prose(1, 0), "a"), (300, prose(5000, 3), "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size string")
    got = mixing.mixing_report(docs, block).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mixing_report(docs, block).collect()))
    by: dict = {}
    for r in got:
        assert r.taken <= 3 * r.size
        size, total, taken = by.get(r.source, (0, 0, 0))
        by[r.source] = (size + r.size, r.target, taken + r.taken)
    order = ["a", "b", "only-empty", "zz", None]
    want = mixing.targets([by[s][0] for s in order], [5, 2, 1, 5, 2])
    assert [by[s][1] for s in order] == pytest.approx(want) and all(abs(by[s][2] - t) <= 1 for s, t in zip(order, want))
    assert mixing.mixing_report(docs.where("false")).count() == 0


def test_manifest_covers_each_document_in_order(spark):
    docs = frame(spark, [(i, prose(30 + i, i)) for i in range(20)])
    rows, manifest = mixing.mix(docs, 16)
    spans = manifest.join(rows.select("row_no", "size"), "row_no")
    assert spans.where("first < 0 or first + words > size or words > 16").isEmpty()
    assert manifest.groupBy("shard", "slot", "source_no").agg(F.sum("words").alias("n")).where("n > 16").isEmpty()


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs)
    table = langid.accuracy(found, docs)
    assert np.average(table["accuracy"], weights=table["n"]) >= 0.95
    assert found.where("held_out").first().held_out == langid.held_out(found.where("held_out").first().doc_id)


def test_language_of_odd_rows(spark):
    texts = {"en": "the cat and the dog with this that", "fr": "le chat et la souris avec une dans"}
    rows = [(i, texts["en" if i % 2 else "fr"], "s", "en" if i % 2 else "fr") for i in range(40)]
    odd = [(100, None, "s", "en"), (101, "", "s", None), (102, "12 !!", "s", "en"), (103, "the the the " * 3000, "s", None), (None, "le chat", "s", "fr"), (1, texts["en"], "s", "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + odd], "doc_id long, text string, source string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 1, 2, None)] == ["und", "und", "und", "en", "en", "fr", "fr"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[100].score == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by_lang = {r.lang: r.t for r in docs.groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text")).alias("t")).collect()}
    long = [(i, text, "s", lang) for i, (lang, text) in enumerate(sorted(by_lang.items()))] + [(9, by_lang["de"] + " " + by_lang["fr"], "s", None), (10, "1 " * 40_000, "s", None)]
    rows = docs.select("doc_id", "text", "source", "lang").unionByName(spark.createDataFrame([(90_000 + 4 * i, *r) for i, *r in long], "doc_id long, text string, source string, lang string"))
    whole = {r.doc_id: r for r in langid.identify(rows).collect()}
    monkeypatch.setattr(langid, "PIECE", 3000)
    cut = {r.doc_id: r for r in langid.identify(rows).collect()}
    assert all(cut[i].lang_pred == r.lang_pred and abs(cut[i].score - r.score) < 1e-4 and abs(cut[i].mean_log - r.mean_log) < 1e-4 for i, r in whole.items())
    assert [whole[90_000 + 4 * i].lang_pred for i, _, _, lang in long[:4]] == [lang for *_, lang in long[:4]] and whole[90_040].lang_pred == "und"


def test_one_text_many_times_is_fitted_once(spark):
    rows = [(i, "der die das und", "s", "de") for i in range(300)] + [(1000 + i, prose(5, i), "s", "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    _, table = langid.fit(docs, per_language=20)
    _, once = langid.fit(docs.dropDuplicates(["text"]), per_language=20)
    assert np.allclose(table, once)


def test_mixture_finds_both_languages():
    a, b = np.array([[-1.0, -9.0]]), np.array([[-9.0, -1.0]])
    logs = np.concatenate([np.repeat(a, 30, 0), np.repeat(b, 10, 0), np.repeat(a, 40, 0)]).astype(np.float32)
    share, _, _ = langid.mixtures(logs, np.array([0, 40, 80, 80]))
    assert share[0] == pytest.approx([0.75, 0.25], abs=0.01) and share[1].tolist() == [1.0, 0.0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    a, shared = prose(40, 1), "a shared line that is long enough"
    rows = [(1, a), (2, a), (3, a + " end"), (4, prose(60, 2)), (5, None), (6, "123"), (10, f"{shared}\n{prose(20, 3)}"), (11, f"{shared}\n{prose(20, 4)}"), (12, f"{shared}\n{prose(20, 5)}")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(prose(60, 2).split()[5:25]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mix":
            assert docs.columns == frame(spark, rows).columns
    assert sorted(seen["language_id"]) == [1, 2, 3, 4, 10, 11, 12]
    assert seen["line_dedup"][10].text == prose(20, 3) and seen["line_dedup"][12].text.startswith(shared)
    assert sorted(seen["near_dedup"]) == [1, 4, 10, 11, 12] and sorted(seen["decontaminate"]) == [1, 10, 11, 12]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen["mix"].values()))


def test_the_pipeline_equals_a_replay_on_rows(spark, sf):
    """Each stage again on a list of rows, on the whole table."""
    import unicodedata

    import corpus_pipeline
    from quillstream.llm import line_dedup, minhash
    from tests.llm.test_native import brute_contamination

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r in rows if r[1] is not None and any(unicodedata.category(c)[0] == "L" for c in r[1])]
    held: dict = {}
    for doc, text, _ in rows:
        for line in text.encode().split(b"\n"):
            if len((key := line_dedup.line_key(line)).decode()) >= line_dedup.MIN_CHARS:
                held.setdefault(key, set()).add(doc)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= line_dedup.MIN_DOCUMENTS}
    kept = lambda doc, line: keeper.get(line_dedup.line_key(line.encode()), doc) == doc
    rows = [(doc, "\n".join(x for x in text.split("\n") if kept(doc, x)), source) for doc, text, source in rows]
    first = {doc for doc, n, c in minhash.brute_force([r[:2] for r in rows], 5) if doc == c or not n}
    rows = [r for r in rows if r[0] in first]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in brute_contamination([r[:2] for r in rows], items) if not r[5]}
    rows = [r for r in rows if r[0] in clean]
    taken, goal = replayed_mix(rows, mixing.BLOCK)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text))
    got = corpus_pipeline.run(spark, sf).collect()
    want = [(doc, source, sizes[source], taken.get((source, doc), 0)) for doc, _, source in rows]
    assert sorted((r.doc_id, r.source, r.source_size, r.taken) for r in got) == sorted(want) and 50 < len(want) < 200
    assert all(r.target == pytest.approx(goal[r.source]) for r in got)
