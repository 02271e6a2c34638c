"""Benchmark decontamination by winnowing, in DataFrame expressions only.

One pass reads the texts. It counts the words and cuts out the stretches of words in which every two neighbours are
neighbours somewhere in the benchmark (a bit table of the benchmark's word pairs, of fixed size, answers that; it
has false positives but no false negatives). A window shared with the benchmark lies inside such a stretch, and most
documents have none long enough, so that only the stretches' word hashes are kept, and all that follows works on them.

Winnowing: of the k-gram hashes in each sliding window of w positions the least is kept, with the windows of ten words
it stands for. With k + w - 1 = 10 each winnowing window covers ten words, so that every shared span of ten or
more words shares a kept hash. Stretches are joined with the benchmark's kept hashes; hits are extended to the ten-word
windows (96 bits) around them, joined with those of the benchmark. Items of fewer than ten words have one window of their
own length; for each such length present (at most nine) the stretches' windows of that length take part as they are.

Equal texts are worked once, under a hash of the text. The benchmark's side is broadcast only if counting it proves
that it is small; beyond that the joins shuffle and the adaptive planner splits hot hashes. The bit table has PAIR_WORDS
64-bit words at any size; a benchmark of many millions of words fills it, which costs time but changes no result.

Cases: a null text has no words, an empty one neither; such documents and items match nothing. Rows that repeat get a
result each. A very long text is one row's array of words, and linear in them. A null doc_id is kept as it is, a null
item_id is listed as an empty string. An empty benchmark leaves every document clean. Other columns are ignored by the
report and kept as they are by drop_contaminated, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import small, written

SPAN = 10
K = 5
#: 64-bit words of the bit table of word pairs; a power of two.
PAIR_WORDS = 1 << 16
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters outside words once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, faster, where no other character has a case."""
    return F.when(text.rlike(r"[^\x00-\x7F&&[\p{IsUppercase}\p{Lt}]]"), F.translate(text, AZ, az)).otherwise(F.lower(text))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _text_id() -> list[Column]:
    return [F.xxhash64("text").alias("r1"), F.hash("text").alias("r2")]


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, computed once: as a lambda's argument it isn't written out where it is used."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _window(start: str, length: str) -> str:
    """A struct (start, len, w1, w2) of the window of the array h that begins at `start`, counted from 1."""
    return f"struct(int({start}) as start, int({length}) as len, xxhash64(slice(h, {start}, {length})) as w1, hash(slice(h, {start}, {length})) as w2)"


def _runs(span: int, k: int) -> str:
    """Of the array h of word hashes: structs (fp, i, j), a kept hash and the window starts [i, j) it stands for."""
    grams = f"transform(sequence(1, size(h) - {k} + 1), i -> xxhash64(slice(h, i, {k})))"
    minima = f"transform(sequence(1, size(h) - {span} + 1), i -> array_min(slice(g, i, {span - k + 1})))"
    change = "filter(sequence(0, size(m) - 1), i -> i = 0 or m[i] != m[i - 1])"
    out = "transform(c, (i, x) -> struct(m[i] as fp, i + 1 as i, coalesce(get(c, x + 1), size(m)) + 1 as j))"
    return _let(grams, "g", _let(minima, "m", _let(change, "c", out)))


def kept_hashes(df: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """df has h, an array of word hashes; instead of it a row for each kept hash: fp, and the windows it stands for."""
    runs = F.expr(f"if(size(h) >= {span}, transform({_runs(span, k)}, r -> struct(r.fp as fp, transform(sequence(r.i, r.j - 1), i -> {_window('i', str(span))}) as windows)), null)")
    return df.withColumn("run", F.explode(runs)).select(*[c for c in df.columns if c != "h"], "run.*")


def hashed_items(benchmark: DataFrame) -> DataFrame:
    """item, h (word hashes) of the items that have words."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_array(F.col("text")).alias("words"))
    return words.where("size(words) > 0").select("item", F.expr("transform(words, w -> xxhash64(w))").alias("h"))


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """item, len, w1, w2, one row for each window of an item."""
    at = items.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(h) - {span} + 1, 1)), i -> {_window('i', f'least(size(h), {span})')})")).alias("x"))
    return at.select("item", "x.len", "x.w1", "x.w2").distinct()


#: Of the hash of a word and its next (or of a word alone): the 64-bit word of the bit table and the bit in it.
_PLACE, _BIT = f"int({{x}} & {PAIR_WORDS - 1})", "int(shiftrightunsigned({x}, 58))"


def pair_bits(benchmark: DataFrame) -> DataFrame:
    """bits: one row, an array of PAIR_WORDS longs, with a bit for each pair of neighbours and each item of a single word."""
    words = benchmark.select(word_array(F.col("text")).alias("words"))
    pairs = words.select(F.explode(F.expr("if(size(words) = 1, array(xxhash64(words[0])), transform(slice(words, 1, greatest(size(words) - 1, 0)), (w, i) -> xxhash64(w, words[i + 1])))")).alias("x"))
    filled = pairs.groupBy(F.expr(_PLACE.format(x="x")).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, {_BIT.format(x='x')}))").alias("b"))
    every = filled.sparkSession.range(PAIR_WORDS).select(F.col("id").cast("int").alias("at"))
    return every.join(filled, "at", "left").agg(F.expr("transform(array_sort(array_agg(struct(at, coalesce(b, 0L) as b))), x -> x.b)").alias("bits"))


def scan(docs: DataFrame, bits: DataFrame, least: int, singles: bool) -> DataFrame:
    """docs (with text): its other columns, r1, r2, n_words, stretches (arrays of word hashes with the place of their first word).

    least: words of the shortest window but those of one word; singles: whether there are such.
    """
    others = [c for c in docs.columns if c != "text"]
    read = docs.select(*others, *_text_id(), word_array(F.col("text")).alias("words"), bits.scalar().alias("bits"))
    held = lambda x: f"getbit(bits[{_PLACE.format(x=x)}], {_BIT.format(x=x)}) = 1"
    # the last word of each stretch: it and its next are no neighbours in the benchmark, or it has no next
    hashes = "transform(words, (w, i) -> xxhash64(w, get(words, i + 1)))"
    ends = _let(hashes, "p", f"filter(transform(p, (x, i) -> if(i < size(p) - 1 and {held('x')}, -1, i)), i -> i >= 0)")
    cut = f"filter(sequence(0, size(e) - 2), i -> e[i + 1] - e[i] >= {least})"
    out = _let(f"concat(array(-1), {ends})", "e", f"transform({cut}, i -> struct(e[i] + 1 as first, transform(slice(words, e[i] + 2, e[i + 1] - e[i]), w -> xxhash64(w)) as h))")
    if singles:
        alone = _let("transform(words, w -> xxhash64(w))", "s", f"transform(filter(transform(s, (x, i) -> if({held('x')}, i, -1)), i -> i >= 0), i -> struct(i as first, array(s[i]) as h))")
        out = f"concat({out}, {alone})"
    return read.select(*others, "r1", "r2", F.size("words").cast("long").alias("n_words"), F.expr(f"if(size(words) = 0, null, {out})").alias("stretches"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(scanned, found). scanned: docs without text, with r1, r2 (the text's hashes) and n_words. found: r1, r2, n_hit, items (sorted ids) for every contaminated text."""
    hashed = hashed_items(benchmark)
    items = written(item_windows(hashed, span))
    fps = written(kept_hashes(hashed.select("h"), span, k).select("fp").distinct())
    lengths = {r["len"] for r in items.select("len").distinct().collect()}  # at most span values
    bits = written(pair_bits(benchmark))

    scanned = written(scan(docs, bits, min(lengths - {1}, default=span), 1 in lengths))
    texts = scanned.where("size(stretches) > 0").select("r1", "r2", "stretches").dropDuplicates(["r1", "r2"])
    stretch = texts.select("r1", "r2", F.explode("stretches").alias("s")).select("r1", "r2", "s.first", "s.h")
    kept = kept_hashes(stretch, span, k).join(small(fps), "fp", "left_semi")
    window = kept.select("r1", "r2", "first", F.explode("windows").alias("x"))
    for m in sorted(lengths - {span}):
        window = window.unionByName(stretch.where(f"size(h) >= {m}").select("r1", "r2", "first", F.explode(F.expr(f"transform(sequence(1, size(h) - {m} + 1), i -> {_window('i', str(m))})")).alias("x")))
    window = window.select("r1", "r2", (F.col("first") + F.col("x.start") - 1).alias("start"), "x.len", "x.w1", "x.w2")
    hits = written(window.join(small(items.select("len", "w1", "w2").distinct()), ["len", "w1", "w2"], "left_semi").distinct())

    spans = hits.groupBy("r1", "r2").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop")))).alias("spans"))
    covered = "aggregate(spans, named_struct('n', 0, 'to', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.stop - greatest(x.start, s.to)), 'to', greatest(s.to, x.stop)), s -> s.n)"
    named = hits.select("r1", "r2", "len", "w1", "w2").distinct().join(small(items), ["len", "w1", "w2"]).groupBy("r1", "r2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return scanned.drop("stretches"), spans.select("r1", "r2", F.expr(covered).alias("n_hit")).join(named, ["r1", "r2"])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for each input row."""
    scanned, found = contamination(docs.select("doc_id", "text"), benchmark, span, k)
    joined = scanned.join(small(written(found)), ["r1", "r2"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with the benchmark, as they are."""
    _, found = contamination(docs.select("text"), benchmark)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_text_id())
    left = keyed.join(small(written(found.select("r1", "r2"))), ["r1", "r2"], "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
