"""Quotation linking: conversations ordered by replies, without the quotes, in DataFrame expressions only.

A message's lines are read with their quote level: the number of leading > marks, and one more for all that stands below a line like
"----- Original Message -----". Quoted passages (runs of lines of one level) are normalised (marks off, A-Z lower-cased,
white space squeezed, blank lines out) and hashed, and so are the own texts of all messages of the conversation: whole, by runs between
quotes, by paragraphs and by lines. A quoted passage is joined to the latest earlier message with a text of its hash; a
passage without one by its paragraphs, and those by their lines. A message
replies to the message that holds most characters of its level-one passages (ties: the latest); deeper levels link
to their own originals. Replies are followed to the root by pointer doubling, written to the shared folder each
round, which takes the logarithm of the longest chain in rounds.

The latest earlier message is looked up without listing matches: askers and holders of a hash stand in one list by turn, in which the last
holder is carried on, inside spans of SPAN turns and then over the spans. The work is linear in the lines, also where every turn of a
conversation with a third of all messages quotes one line. Conversations without any quote take no part in this.

Result: one row for each message: conv_id, turn, role, text (own lines, without quotes and the line that introduces
them), parent_turn (null for messages that reply to none), root_turn, depth, n_quoted (quoted lines), n_linked
(quoted lines with an original), place (from 1: the conversation in reading order, thread by thread (root_turn), by turn inside; null without conv_id).

Cases: a null text has no lines and stays null, an empty one stays empty. Messages with a null conv_id or turn link with nothing.
Repeated rows (same conv_id and turn) stay, in the order of role and text; the first text by code point speaks for them. Quotes without an original are taken out
and counted. Blank quoted lines are not linked. Very long messages are rows of lines. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import shuffle_partitions, small, written

#: Up to the last mark and a blank; single characters only, as Java's matcher recurses once for each turn of a group loop.
MARKS = r"^[ \t>]*>[ \t]?"
# fixed values: lines that introduce a quote, that divide a reply from the message below it, and that head such a message
INTRO = r"^(?:On .{1,200} wrote:|Am .{1,200} schrieb.{0,120}:|Le .{1,200} a écrit ?:|El .{1,200} escribió:)[ \t]*$"
DIVIDER = r"(?m)^[ \t]*-{2,}[ ]*(?:Original Message|Ursprüngliche Nachricht|Message d'origine|Mensaje original)[ ]*-{2,}[ \t]*$"
HEADER = r"^(?:From|Sent|To|Cc|Subject|Date|Von|Gesendet|An|Betreff|Datum|De|Envoyé|À|Objet|Enviado|Para|Asunto|Fecha) ?: .*$"
LINE_END = r"\r\n|\n|\r"
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Turns of a conversation that are looked up together.
SPAN = 1024
PARTITION_ROWS = 1_000_000


def quotes(text: Column) -> Column:
    return text.rlike(r"(?m)^[ \t]*>") | text.rlike(DIVIDER)


def lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, part, pos, level, norm of every line; norm is empty for lines that are no text of anybody."""
    parts = messages.select("conv_id", "turn", F.posexplode(F.split("text", DIVIDER)).alias("part", "body"))
    split = parts.select("conv_id", "turn", "part", F.posexplode(F.split("body", LINE_END)).alias("pos", "raw"))
    marks = F.length(F.regexp_replace(F.regexp_extract("raw", MARKS, 0), "[^>]", ""))
    line = F.regexp_replace("raw", MARKS, "")
    norm = F.trim(F.regexp_replace(F.translate(line, AZ, az), r"[\x20\x09-\x0D]+", " "))
    here = Window.partitionBy("conv_id", "turn").orderBy("part", "pos")
    rows = split.select("conv_id", "turn", "part", "pos", (marks + F.col("part")).alias("level"), line.alias("line"), norm.alias("norm")).withColumn("next", F.lead("level").over(here))
    nobody = F.col("line").rlike(INTRO) & (F.col("next") > F.col("level")) | (F.col("part") > 0) & F.col("line").rlike(HEADER)
    return rows.select("conv_id", "turn", "part", "pos", "level", F.when(nobody, "").otherwise(F.col("norm")).alias("norm"))


def _latest(asked: DataFrame, own: DataFrame) -> DataFrame:
    """asked (conv_id, hash, turn), distinct -> with original, the largest smaller turn that own (conv_id, hash, turn) holds; null if none."""
    span = F.floor(F.col("turn") / SPAN)
    both = asked.select("conv_id", "hash", "turn", F.lit(True).alias("asks"), F.lit(None).cast("long").alias("held")).unionByName(own.select("conv_id", "hash", "turn", F.lit(False).alias("asks"), F.col("turn").alias("held")))
    both = both.withColumn("span", span)
    inside = Window.partitionBy("conv_id", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("held").over(inside)).where("asks").select("conv_id", "hash", "turn", "span", "near")
    spans = both.groupBy("conv_id", "hash", "span").agg(F.max("held").alias("held"))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    far = spans.withColumn("far", F.max("held").over(earlier)).select("conv_id", "hash", "span", "far")
    return near.join(far, ["conv_id", "hash", "span"]).select("conv_id", "hash", "turn", F.coalesce("near", "far").alias("original"))


def _unit(rows: DataFrame, *by: str) -> DataFrame:
    """by.., hash, size: the normalised lines of each group as one text (bounded by a message)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "norm"))), lambda x: x["norm"]), "\n")
    return rows.groupBy(*by).agg(text.alias("unit")).select(*by, F.xxhash64("unit", F.length("unit")).alias("hash"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, run, part, pos, size, original (turn; null if none): a row for each quoted line that isn't blank; run numbers the message's passages."""
    one = messages.where("conv_id is not null and turn is not null and text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    talks = one.where(quotes(F.col("text"))).select("conv_id").distinct()
    every = lines(one.join(small(written(talks)), "conv_id", "left_semi"))
    here = Window.partitionBy("conv_id", "turn").orderBy("part", "pos")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    new_run = F.coalesce(F.lag("level").over(here) != F.col("level"), F.lit(True))
    every = every.withColumn("opens", new_run).withColumn("run", F.sum(F.col("opens").cast("int")).over(upto))
    every = every.withColumn("paragraph", F.sum((F.col("opens") | (F.col("norm") == "")).cast("int")).over(upto))
    every = written(every.where("norm != ''").drop("opens"))

    own, quoted = every.where("level = 0"), every.where("level > 0")
    line = lambda rows: rows.select("conv_id", "turn", "part", "pos", F.xxhash64("norm", F.length("norm")).alias("hash"))
    held = [_unit(own, "conv_id", "turn"), _unit(own, "conv_id", "turn", "run"), _unit(own, "conv_id", "turn", "paragraph"), line(own)]
    asks = [_unit(quoted, "conv_id", "turn", "run"), _unit(quoted, "conv_id", "turn", "paragraph"), line(quoted)]
    together = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(together(frames[1:]))
    key = ("conv_id", "hash", "turn")
    asked = [written(a) for a in asks]
    found = written(_latest(together([a.select(*key) for a in asked]).distinct(), together([h.select(*key) for h in held]).distinct()).where("original is not null"))
    out = quoted.select("conv_id", "turn", "level", "run", "paragraph", "part", "pos", F.length("norm").alias("size"))
    for rows, by, name in zip(asked, (["run"], ["paragraph"], ["part", "pos"]), ("o_run", "o_paragraph", "o_line")):
        hit = rows.join(found, list(key)).select("conv_id", "turn", *by, F.col("original").alias(name))
        out = out.join(hit, ["conv_id", "turn", *by], "left")
    return out.select("conv_id", "turn", "level", "run", "part", "pos", "size", F.coalesce("o_run", "o_paragraph", "o_line").alias("original"))


def own_text(text: Column) -> Column:
    """The message without quotes, the lines that introduce them and all below a divider."""
    above = F.split(text, DIVIDER, 2)
    rest = F.when(F.size(above) > 1, F.regexp_replace(above[0], r"[\r\n]+\z", "")).otherwise(above[0])
    rows = F.split(rest, LINE_END)
    next_ = F.concat(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.array(F.lit("")))
    quoted = lambda x: x.rlike(r"^[ \t]*>")
    pairs = F.arrays_zip(rows.alias("x"), next_.alias("next"))
    kept = F.filter(pairs, lambda s: ~quoted(s["x"]) & ~(s["x"].rlike(INTRO) & quoted(s["next"])))
    return F.when(quotes(text), F.array_join(F.transform(kept, lambda s: s["x"]), "\n")).otherwise(text)


def _placed(rows: DataFrame) -> DataFrame:
    """rows with place, from 1 in each conversation by root_turn and turn: range partitions, their counts, then numbers inside a partition."""
    order = [F.col(c).asc_nulls_first() for c in ("root_turn", "turn", "role", "text")]
    parts = max(shuffle_partitions(rows.sparkSession), -(-rows.count() // PARTITION_ROWS))
    ranged = written(rows.repartitionByRange(parts, F.col("conv_id"), *order).withColumn("piece", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), before.alias("before")))
    inside = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy(*order))
    numbered = ranged.withColumn("nth", inside).join(small(starts), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
    return numbered.withColumn("place", F.when(F.col("conv_id").isNotNull(), F.col("before") + F.col("nth"))).drop("nth", "c", "p", "before", "piece")


def conversations(messages: DataFrame) -> DataFrame:
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    linked = written(links(rows))
    votes = linked.where("level = 1 and original is not null").groupBy("conv_id", "turn", "original").agg(F.sum("size").alias("size"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("size", "original")).alias("best")).select("conv_id", "turn", F.col("best.original").alias("parent_turn"))
    counted = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quoted"), F.count("original").alias("n_linked"))
    # pointer doubling: up leads `hops` replies up; a root has no row
    up = written(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("hops")))
    while True:
        step = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        joined = up.join(step, ["conv_id", "up"], "left")
        if joined.where("up2 is not null").isEmpty():
            break
        up = written(joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops")))
    facts = parents.join(up, ["conv_id", "turn"]).join(counted, ["conv_id", "turn"], "right")
    out = rows.join(facts, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id", "turn", "role", own_text(F.col("text")).alias("text"), "parent_turn", F.coalesce("up", "turn").alias("root_turn"), F.coalesce("hops", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    return _placed(out)
