"""Gap sessionisation by frontier iteration.

A client's clicks are cut where the next one comes 15 minutes later or more, or after a final click: these hard breaks need nothing but the click
before. The islands between them are cut again where a session has become an hour old, and each such cut depends on the one
before it. The islands that are long enough for a cut form the frontier: in every round each of them finds its next cut, the first
click over an hour after its last cut, by an as-of join; the cuts are stored, and the islands without another one leave with their clicks.

No client is ever in one task. Clicks are dealt by client and slot of half a day; those at a slot's edges stand in the neighbouring slot as
well, so that the click before, and all clicks of a session that begins in the slot, are at hand. A session has all its clicks in one row
by contract, so a slot's share of a client is of the order of one result row. What passes between slots is one row for each client and slot that
has sessions or late clicks (730 a year and client).

Cases: rows without click_id, client_id or ts are left out. Repeats of a click_id count once, the copy with the least hash if they differ. A null arrived_at is timely;
a null, NaN or infinite value counts 0 cents, and null and NaN aren't final. Equal times are ordered by click_id. Late clicks
before a client's first session, and clients with late clicks only, are in no row. An empty table gives no rows. props isn't read; further columns are ignored.
Times with and without a zone are taken (the latter as UTC) and compared in microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import written

MINUTE = 60_000_000
GAP, LATE, LONGEST = 15 * MINUTE, 15 * MINUTE, 60 * MINUTE
FINAL_VALUE, FINAL_KINDS = 60, ("purchase", "signup")
#: Width of a slot; more than LONGEST + GAP.
SLOT = 12 * 60 * MINUTE


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC, whatever the session's time zone is."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(name)
    span = F.col(name) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda field: F.extract(F.lit(field), span)
    return part("DAY").cast("long") * (1440 * MINUTE) + part("HOUR").cast("long") * (60 * MINUTE) + part("MINUTE").cast("long") * MINUTE + (part("SECOND") * 1_000_000).cast("long")


def distinct_clicks(clicks: DataFrame) -> DataFrame:
    """client_id, us, click_id, late, final, cents: a row for each click_id."""
    value = F.when(~F.isnan("value"), F.col("value"))
    cents = F.when(F.abs(value) < float("inf"), F.floor(100 * value + 0.5))
    rows = clicks.where("click_id is not null and client_id is not null and ts is not null").select(
        "click_id", "client_id", micros(clicks, "ts").alias("us"), micros(clicks, "arrived_at").alias("arrived"),
        F.coalesce((value >= FINAL_VALUE) & F.col("kind").isin(*FINAL_KINDS), F.lit(False)).alias("final"), F.coalesce(cents, F.lit(0)).cast("long").alias("cents"))
    rows = rows.withColumn("late", F.coalesce(F.col("arrived") - F.col("us") > LATE, F.lit(False))).drop("arrived")
    names = [c for c in rows.columns if c != "click_id"]
    pick = F.xxhash64(*names)  # one copy's columns all come from the same row, as copies of one hash are equal
    return rows.groupBy("click_id").agg(*[F.min_by(c, pick).alias(c) for c in names])


def island_pieces(timely: DataFrame) -> DataFrame:
    """timely (client_id, us, click_id, final, cents) -> a row for each piece of an island in a slot and its neighbourhood.

    break_us, break_id name the hard break that the piece begins with; they are null where the island began before the slot's own time.
    clicks holds (us, click_id, final, cents) in order, up to GAP + LONGEST after the slot's end.
    """
    slot, rest = F.floor(F.col("us") / SLOT), F.pmod(F.col("us"), F.lit(SLOT))
    near = F.array_compact(F.array(slot, F.when(rest < LONGEST + GAP, slot - 1), F.when(rest >= SLOT - GAP, slot + 1)))
    rows = timely.withColumn("slot", F.explode(near))
    order = Window.partitionBy("client_id", "slot").orderBy("us", "click_id")
    before, was_final = F.lag("us").over(order), F.lag("final").over(order)
    hard = before.isNull() | was_final | (F.col("us") - before >= GAP)
    rows = rows.withColumn("hard", hard).where(F.col("us") >= F.col("slot") * SLOT)  # the neighbours before were only needed as predecessors
    start = lambda c: F.last(F.when(F.col("hard"), F.col(c)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("break_us", start("us")).withColumn("break_id", start("click_id"))
    pieces = rows.groupBy("client_id", "slot", "break_us", "break_id").agg(F.array_sort(F.collect_list(F.struct("us", "click_id", "final", "cents"))).alias("clicks"))
    own = F.coalesce(F.col("break_us"), F.col("clicks")[0]["us"])  # a piece that begins after the slot's end is the neighbour's
    return pieces.where(own < (F.col("slot") + 1) * SLOT)


def _session(start_us: Column, start_id: Column, clicks: Column, cut: Column) -> list[Column]:
    last = F.element_at(clicks, -1)
    ids = F.transform(clicks, lambda x: x["click_id"].cast("string"))
    return [
        F.col("client_id"), start_us.alias("start_us"), start_id.alias("session_id"), last["us"].alias("end_us"), F.size(clicks).cast("long").alias("n_clicks"),
        F.aggregate(clicks, F.lit(0).cast("long"), lambda s, x: s + x["cents"]).alias("value_cents"), F.sha2(F.array_join(ids, ","), 256).alias("path_sha256"), last["final"].alias("final"), cut.alias("cut"),
    ]


def length_cuts(clicks: DataFrame, frontier: DataFrame) -> DataFrame:
    """The frontier iteration: clicks (piece columns, us, click_id, own_slot, own_us, own_id), frontier (piece columns, at) -> the cuts (piece columns, at, click_id).

    Piece columns are client_id, slot, break_us, break_id. A click also stands in the piece of the slot before it, where own_* name the piece of its own slot.
    """
    piece = ["client_id", "slot", "break_us", "break_id"]
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in piece]
    cuts = None
    held = n = frontier.count()
    while n:
        after = clicks.alias("c").join(frontier.hint("merge").alias("f"), [*same("c", "f"), F.col("c.us") > F.col("f.at") + LONGEST]).select("c.*")
        first = after.groupBy(*piece).agg(F.min(F.struct("us", "click_id", "own_slot", "own_us", "own_id")).alias("x"))
        frontier = written(first.select("client_id", F.col("x.own_slot").alias("slot"), F.col("x.own_us").alias("break_us"), F.col("x.own_id").alias("break_id"), F.col("x.us").alias("at"), F.col("x.click_id").alias("click_id")))
        cuts = frontier if cuts is None else cuts.unionByName(frontier)
        n = frontier.count()
        if n and 2 * n <= held:  # half of the islands have left, so their clicks go as well
            held, least = n, frontier.agg(F.min("slot")).first()[0]
            going = clicks.alias("c").join(frontier.select(*piece).hint("merge").alias("f"), same("c", "f"), "left_semi")
            later = clicks.where(F.col("break_us").isNull() & (F.col("slot") > least))
            clicks = written(going.where(~(F.col("break_us").isNull() & (F.col("slot") > least))).unionByName(later))
    return cuts if cuts is not None else frontier.withColumn("click_id", F.lit(None).cast("long"))


def _sessions(timely: DataFrame) -> DataFrame:
    """client_id, start_us, session_id, end_us, n_clicks, value_cents, path_sha256, final, cut (whether a length cut begins it)."""
    piece = ["client_id", "slot", "break_us", "break_id"]
    pieces = island_pieces(timely)
    last_us = F.element_at("clicks", -1)["us"]
    long = F.col("break_us").isNull() | (last_us - F.col("break_us") > LONGEST)
    digest = _session(F.col("break_us"), F.col("break_id"), F.col("clicks"), F.lit(False))
    # short islands are sessions as they are; only pieces that a cut may be in keep their clicks
    stored = written(pieces.select(*digest, "slot", "break_us", "break_id", F.when(long, F.col("clicks")).alias("clicks")))
    short = stored.where("clicks is null").drop("slot", "break_us", "break_id", "clicks")
    begun, own = F.col("break_us") >= F.col("own_slot") * SLOT, F.floor(F.col("x.us") / SLOT)
    clicks = stored.where("clicks is not null").select(*piece, F.explode("clicks").alias("x")).withColumn("own_slot", own)
    clicks = written(clicks.select(*piece, "x.*", "own_slot", F.when(begun, F.col("break_us")).alias("own_us"), F.when(begun, F.col("break_id")).alias("own_id")))
    islands = written(stored.where("clicks is not null and break_us is not null").select(*piece, F.col("break_us").alias("at"), F.col("break_id").alias("click_id")))
    cuts = length_cuts(clicks.drop("final", "cents"), islands.drop("click_id"))
    starts = islands.withColumn("cut", F.lit(False)).unionByName(cuts.withColumn("cut", F.lit(True)))
    on = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in piece]
    within = (F.col("c.us") <= F.col("s.at") + LONGEST) & (F.struct("c.us", "c.click_id") >= F.struct(F.col("s.at"), F.col("s.click_id")))
    # the starts of an island are over LONGEST apart, so that a click has at most one
    taken = clicks.alias("c").join(starts.hint("merge").alias("s"), [*on, within]).select("c.client_id", "s.at", F.col("s.click_id").alias("start_id"), "s.cut", F.struct("c.us", "c.click_id", "c.final", "c.cents").alias("x"))
    lists = taken.groupBy("client_id", "at", "start_id", "cut").agg(F.array_sort(F.collect_list("x")).alias("clicks"))
    return short.unionByName(lists.select(*_session(F.col("at"), F.col("start_id"), F.col("clicks"), F.col("cut"))))


def sessionise(clicks: DataFrame) -> DataFrame:
    """clicks (click_id, ts, arrived_at, client_id, kind, value) -> the sessions, see the module."""
    rows = written(distinct_clicks(clicks))
    found = _sessions(rows.where("not late").drop("late"))
    found = found.withColumn("us", F.col("start_us")).withColumn("id", F.col("session_id"))
    late = rows.where("late").select("client_id", "us", F.col("click_id").alias("id"))
    both = found.unionByName(late, allowMissingColumns=True).withColumn("slot", F.floor(F.col("us") / SLOT))
    # a late click goes to the last session that began at its time or before: in its slot, or carried over from an earlier slot
    place = Window.partitionBy("client_id", "slot").orderBy("us", F.col("session_id").isNull(), "id")
    whole = Window.partitionBy("client_id", "slot")
    is_late = F.when(F.col("session_id").isNull(), 1).otherwise(0).cast("long")
    both = both.withColumn("passed", F.sum(is_late).over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all_late", F.sum(is_late).over(whole))
    starts = both.withColumn("nth", F.sum(1 - is_late).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    # a slot's rows: its sessions, or one late click for all where there is no session
    starts = starts.where("session_id is not null or (nth = 0 and passed = 1)").withColumn("n_starts", F.sum(F.when(F.col("session_id").isNotNull(), 1).otherwise(0)).over(whole))
    starts = starts.withColumn("next_passed", F.lead("passed").over(place)).withColumn("next_cut", F.lead("cut").over(place)).where("session_id is not null or n_starts = 0")
    starts = written(starts)
    # one row for each client and slot: late clicks before its first session, whether there is one, and how it began
    slots = starts.groupBy("client_id", "slot").agg(F.min(F.when(F.col("session_id").isNotNull(), F.col("passed"))).alias("first"), F.max("all_late").alias("all_late"), F.min_by("cut", F.struct("us", "id")).alias("begins_cut"), F.max("n_starts").alias("n_starts"))
    slots = slots.withColumn("before", F.coalesce("first", "all_late"))
    later = Window.partitionBy("client_id").orderBy("slot")
    # late clicks from here on to the first session of a later slot: running sums, read at the next slot with a session
    slots = slots.withColumn("sum", F.sum("before").over(later.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("before").over(Window.partitionBy("client_id")))
    ahead = Window.partitionBy("client_id").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda c: F.last(F.when(F.col("n_starts") > 0, c), ignorenulls=True).over(ahead)
    slots = slots.withColumn("next_sum", F.coalesce(nearest(F.col("sum")), F.col("total"))).withColumn("next_cut", nearest(F.coalesce("begins_cut", F.lit(False))))
    slots = slots.where("n_starts > 0").select("client_id", "slot", (F.col("next_sum") - F.col("sum")).alias("carried"), F.col("next_cut").alias("cut_after"))
    out = starts.where("session_id is not null").alias("s").join(slots.hint("merge").alias("k"), ["client_id", "slot"])
    last = F.col("next_passed").isNull()  # of the slot
    n_late = F.when(last, F.col("all_late") - F.col("passed") + F.col("carried")).otherwise(F.col("next_passed") - F.col("passed"))
    cut = F.when(last, F.col("cut_after")).otherwise(F.col("next_cut"))
    closed = F.when(F.col("final"), "end").when(cut.isNull(), "none").when(cut, "length").otherwise("gap")
    return out.select("client_id", "session_id", "start_us", "end_us", "n_clicks", n_late.alias("n_late"), "value_cents", closed.alias("closed_by"), "path_sha256")
