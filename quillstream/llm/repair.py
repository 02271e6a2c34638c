"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

The rows of a conversation and the states of that pattern span a graph: node (i, q) says that i rows are done and the roles given so far
have led to state q. Keep, Rerole and Delete lead to i + 1, Insert stays at i. Minimum costs from the start (forward) and to the end
(backward) show which arcs are tight, that is on some cheapest path: forward + cost + backward is the optimum. The edits of least
letters are read off by the set of nodes that the letters chosen so far lead to by tight arcs: at each step the least letter that leaves the
set is taken, and all its arcs are followed.

A conversation's rows go to one task in order, as its result is one row with a hash of all its text; conversations pass through a
task one after the other, so that memory holds one of them (per node four costs in each direction).

Cases: null conv_id, turn, role or text count as one space where they are read as text; a null conv_id is a conversation of its own. Rows of one turn
come in order of role and text as they were. Empty texts are blank; an empty role has no initial and can't be kept. A conversation
whose rows are all dropped gives zeros, an empty audit and the hash of the empty string. Very long texts are only hashed. Repeated rows are duplicates.
An empty table gives no rows; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = (START, ASSISTANT)
#: State after a role's initial, by state; -1: not allowed.
STEP = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
NONE = (-1, -1, -1, -1)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
NAME = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of `conv_id:turn` picks, with `gone` on rows that it drops, and role and text as they were."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("was_role"), text("text").alias("was_text"), fault.alias("fault"))
    rows = rows.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("was_role")))
    rows = rows.withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("was_text", ".!?", "")).otherwise(F.col("was_text")))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("fault") == 0).alias("gone"), "was_role", "was_text", "copy")


def _arcs(role: str, fault: str) -> list[tuple[str, int, tuple[int, ...]]]:
    """What can be done with a row: letter, cost, state after it by state; R stands twice, to user and to assistant."""
    arcs = [("D", DELETE, (0, 1, 2, 3))]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        arcs.append(("K", KEEP + more, STEP.get(role[:1], NONE)))
        arcs += [("R", REROLE + more, STEP[x]) for x in "ua"]
    return arcs


_INSERTS = [("I", INSERT, STEP[x]) for x in "ua"]


def _inserted(costs: list[int]) -> list[int]:
    """Forward costs with insertions at the same row: to user, to assistant, and to user after it."""
    c = list(costs)
    c[USER] = min(c[USER], min(c[START], c[SYSTEM], c[ASSISTANT]) + INSERT)
    c[ASSISTANT] = min(c[ASSISTANT], c[USER] + INSERT)
    return c


def _before_inserted(costs: list[int]) -> list[int]:
    """Backward costs with insertions at the same row."""
    c = list(costs)
    c[USER] = min(c[USER], c[ASSISTANT] + INSERT)
    for q in (START, SYSTEM, ASSISTANT):
        c[q] = min(c[q], c[USER] + INSERT)
    c[USER] = min(c[USER], c[ASSISTANT] + INSERT)
    return c


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """rows of (role, fault) -> the least cost and the ASCII-least of the cheapest edits."""
    arcs = [_arcs(*r) for r in rows]
    n = len(rows)
    forward = [_inserted([0, INF, INF, INF])]
    for i in range(n):
        after = [INF] * 4
        for _, cost, to in arcs[i]:
            for q, p in enumerate(to):
                if p >= 0 and forward[i][q] + cost < after[p]:
                    after[p] = forward[i][q] + cost
        forward.append(_inserted(after))
    backward = [_before_inserted([0 if q in ACCEPT else INF for q in range(4)])]
    for i in range(n - 1, -1, -1):
        here = [min((cost + backward[-1][to[q]] for _, cost, to in arcs[i] if to[q] >= 0), default=INF) for q in range(4)]
        backward.append(_before_inserted(here))
    backward.reverse()
    best = backward[0][START]
    audit: list[str] = []
    i, nodes = 0, {START}
    while True:
        leaves: dict[str, set[int]] = {}
        for letter, cost, to in (*(arcs[i] if i < n else ()), *_INSERTS):
            ahead = backward[i if letter == "I" else i + 1]
            for q in nodes:
                if to[q] >= 0 and forward[i][q] + cost + ahead[to[q]] == best:
                    leaves.setdefault(letter, set()).add(to[q])
        if not leaves:
            return best, "".join(audit)
        letter = min(leaves)
        audit.append(letter)
        nodes, i = leaves[letter], i + (letter != "I")


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) rows that the edits give."""
    out: list[tuple[str, str]] = []
    state, i = START, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role = NAME["a" if state == USER else "u"]
        text = ""
        if letter != "I":
            role, text = (rows[i][0] if letter == "K" else role), rows[i][1]
            i += 1
        state = STEP[role[:1]][state]
        out.append((role, text))
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each row: blank, duplicate, truncated or none."""
    seen: set[tuple[str, bytes]] = set()
    out = []
    for role, text in rows:
        key = (role, hashlib.sha256(text.encode()).digest())
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if key in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add(key)
    return out


def report(conv_id: int | None, turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The result row of a conversation."""
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    found = faults(rows)
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest([(role, fault) for (role, _), fault in zip(rows, found)])
    text = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in repaired(rows, audit)).encode()).hexdigest()
    return conv_id, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, text


def repair(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text), damaged and then repaired: one row for each conversation."""
    order = ["conv_id", F.asc_nulls_first("turn"), "was_role", "was_text", "copy"]
    rows = damaged(conversations).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]

        def packed(done: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names)

        now: tuple | None = None
        turns: list[int | None] = []
        held: list[tuple[str, str]] = []
        for batch in batches:
            done: list[tuple] = []
            for a in range(0, batch.num_rows, 1024):  # bounds the texts that are Python objects at once
                for conv_id, turn, role, text, gone in zip(*(batch.column(i).slice(a, 1024).to_pylist() for i in range(5))):
                    if now != (conv_id,):
                        if now is not None:
                            done.append(report(now[0], turns, held))
                        now, turns, held = (conv_id,), [], []
                    if not gone:
                        turns.append(turn)
                        held.append((role, text))
            if done:
                yield packed(done)
        if now is not None:
            yield packed([report(now[0], turns, held)])

    return rows.mapInArrow(run, SCHEMA)
