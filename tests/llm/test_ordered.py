"""Sessions, conversation repair and exact search against plain Python on rows."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import math
import random
import zlib

import pytest

from quillstream.llm import maxscore, repair, sessions

# ---------------------------------------------------------------- sessions

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, slot string, us int"
NOON = dt.datetime(2024, 1, 31, 11, 40)


def _clicks(rows):
    """(click_id, minutes, late minutes, client, kind, value)"""
    return [(i, None if m is None else NOON + dt.timedelta(minutes=m), None if late is None or m is None else NOON + dt.timedelta(minutes=m + late), c, kind, v, "{}", "x", 1) for i, m, late, c, kind, v in rows]


def _plain_sessions(rows):
    us = lambda t: round((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    clicks = {}
    for i, ts, arrived, client, kind, value, *_ in rows:
        if None not in (i, ts, client):
            clicks[i] = (client, us(ts), i, arrived is not None and us(arrived) - us(ts) > 900_000_000, kind in ("purchase", "signup") and value is not None and value >= 60, 0 if value is None or math.isnan(value) else math.floor(100 * value + 0.5))
    out = []
    for client in {c[0] for c in clicks.values()}:
        mine = sorted(c for c in clicks.values() if c[0] == client)
        timely, late, found = [c for c in mine if not c[3]], [c for c in mine if c[3]], []
        for c in timely:
            why = "first"
            if found:
                s = found[-1]
                last = s["clicks"][-1]
                why = "end" if last[4] else "gap" if c[1] - last[1] >= 900_000_000 else "length" if c[1] - s["clicks"][0][1] > 3_600_000_000 else ""
                if why:
                    s["closed"] = why
            if why:
                found.append({"clicks": [], "closed": ""})
            found[-1]["clicks"].append(c)
        for s, after in itertools.zip_longest(found, found[1:]):
            a, z = s["clicks"][0], s["clicks"][-1]
            n_late = sum(a[1] <= x[1] and (after is None or x[1] < after["clicks"][0][1]) for x in late)
            path = hashlib.sha256(",".join(str(x[2]) for x in s["clicks"]).encode()).hexdigest()
            out.append((client, a[2], a[1], z[1], len(s["clicks"]), n_late, sum(x[5] for x in s["clicks"]), s["closed"] or ("end" if z[4] else "none"), path))
    return sorted(out)


def _random_clicks(seed: int, n: int, step: float) -> list[tuple]:
    rng, at, rows = random.Random(seed), [0.0] * 4, []
    for i in range(n):
        c = rng.randrange(4)
        at[c] += rng.choice((0, step, step, step, 2 * step, 15 if rng.random() < 0.2 else step))
        rows.append((i, at[c], rng.choice((0, 1, 15, 15.1, 40)) if rng.random() < 0.2 else 0, c, rng.choice(("view", "purchase", "signup", None)), rng.choice((None, 59.994, 60.0, -3.335, 7.0)) if rng.random() < 0.3 else 1.005))
    return rows


@pytest.mark.parametrize("seed,n,step", [(1, 300, 4.0), (2, 400, 14.9), (3, 200, 20.0), (4, 500, 0.5)])
def test_sessions_equal_a_plain_pass(spark, seed, n, step):
    rows = _clicks(_random_clicks(seed, n, step))
    got = sorted(map(tuple, sessions.sessionise(spark.createDataFrame(rows + rows[:7], CLICKS)).select("client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256").collect()))
    assert got == _plain_sessions(rows)


def test_long_islands_are_cut_over_slots_and_rounds(spark):
    """Three days without a pause, an hour to the microsecond, and a client that ends in another's slot."""
    rows = _clicks([(i, 14.0 * i, 0, 1, "view", 1.0) for i in range(300)] + [(1000 + i, 60.0 * i / 4, 0, 2, "view", 1.0) for i in range(5)] + [(2000 + i, 12.0 * i, 0, 3, "view", 1.0) for i in range(6)])
    got = sessions.sessionise(spark.createDataFrame(rows, CLICKS))
    assert sorted(map(tuple, got.collect())) == _plain_sessions(rows)
    assert got.where("closed_by = 'length'").count() > 50


def test_session_cases(spark):
    rows = _clicks([(1, 0, 20, 5, "view", 1.0), (2, 1, 0, 6, "view", float("nan")), (3, 1, 0, 6, "signup", 60.0), (4, 1, 0, 6, "view", None), (5, 3000, 99, 6, "view", 1.0), (6, 9000, 0, 6, None, 1.0), (7, None, 0, 6, "view", 1.0), (8, 5, None, None, "view", 1.0), (None, 5, 0, 6, "view", 1.0), (9, -5, 16, 6, "view", 1.0), (10, 2, None, 6, "view", 1.0)])
    got = sessions.sessionise(spark.createDataFrame(rows, CLICKS))
    assert sorted(map(tuple, got.collect())) == _plain_sessions(rows)  # late clicks before the first session and clients with late ones only are in no row
    assert sessions.sessionise(spark.createDataFrame([], CLICKS)).count() == 0
    zoned = spark.createDataFrame(rows, CLICKS.replace("timestamp_ntz", "timestamp"))  # the tests' session is in UTC
    assert sorted(map(tuple, sessions.sessionise(zoned).collect())) == _plain_sessions(rows)


# ---------------------------------------------------------------- repair


def _every_edit(rows):
    """All edits with at most two insertions at a place, the cheapest and ASCII-least."""
    found = repair.faults(rows)
    best = None

    def walk(i, state, cost, audit):
        nonlocal best
        if best is not None and (cost, audit) > best and cost >= best[0] and i < len(rows):
            if cost > best[0]:
                return
        if i == len(rows) and state in ("", "a") and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if not audit.endswith("II"):
            for to in ("u", "a"):
                if to == "u" and state in ("", "s", "a") or to == "a" and state == "u":
                    walk(i, to, cost + 5, audit + "I")
        if i == len(rows):
            return
        walk(i + 1, state, cost + 2, audit + "D")
        if found[i] in ("blank", "duplicate"):
            return
        more = 5 if found[i] == "truncated" else 0
        initial = rows[i][0][:1]
        if initial == "s" and state == "" or initial == "u" and state in ("", "s", "a") or initial == "a" and state == "u":
            walk(i + 1, initial, cost + more, audit + "K")
        to = "a" if state == "u" else "u"
        walk(i + 1, to, cost + more + 1, audit + "R")

    walk(0, "", 0, "")
    return best


def test_cheapest_edits_equal_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(("user", "assistant", "system", "user", "assistant", "tool", "")), rng.choice(("Yes.", "No!", "cut", " ", "Why? ", "a."))) for _ in range(rng.randrange(5))]
        assert repair.cheapest([(r, f) for (r, _), f in zip(rows, repair.faults(rows))]) == _every_edit(rows), rows


def _plain_repair(rows):
    """conv_id -> the result of damage and repair, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ")):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        plain = [(r, t) for _, r, t in kept]
        cost, audit = _every_edit(plain)
        new, left, state = [], iter(plain), ""
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(left)
            if letter != "D":
                state = role[:1] if letter == "K" else "a" if state == "u" else "u"
                new.append((role if letter == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        f, turns = repair.faults(plain), [t for t, _, _ in kept if t is not None]
        illegal = sum((a[0][:1], b[0][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(plain, plain[1:]))
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(new).encode()).hexdigest())
    return out


def test_repair_of_rows(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(("user", "assistant", "system", "assistant", "user")), rng.choice(("Yes.", "No!", "cut", " \t", "What? ")) + str(rng.randrange(4)) * rng.randrange(2)) for c in range(40) for t in range(rng.randrange(1, 5))]
    rows += [(None, 1, "user", "A."), (None, None, "assistant", "B."), (70, None, None, None), (71, 1, "tool", "x" * 2_000_000 + "."), (72, 5, "user", "A."), (72, 5, "user", "A."), (72, 5, "assistant", "A."), (73, 1, "", "A."), (74, -3, "user", "é."), (74, 9, "assistant", "ü!\x0b")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, `a.b` string, gone int")
    assert {r["conv_id"]: tuple(r) for r in repair.repair(frame).collect()} == _plain_repair(rows)
    assert repair.repair(frame.where("false")).count() == 0


def test_conversation_without_rows_after_damage(spark):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = repair.repair(spark.createDataFrame([(*gone, "user", "A.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in found] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ---------------------------------------------------------------- exact search


def _plain_search(docs, queries, k):
    out = []
    for q, terms in queries.items():
        scores = sorted((-sum(w * d.get(t, 0) for t, w in terms.items()), i) for i, d in docs.items() if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sparse", [True, False])
def test_maxscore_equals_all_pairs(spark, monkeypatch, sparse):
    monkeypatch.setattr(maxscore, "SHARD", 64)
    monkeypatch.setattr(maxscore, "BLOCK", 16)
    rng = random.Random(5)
    docs = {i: {t: rng.choice((-3, -1, 1, 2, 9 if t % 7 == 0 else 4)) for t in range(30) if not sparse or rng.random() < 0.15} for i in range(400)}
    docs |= {400 + i: docs[3] for i in range(20)} | {450: {}}
    row = lambda i, d: (i, list(d), list(d.values()))
    frame = spark.createDataFrame([row(i, d) for i, d in docs.items()], "vec_id long, terms array<long>, weights array<long>")
    asked = {i: docs[i] for i in range(0, 420, 9)} | {9999: {1: 5, 77: 3}}
    queries = spark.createDataFrame([row(i, d) for i, d in asked.items()], "query_id long, terms array<long>, weights array<long>")
    assert sorted(map(tuple, maxscore.search(frame, queries, 7).collect())) == _plain_search(docs, asked, 7)


def test_maxscore_probes_few_postings():
    import numpy as np

    n = 1000
    rows = [{0: 100 if i < 5 else 1, **{t: 1 for t in range(1, 40)}} for i in range(n)]
    shard = maxscore.Postings(np.arange(n), np.array([len(r) for r in rows]), np.array([t for r in rows for t in r]), np.array([w for r in rows for w in r.values()]))
    seen = []
    added = shard.added
    shard.added = lambda t, live: seen.append(n if live is None else len(live)) or added(t, live)
    places, _ = shard.best(-1, np.arange(40), np.full(40, 2), 5)
    assert sorted(places) == [0, 1, 2, 3, 4] and sum(seen) < 5 * n  # after the first terms only the five that compete are probed


def test_maxscore_cases(spark):
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (50, [0.0, 0.0]), (1, [0.5, float("nan")]), (2, None), (3, [0.5, None]), (4, [float("inf"), 1.0]), (5, []), (6, [-0.001, 2.0, 7.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, terms string")
    found = sorted(map(tuple, maxscore.search_report(frame).collect()))
    docs = {0: {0: 128, 1: -64}, 50: {0: 0, 1: 0}, 5: {}, 6: {0: -1, 1: 512, 2: 1792}}
    assert found == _plain_search(docs, {0: docs[0], 50: docs[50]}, 5)
    assert maxscore.search_report(frame.where("false")).count() == 0
    assert maxscore.search_report(frame.where("vec_id = 0")).count() == 0  # no other row


@pytest.mark.parametrize("name", ["op11_sessions", "op12_repair", "op13_maxscore"])
def test_queries_equal_their_sql(oracle, name):
    from quillstream.llm import queries

    oracle.db.sql(f"CREATE OR REPLACE VIEW clicks AS SELECT * FROM '{oracle.sf}/clicks.parquet'")
    oracle.check(queries.QUERIES[name], queries.ORACLES[name])
