"""Winnowing, quotation linking, surrogates: main paths without Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.llm import queries, quotes, surrogates, winnowing
from tests.llm.helpers import frame, prose


def brute_contamination(docs, items):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows: dict = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        ids = sorted("" if x is None else str(x) for x in found)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_equals_brute_force(spark):
    a, b = prose(40, 1), prose(12, 2)
    items = [(1, a), (2, b), (3, "two words"), (4, None), (5, ""), (6, a), (None, "lonely"), (7, "É Éa straße")]
    aw = a.split(" ")
    docs = [(1, f"x {a} y"), (2, "q " + " ".join(aw[5:15]) + " z"), (3, "q " + " ".join(aw[5:14]) + " z"), (4, "TWO, words two  words"), (5, None), (6, ""), (7, f"lonely\n{b.upper()}"), (8, "é Éa straße É éa"), (9, "a " * 500), (10, prose(3000, 5) + " " + a), (1, f"x {a} y"), (None, b), (11, " ".join(aw[:12] + aw[4:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.decontamination_report(frame(spark, docs), bench)
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_contamination(docs, items), key=key)


def test_contamination_of_texts_in_the_words_of_the_benchmark(spark):
    rng = random.Random(3)
    few = [prose(1, s) for s in range(12)]
    say = lambda n: " ".join(rng.choice(few) for _ in range(n))
    long = say(3000)
    items = [(i, say(n)) for i, n in enumerate([40, 25, 9, 8, 5, 4, 3, 11, 10])] + [(90, " ".join(long.split()[50:2500]))]
    docs = [(i, say(rng.choice([3, 12, 60, 400]))) for i in range(60)] + [(100, long), (101, f"{items[0][1]} {items[1][1]}"), (102, few[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.decontamination_report(frame(spark, docs), bench)
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_contamination(docs, items), key=key)


def test_contamination_of_nothing(spark):
    docs, bench = frame(spark, [(1, prose(30, 1))]), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in winnowing.decontamination_report(docs, bench).collect()] == [False]
    assert winnowing.decontamination_report(docs.where("false"), bench).count() == 0


def test_contamination_query_equals_sql(oracle):
    oracle.check(queries.QUERIES["op10_winnowing"], queries.ORACLES["op10_winnowing"])


def test_drop_contaminated(spark):
    a = prose(30, 3)
    docs = frame(spark, [(1, a), (2, prose(30, 4)), (3, None)])
    for name in ("r1", "_r1", "row", "words", "stretches", "bits", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    out = winnowing.drop_contaminated(docs, spark.createDataFrame([(1, a)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello  world\nSecond line"), (1, 1, "assistant", "> hello World\nmy answer"), (1, 2, "user", "On Monday X wrote:\n> > Hello world\n> my answer\nok then"), (1, 3, "user", "> nowhere said\nfine"),
        (2, 0, "user", None), (2, 1, "user", ""), (2, 2, "user", "> "), (None, 1, "user", "> x"), (1, 1, "assistant", "> hello World\nmy answer"),
    ]
    messages = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.root_turn, r.depth, r.n_quoted, r.n_linked) for r in quotes.conversations(messages).collect()}
    assert got[1, 0] == ("Hello  world\nSecond line", None, 0, 0, 0, 0)
    assert got[1, 1] == ("my answer", 0, 0, 1, 1, 1)
    assert got[1, 2] == ("ok then", 1, 0, 2, 2, 2)
    assert got[1, 3] == ("fine", None, 3, 0, 1, 0)
    assert got[2, 0][0] is None and got[2, 1][0] == "" and got[2, 2][0] == "" and got[None, 1][0] == ""
    assert quotes.conversations(messages).count() == len(rows)
    assert quotes.conversations(messages.where("false")).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, 0, "u", "line 0")] + [(1, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 30)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.depth for r in got} == {i: i for i in range(30)} and {r.root_turn for r in got} == {0}


def brute_conversations(messages):
    """The whole job again, message by message."""
    by_turn: dict = {}
    for conv, turn, _, text in messages:
        if conv is not None and turn is not None and text is not None:
            by_turn[conv, turn] = min(by_turn.get((conv, turn), text), text)

    def read(text):
        out = []  # [level, norm]
        for part, body in enumerate(re.split(quotes.DIVIDER, text)):
            for raw in re.split(quotes.LINE_END, body):
                lead = raw[: len(raw) - len(raw.lstrip(" \t>"))]  # the marks, with blanks between them
                cut = lead.rfind(">") + 1
                line = raw[cut + (raw[cut : cut + 1] in (" ", "\t") and cut > 0) :]
                out.append([lead.count(">") + part, " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), line).split()), line, part])
        for i, (level, _, line, part) in enumerate(out):
            if re.match(quotes.INTRO, line) and i + 1 < len(out) and out[i + 1][0] > level or part and re.match(quotes.HEADER, line):
                out[i][1] = ""
        return [x[:2] for x in out]

    def units(rows):
        """(level, whole run, its paragraphs as lists of lines)."""
        runs = []
        for level, norm in rows:
            if not runs or runs[-1][0] != level:
                runs.append((level, [[]]))
            if norm:
                runs[-1][1][-1].append(norm)
            else:
                runs[-1][1].append([])
        return [(level, [p for p in ps if p]) for level, ps in runs if any(ps)]

    held: dict = {}
    parsed = {k: units(read(t)) for k, t in by_turn.items()}
    for (conv, turn), runs in parsed.items():
        own = [ps for level, ps in runs if level == 0]
        texts = ["\n".join(x for ps in own for p in ps for x in p)] + ["\n".join(x for p in ps for x in p) for ps in own]
        texts += ["\n".join(p) for ps in own for p in ps] + [x for ps in own for p in ps for x in p]
        for t in texts:
            held.setdefault((conv, t), set()).add(turn)
    parent, counts = {}, {}
    for (conv, turn), runs in parsed.items():
        find = lambda t: max((o for o in held.get((conv, t), ()) if o < turn), default=None)  # noqa: E731, B023
        votes: dict = {}
        n = [0, 0]
        for level, ps in runs:
            if level == 0:
                continue
            whole = find("\n".join(x for p in ps for x in p))
            for p in ps:
                for x in p:
                    o = next((o for o in (whole, find("\n".join(p)), find(x)) if o is not None), None)
                    n[0] += 1
                    n[1] += o is not None
                    if level == 1 and o is not None:
                        votes[o] = votes.get(o, 0) + len(x)
        counts[conv, turn] = n
        if votes:
            parent[conv, turn] = max(votes, key=lambda o: (votes[o], o))
    out = []
    for conv, turn, role, text in messages:
        root, depth = turn, 0
        while text is not None and (conv, root) in parent:
            root, depth = parent[conv, root], depth + 1
        out.append((conv, turn, role, parent.get((conv, turn)), root, depth, *counts.get((conv, turn), (0, 0))))
    return out


def quoted_talk(seed: int, n: int):
    """Messages that quote earlier ones: whole, in part, nested, altered, below a divider."""
    rng, texts, rows = random.Random(seed), [], []
    say = lambda: "\n".join(prose(rng.randint(1, 4), rng.randrange(30)) if rng.random() < 0.8 else "" for _ in range(rng.randint(1, 5)))
    for turn in range(n):
        text = say()
        if texts and rng.random() < 0.8:
            old = rng.choice(texts)
            part = old.split("\n")[rng.randrange(2) : rng.randint(2, 9)]
            if rng.random() < 0.15:
                text = f"{text}\n\n----- Original Message -----\nFrom: x\nSent: y\n" + "\n".join(part)
            else:
                mark = rng.choice(["> ", ">", " > "])
                intro = rng.choice(["", "On Monday X wrote:\n", "Am 1.2. schrieb Y:\n"])
                text = intro + "\n".join(mark + (x.upper() if rng.random() < 0.2 else x) for x in part) + "\n" + text
        texts.append(text)
        rows.append((turn % 3, turn, "user", text))
    return rows


def test_conversations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SPAN", 4)
    rows = quoted_talk(1, 150) + quoted_talk(2, 60) + [(7, 0, "user", None), (7, 1, "user", "> x"), (None, 3, "a", "> y\nz"), (7, None, "a", "> x")]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    key = lambda r: str(r)
    assert sorted([(r.conv_id, r.turn, r.role, r.parent_turn, r.root_turn, r.depth, r.n_quoted, r.n_linked) for r in got], key=key) == sorted(brute_conversations(rows), key=key)
    assert max(r.depth for r in got) > 3 and sum(r.n_linked for r in got) > 100
    for conv in (0, 1, 2):
        order = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in order] == list(range(1, len(order) + 1)) and [(r.root_turn, r.turn) for r in order] == sorted((r.root_turn, r.turn) for r in order)


def test_one_line_quoted_in_every_turn_takes_linear_work(spark):
    rows = [(1, i, "u", f"> the same line\nthe same line\nown {i}") for i in range(6000)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.where("turn > 0 and (parent_turn != turn - 1 or parent_turn is null)").isEmpty() and got.agg(F.max("depth")).first()[0] == 5999


def test_passages_come_before_lines(spark):
    rows = [(1, 0, "u", "alpha\nbeta"), (1, 1, "u", "beta"), (1, 2, "u", "> alpha\n> beta\nyes"), (1, 3, "u", "> beta\nno"), (1, 4, "u", "hi\n-----Original Message-----\nFrom: a\nalpha\nbeta")]
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2].parent_turn == 0 and got[3].parent_turn == 1 and (got[4].parent_turn, got[4].text, got[4].n_quoted) == (0, "hi", 2)


def test_quote_query_keeps_plain_messages(spark, sf):
    messages = spark.read.parquet(f"{sf}/conversations.parquet")
    got = queries.QUERIES["op3_quotes"](spark, sf)
    assert got.count() == messages.count()
    assert messages.join(got.withColumnRenamed("text", "t"), ["conv_id", "turn", "role"]).where("text != t").isEmpty()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_surrogates(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = frame(spark, [
        (1, "Dear Mr. John Smith, call +1 (664) 555-5990 or John.Smith@Mail.example.com."), (2, f"john.smith@mail.example.com +16645555990 Frau Müller г-жа Анна Петрова 4111 1111 1111 1111, 10.2.3.4 {secret}"),
        (3, None), (4, ""), (5, "nothing 12 here 1234567890123456 a@b"), (None, "JOHN.SMITH@MAIL.EXAMPLE.COM"), (1, "Dear Mr. John Smith, call +1 (664) 555-5990 or John.Smith@Mail.example.com.")])
    rows = surrogates.replace_entities(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and by[3].text is None and by[4].text == "" and by[5].n_entities == 0 and by[5].text == "nothing 12 here 1234567890123456 a@b"
    one, two = by[1], by[2]
    assert one.n_entities == 3 and two.n_entities == 7
    for old in ("Smith", "664", "Mail", "mail.example"):
        assert old not in one.text
    phone = re.search(r"\+1 \((\d{3})\) 555-(\d{4})", one.text)
    assert phone and f"+1{phone[1]}555{phone[2]}" in two.text
    mail = re.search(r"\S+@\S+\.com", one.text)[0]
    assert mail in two.text and by[None].text == mail.upper()
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", two.text)[0]
    assert luhn(card.replace(" ", "")) and card != "4111 1111 1111 1111"
    assert re.search(r"Frau [A-Z][a-z]+ г-жа (?:" + "|".join(surrogates.FEMALE_CYRILLIC) + r") [А-Я][а-я]+", two.text)
    assert one.text.startswith("Dear Mr. ") and one.text.split()[2] in surrogates.MALE_NAMES
    assert secret not in two.text and re.search(r"[0-9a-f]{40}$", two.text)
    assert surrogates.replace_entities(docs.where("false")).count() == 0


def entity_frame(spark, rows):
    return spark.createDataFrame([(*r, False, False) for r in rows], "kind string, norm string, female boolean, male boolean")


def test_surrogates_of_100_000_names_are_distinct(spark):
    found = spark.range(100_000).selectExpr("'surname' as kind", "concat('n', id) as norm", "false as female", "false as male")
    found = found.unionByName(found.limit(3000).selectExpr("'surname' as kind", "concat('я', norm) as norm", "female", "male")).unionByName(found.limit(2000).selectExpr("'given' as kind", "norm", "true as female", "male"))
    table = surrogates.surrogate_table(found)
    n = table.agg(F.count("*"), F.countDistinct("kind", F.lower("surrogate"))).first()
    assert n[0] == n[1] == 105_000
    assert table.where("kind = 'given' and not surrogate rlike '^[A-Z][a-z]+(-[A-Z][a-z]+)*$'").isEmpty()


def test_surrogates_fill_small_formats(spark):
    found = [("ip", f"10.0.{i // 250}.{i % 250}") for i in range(500)] + [("phone", f"12{i:03d}") for i in range(1000)] + [("phone", f"1664555{i:04d}") for i in range(3000)]
    found += [("local", c) for c in "abcdefghijklmnopqrstuvwxyz"] + [("local", f"{c}{d}") for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"] + [("domain", f"{c}.de") for c in "xyz"] + [("domain", "mail.example.com")]
    table = surrogates.surrogate_table(entity_frame(spark, found)).collect()
    made = {(r.kind, r.surrogate) for r in table}
    assert len(table) == len(found) == len(made) and not made & set(found)
    by = {(r.kind, r.norm): r.surrogate for r in table}
    assert re.fullmatch(r"[a-z]+\.de", by["domain", "x.de"]) and re.fullmatch(r"[a-z]{4}\.[a-z]{7}\.com", by["domain", "mail.example.com"])
    assert all(re.fullmatch(r"1[2-9]\d\d555\d{4}", r.surrogate) for r in table if r.kind == "phone" and len(r.norm) == 11)


def test_a_format_without_room_is_an_error(spark):
    cards = [("card", f"4{i:03d}0") for i in range(1000)]  # 5 digits: 1,000 numbers, of which 256 can be dealt
    with pytest.raises(ValueError, match="too little room"):
        surrogates.surrogate_table(entity_frame(spark, cards))


def test_surrogates_equal_a_twin(spark):
    """The permutation and the encoding of IPv4 addresses, phones and surnames again in Python."""
    def place(i, half, cls, mask):
        left, right = i >> half, i & mask
        for k in range(1, surrogates.ROUNDS + 1):
            digest = hashlib.sha256(f"{surrogates.KEY}|{cls}|{k}|{right}".encode()).hexdigest()
            left, right = right, left ^ (int(digest[:15], 16) & mask)
        return (left << half) + right

    found = [("ip", f"10.0.0.{i}") for i in range(60)] + [("phone", f"4930555{i:04d}") for i in range(60)] + [("surname", f"s{i}") for i in range(60)]
    for r in surrogates.surrogate_table(entity_frame(spark, found)).collect():
        v = place(r.i, r.half, r.cls, (1 << r.half) - 1)
        if r.kind == "ip":
            want = ".".join(str(v // 254**k % 254 + 1) for k in range(4))
        elif r.kind == "phone":
            want = f"{r.norm[:1]}{2 + v // 1_000_000}{v // 10_000 % 100:02d}555{v % 10_000:04d}"
        else:
            first, middle, last = surrogates.LATIN
            want = first[v % 16] + middle[v // 192 % 16] + last[v // 16 % 12]
        assert r.surrogate == want


def test_surrogates_keep_persons_and_formats(spark):
    key = "ab12" * 75
    docs = frame(spark, [
        (1, "Mr. Smith met John Smith and Ms Mary SMITH. Then Smith left; Smithers stayed."), (2, "Dr Smith, my name is Zoe Quill. Zoe said Quill."), (3, f"key {key} and {key.upper()}."),
        (4, "г-н Иванов и Анна Петрова; Петрова ушла"), (5, "a.b@x-mail.org A.B@X-MAIL.ORG c.d@x-mail.org " + prose(20_000, 8)), (6, "+49 30 1234567 and +49 (30) 12 34 567 and (212) 555-0100"),
    ])
    got = {r.doc_id: r for r in surrogates.replace_entities(docs).collect()}
    one = re.fullmatch(r"Mr\. (\w+) met (\w+) (\w+) and Ms (\w+) (\w+)\. Then (\w+) left; Smithers stayed\.", got[1].text)
    assert one and {one[1], one[3], one[5], one[6]} == {one[1]} and one[2] in surrogates.MALE_NAMES and one[4] in surrogates.FEMALE_NAMES
    two = re.fullmatch(r"Dr (\w+), my name is (\w+) (\w+)\. Zoe said (\w+)\.", got[2].text)
    assert two and two[1] == one[1] and two[3] == two[4] != "Quill"
    three = re.fullmatch(r"key ([0-9a-f]{300}) and ([0-9A-F]{300})\.", got[3].text)
    assert three and three[1].upper() == three[2] and three[1] != key
    four = re.fullmatch(r"г-н ([А-Я][а-я]+) и ([А-Я][а-я]+) ([А-Я][а-я]+); ([А-Я][а-я]+) ушла", got[4].text)
    assert four and four[3] == four[4] and four[3][-1] == "а" and four[2] in surrogates.FEMALE_CYRILLIC
    mails = got[5].text.split(" ")[:3]
    assert mails[0].upper() == mails[1] and mails[0].split("@")[1] == mails[2].split("@")[1] and re.fullmatch(r"[a-z]\.[a-z]+@[a-z]-[a-z]{4}\.org", mails[0]) and got[5].text.endswith(prose(20_000, 8))
    six = re.fullmatch(r"\+4(\d) (\d\d) (\d{7}) and \+4(\d) \((\d\d)\) (\d\d) (\d\d) (\d{3}) and \(\d{3}\) 555-\d{4}", got[6].text)
    assert six and six[1] + six[2] + six[3] == "".join(six.groups()[3:])


def test_surrogate_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("old"))
    rows = queries.QUERIES["op7_surrogates"](spark, sf).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        mails = re.findall(r"[\w.]+@[\w.]+\.com", r.old)
        assert (r.n_entities > 0) or not mails
        assert all(m not in r.text for m in mails) and len(r.text.split()) == len(r.old.split())
        if not r.n_entities:
            assert r.text == r.old


@pytest.mark.parametrize("name", ["op3_quotes", "op7_surrogates", "op10_winnowing"])
def test_plans_have_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not re.search(r"MapInArrow|MapInPandas|PythonUDF|ArrowEval|BatchEval", plan)
