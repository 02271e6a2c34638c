"""Personal data replaced by surrogates, in DataFrame expressions only.

One regular expression finds the entities of a text: e-mail addresses, phone numbers, IPv4 addresses, payment cards
(13 to 19 digits that pass the Luhn test), keys and tokens in hexadecimal, and persons' names after a title, an introduction or with
a listed given name; a cheap test for each type keeps it from most texts. A surname found in a text is replaced in the whole of that text, also where it
stands alone. An entity's normal form (case, spacing, punctuation and title apart) makes it coreferent over the whole
corpus. Mail addresses fall into local part and domain, names into given name and surname, each with a surrogate of its own: "Mr. Smith"
and "John Smith" keep their surname in common, as do two addresses their domain.

Distinct by construction: entities of one type and format are numbered, and a keyed permutation (a Feistel network over SHA-256)
of a power of four that is at least twice their number maps each number to a place in the format's domain. Domains: phones keep country code and length,
with a 555 exchange; addresses octets from 1 to 254; cards their first digit, length and a right check digit; local parts and domains their layout of
letters, digits and separators, and the top-level domain; keys length and case; names script, gender and number of words. A domain that is too
small is widened: phones by digits at the end, local parts and domains by letters, surnames by syllables, given names by a second one.
Addresses, cards and keys can't be; too many of them (10^9 addresses) are an error, never a shared surrogate.
A last check by joins finds surrogates that are entities of the corpus themselves, or that widened formats share; those entities take
further numbers until none is left. Numbers follow the corpus, so surrogates are consistent within one run.

Cases: null stays null, texts without entities stay as they are. Equal texts are worked once, under a hash of the
text; repeated rows get a result each. A very long text is read whole; of a run of more than 127 labels after an @ the first 127 are the host. A null doc_id is kept. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import small, written

KEY = "quillstream-surrogates"
#: Entities of a class in one group of the numbering.
GROUP_ROWS = 20_000
ROUNDS = 6

# fixed values: titles by gender, and given names by gender and script
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа")
OTHER_TITLES = ("Dr", "Prof")
MALE_NAMES = ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Charles", "Daniel", "Peter", "Hans", "Klaus", "Pierre", "Jean", "Carlos", "Pedro")
FEMALE_NAMES = ("Mary", "Patricia", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Emma", "Laura", "Ursula", "Heike", "Marie", "Claire", "Carmen", "Lucia")
MALE_CYRILLIC = ("Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Михаил", "Николай", "Павел")
FEMALE_CYRILLIC = ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана")
OTHER_NAMES = ("Alex", "Robin", "Kim", "Sam", "Jules", "Noa", "Sascha", "Toni", "Andrea", "Dominique", "Kay", "Lou", "Mika", "Chris", "Jamie", "Quinn")
OTHER_CYRILLIC = ("Саша", "Женя", "Валя", "Слава", "Паша", "Шура", "Витя", "Юра")
INTRODUCTIONS = ("my name is", "My name is", "ich heiße", "Ich heiße", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут")

# syllables of invented surnames, all of one length in a list: beginning, middle, end
LATIN = (("Bar", "Cal", "Der", "Fen", "Gal", "Hol", "Kes", "Lam", "Mar", "Nor", "Pel", "Ras", "Sel", "Tam", "Vor", "Win"), ("ba", "ce", "di", "fo", "gu", "ke", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "zu"), ("dale", "den", "ford", "grave", "ley", "mont", "ner", "ton", "wick", "worth", "man", "field"))
CYRILLIC = (("Бел", "Кор", "Лаз", "Мор", "Сав", "Тих", "Фед", "Яко"), ("ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха"), ("дин", "ров", "нский", "ченко"))
CYRILLIC_FEMALE = (CYRILLIC[0], CYRILLIC[1], ("дина", "рова", "нская", "ченка"))

_given = "|".join(MALE_NAMES + FEMALE_NAMES + MALE_CYRILLIC + FEMALE_CYRILLIC)
_titles = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_intro = "|".join(INTRODUCTIONS)
_WORD = r"\p{Lu}[\p{L}'-]+"
_AT = r"(?<![\p{L}\p{N}])"
_NAME = rf"(?=[\p{{Lu}}г]){_AT}(?:(?:{_titles})\.?[ ]{_WORD}(?:[ ]{_WORD})?|(?:{_given})[ ]{_WORD})(?![\p{{L}}\p{{N}}])|(?=\p{{Lu}})(?<=(?:{_intro})[ ]){_WORD}(?:[ ]{_WORD})?(?![\p{{L}}\p{{N}}])"
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"  # a host has 127 labels at most; Java's matcher recurses for each turn of a group loop
_HEX = r"(?<![A-Za-z0-9])(?=[0-9a-fA-F]{32})(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
_CARD = r"(?<![\d-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)"
PATTERN = "|".join((_MAIL, _HEX, _IP, _CARD, _PHONE, _NAME))


def may_hold(text: Column) -> Column:
    """False for texts that hold no entity: a test of what any entity of each type needs, each in one look at the text."""
    return text.contains("@") | text.rlike(r"[+(0-9][0-9 .()-]{5}") | text.rlike(r"[0-9a-fA-F]{32}") | text.rlike(rf"(?=[\p{{Lu}}г])(?:{_titles}|{_given})[. ]|(?:{_intro})[ ]\p{{Lu}}")


def _kind(x: str) -> str:
    """SQL: the type of a string that PATTERN has found; null for digits that are no card."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    luhn = f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> if(i % 2 = 0, int(d), if(int(d) > 4, int(d) * 2 - 9, int(d) * 2))), 0, (s, v) -> s + v) % 10 = 0"
    return (
        f"case when contains({x}, '@') then 'email' when {x} rlike '^[+(]' then 'phone' when {x} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then 'ip' "
        f"when {x} rlike '^[0-9 -]+$' and length({digits}) <= 19 then if({luhn}, 'card', null) when {x} rlike '^[0-9a-fA-F]+$' then 'secret' when {x} rlike '[0-9]' then null else 'name' end"
    )


def _any(options: tuple[str, ...], end: str) -> str:
    return "^(?:" + "|".join(options) + f"){end}"


_UNTITLED = f"regexp_replace(raw, '^(?:{_titles})[.]?[ ]', '')"
_GIVEN = f"if(contains({_UNTITLED}, ' '), split_part({_UNTITLED}, ' ', 1), null)"


def _parts() -> str:
    """SQL: of raw and kind, the entities in a mention: structs (part, kind, norm, female, male)."""
    female = f"coalesce(raw rlike '{_any(FEMALE_TITLES, '[. ]')}' or {_GIVEN} rlike '{_any(FEMALE_NAMES + FEMALE_CYRILLIC, '$')}', false)"
    male = f"coalesce(raw rlike '{_any(MALE_TITLES, '[. ]')}' or {_GIVEN} rlike '{_any(MALE_NAMES + MALE_CYRILLIC, '$')}', false)"
    one = lambda i, kind, norm, f="false", m="false": f"struct({i} as part, {kind} as kind, {norm} as norm, {f} as female, {m} as male)"
    mail = f"array({one(0, repr('local'), 'lower(split_part(raw, chr(64), 1))')}, {one(1, repr('domain'), 'lower(split_part(raw, chr(64), 2))')})"
    surname = one(1, "'surname'", f"lower(split_part({_UNTITLED}, ' ', -1))")
    name = f"if({_GIVEN} is null, array({surname}), array({one(0, repr('given'), f'lower({_GIVEN})', female, male)}, {surname}))"
    rest = one(0, "kind", "if(kind in ('phone', 'card'), regexp_replace(raw, '[^0-9]', ''), lower(raw))")
    return f"case kind when 'email' then {mail} when 'name' then {name} else array({rest}) end"


_LAYOUT = "regexp_replace(regexp_replace({x}, '[a-z]', 'a'), '[0-9]', '0')"
#: Letters and digits of a local part or domain that carry the number; more of them are drawn from a hash.
CARRIED = 12


def _alnum(x: str) -> str:
    return f"pow(26D, least({CARRIED}, length(regexp_replace({x}, '[^a-z]', '')))) * pow(10D, greatest(0, least({CARRIED} - length(regexp_replace({x}, '[^a-z]', '')), length(regexp_replace({x}, '[^0-9]', '')))))"


_HOST, _TOP = "regexp_extract(norm, '^(.*)[.][^.]+$', 1)", "regexp_extract(norm, '[.][^.]+$', 0)"
_IS_CYRILLIC = "norm rlike '[а-яё]'"


def classed(entities: DataFrame) -> DataFrame:
    """entities (kind, norm, female, male) with cls, the format whose entities are numbered together, room (how many such there can be) and step (how many times more with each widening; 1: none)."""
    gender = "case when female and not male then 'f' when male and not female then 'm' else 'u' end"
    script = f"if({_IS_CYRILLIC}, if(kind = 'surname' and norm rlike '[ая]$', 'cf', 'c'), 'l')"
    cls = f"""case kind when 'phone' then concat(length(norm), ' ', substr(norm, 1, if(length(norm) >= 10, length(norm) - 10, 2))) when 'card' then concat(substr(norm, 1, 1), ' ', length(norm))
        when 'secret' then string(length(norm)) when 'local' then {_LAYOUT.format(x='norm')} when 'domain' then concat({_LAYOUT.format(x=_HOST)}, {_TOP}) when 'given' then concat({script}, {gender}) when 'surname' then {script} else '' end"""
    room = f"""case kind when 'phone' then if(length(norm) >= 10, 8e6D, pow(10D, length(norm) - 2)) when 'ip' then pow(254D, 4) when 'card' then pow(10D, length(norm) - 2) when 'secret' then pow(2D, 60)
        when 'local' then {_alnum('norm')} when 'domain' then {_alnum(_HOST)} when 'given' then if({_IS_CYRILLIC}, {len(MALE_CYRILLIC)}D, {len(MALE_NAMES)}D)
        else if({_IS_CYRILLIC}, {len(CYRILLIC[0]) * len(CYRILLIC[1]) * len(CYRILLIC[2])}D, {len(LATIN[0]) * len(LATIN[1]) * len(LATIN[2])}D) end"""
    step = f"case when kind in ('ip', 'card', 'secret') then 1D when kind = 'phone' then 10D when kind in ('local', 'domain') then 26D when kind = 'given' then if({_IS_CYRILLIC}, {len(MALE_CYRILLIC)}D, {len(MALE_NAMES)}D) else {len(LATIN[1])}D end"
    return entities.select("*", F.expr(f"concat(kind, ' ', {cls})").alias("cls"), F.expr(room).alias("room"), F.expr(step).alias("step"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (cls, wider, norm ..) with i, from 0 within each (cls, wider): counts of hash groups, then numbers inside a group."""
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("norm"), F.lit(groups)))
    counts = rows.groupBy("cls", "wider", "grp").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("cls", "wider").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("cls", "wider", "grp", before.alias("before")))
    inside = F.row_number().over(Window.partitionBy("cls", "wider", "grp").orderBy("norm"))
    return rows.join(small(starts), ["cls", "wider", "grp"]).withColumn("i", F.col("before") + inside - 1).drop("grp", "before")


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _permuted(key: str) -> str:
    """SQL: the place of number i in a keyed permutation of the numbers of 2 * half bits."""
    mask = "(shiftleft(1L, half) - 1)"
    mixed = f"cast(conv(substr(sha2(concat_ws('|', '{key}', cls, k, s.r), 256), 1, 15), 16, 10) as bigint) & {mask}"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', shiftright(i, half), 'r', i & {mask}), (s, k) -> named_struct('l', s.r, 'r', s.l ^ ({mixed})), s -> shiftleft(s.l, half) + s.r)"


def _nth(options: tuple[str, ...], place: str) -> str:
    return f"element_at(array({', '.join(repr(n) for n in options)}), int({place}) + 1)"


def _surname(v: str, parts: tuple[tuple[str, ...], ...]) -> str:
    first, middle, last = parts
    a, b, m = len(first), len(last), len(middle)
    syllables = f"array_join(transform(sequence(0, wider), k -> {_nth(middle, f'({v} div {a * b} div cast(pow({m}, k) as bigint)) % {m}')}), '')"
    return f"concat({_nth(first, f'{v} % {a}')}, {syllables}, {_nth(last, f'{v} div {a} % {b}')})"


def _given_name(v: str, names: tuple[str, ...]) -> str:
    return f"array_join(transform(sequence(0, wider), k -> {_nth(names, f'({v} div cast(pow({len(names)}, k) as bigint)) % {len(names)}')}), '-')"


def _filled(v: str, layout: str, key: str) -> str:
    """SQL: layout with letters for letters and digits for digits, and `wider` more letters, from the number v; what it can't fill from a hash."""
    letter, digit = "substr('abcdefghijklmnopqrstuvwxyz', int({n} % 26) + 1, 1)", "string({n} % 10)"
    hashed = f"sha2(concat('{key}', '|', norm, '|', int(s.k / 8)), 256)"
    drawn = f"cast(conv(substr({hashed}, s.k % 8 * 8 + 1, 8), 16, 10) as bigint)"
    full = f"s.k >= {CARRIED} + wider"
    step = f"""case when c rlike '[a-z]' then named_struct('v', if({full}, s.v, s.v div 26), 'k', s.k + 1, 'out', concat(if({full}, {letter.format(n=drawn)}, {letter.format(n='s.v')}), s.out))
        when c rlike '[0-9]' then named_struct('v', if({full}, s.v, s.v div 10), 'k', s.k + 1, 'out', concat(if({full}, {digit.format(n=drawn)}, {digit.format(n='s.v')}), s.out))
        else named_struct('v', s.v, 'k', s.k, 'out', concat(c, s.out)) end"""
    return f"aggregate(reverse(split(concat({layout}, repeat('a', wider)), '')), named_struct('v', {v}, 'k', 0, 'out', ''), (s, c) -> {step}, s -> s.out)"


def _encoded(key: str) -> str:
    """SQL: of kind, norm, cls, wider and the permuted number v: the surrogate of the normal form."""
    luhn_sum = "aggregate(transform(split(reverse(body), ''), (d, i) -> if(i % 2 = 1, int(d), if(int(d) > 4, int(d) * 2 - 9, int(d) * 2))), 0, (s, x) -> s + x)"
    card = _let("concat(substr(norm, 1, 1), lpad(string(v), length(norm) - 2, '0'))", "body", f"concat(body, string((10 - {luhn_sum} % 10) % 10))")
    more = "if(wider = 0, '', lpad(string(v div {n}), wider, '0'))"
    long = f"concat(substr(norm, 1, length(norm) - 10), string(2 + v % 8000000 div 1000000), lpad(string(v div 10000 % 100), 2, '0'), '555', lpad(string(v % 10000), 4, '0'), {more.format(n=8_000_000)})"
    short = f"concat(substr(norm, 1, 2), lpad(string(v % cast(pow(10, length(norm) - 2) as bigint)), length(norm) - 2, '0'), {more.format(n='cast(pow(10, length(norm) - 2) as bigint)')})"
    ip = "array_join(transform(sequence(0, 3), k -> string(v div cast(pow(254, k) as bigint) % 254 + 1)), '.')"
    stream = f"array_join(transform(sequence(0, int(length(norm) / 64)), k -> sha2(concat('{key}', '|secret|', norm, '|', k), 256)), '')"
    secret = f"substr(concat(lpad(lower(hex(v)), 15, '0'), {stream}), 1, length(norm))"
    given = f"case substr(cls, 7) when 'lf' then {_given_name('v', FEMALE_NAMES)} when 'lm' then {_given_name('v', MALE_NAMES)} when 'lu' then {_given_name('v', OTHER_NAMES)} when 'cf' then {_given_name('v', FEMALE_CYRILLIC)} when 'cm' then {_given_name('v', MALE_CYRILLIC)} else {_given_name('v', OTHER_CYRILLIC)} end"
    surname = f"case substr(cls, 9) when 'l' then {_surname('v', LATIN)} when 'c' then {_surname('v', CYRILLIC)} else {_surname('v', CYRILLIC_FEMALE)} end"
    return f"""case kind when 'phone' then if(length(norm) >= 10, {long}, {short}) when 'ip' then {ip} when 'card' then {card} when 'secret' then {secret} when 'local' then {_filled('v', 'norm', key)}
        when 'domain' then concat({_filled('v', _HOST, key)}, {_TOP}) when 'given' then {given} else {surname} end"""


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entities (kind, norm, female, male), distinct by kind and norm -> with surrogate: distinct in its kind, and none an entity of the corpus (given names apart)."""
    rows = classed(entities)
    sizes = rows.groupBy("cls").agg(F.count("*").alias("n"))
    rows = rows.join(small(sizes), "cls").withColumn("wider", F.expr("int(if(step = 1, 0, greatest(0, ceil(ln(8 * n / room) / ln(step)))))"))
    # 4^half numbers, at least twice the entities where the format can be widened
    half = F.expr("int(least(30, floor(log2(room * pow(step, wider) * (1 + 1e-12D)) / 2)))")
    spare = "i < shiftleft(1L, 2 * half)"
    encode = lambda df: df.withColumn("half", half).withColumn("v", F.expr(_permuted(key))).withColumn("surrogate", F.when(F.expr(spare), F.expr(_encoded(key)))).drop("v")
    now = written(encode(numbered(rows)))
    taken = now.where("kind != 'given'").select("kind", F.col("norm").alias("low"))
    while True:
        out_of_room = now.where(f"not {spare}").select("kind", "norm", "cls", "step", "n", F.lit(1).alias("more"))
        if (worst := out_of_room.where("step = 1").first()) is not None:
            raise ValueError(f"the format {worst['cls']} has too little room for its {worst['n']} entities")
        keyed = now.where(spare).withColumn("low", F.lower("surrogate")).withColumn("place", F.concat_ws(" ", "cls", "wider"))
        shared = keyed.groupBy("kind", "low").agg(F.min("place").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
        clash = keyed.join(taken, ["kind", "low"], "left_semi").select("kind", "norm").unionByName(keyed.join(shared, ["kind", "low"]).where("place != least").select("kind", "norm"))
        again = written(clash.distinct().withColumn("more", F.lit(0)).unionByName(out_of_room.select("kind", "norm", "more")))
        if again.isEmpty():
            return now
        last = now.groupBy("cls", "wider").agg((F.max("i") + 1).alias("from"))
        fresh = now.drop("surrogate", "half", "i").join(again, ["kind", "norm"]).withColumn("wider", F.col("wider") + F.col("more")).drop("more")
        fresh = numbered(fresh).join(small(last), ["cls", "wider"], "left").withColumn("i", F.coalesce("from", F.lit(0)) + F.col("i")).drop("from")
        now = written(now.join(again, ["kind", "norm"], "left_anti").unionByName(encode(fresh).select(*now.columns)))


def _laid_out() -> str:
    """SQL: of raw, kind and s (the surrogates of its parts) the mention with surrogates, in its layout: digits in the places of digits, more at the end; its case; a title before a name."""
    digits = "concat(array_join(transform(split(raw, ''), (c, i) -> if(c rlike '[0-9]', substr(s[0], length(regexp_replace(substr(raw, 1, i + 1), '[^0-9]', '')), 1), c)), ''), substr(s[0], length(regexp_replace(raw, '[^0-9]', '')) + 1))"
    cased = lambda x: f"if(raw = upper(raw) and raw rlike '[A-Z]', upper({x}), {x})"
    name = f"concat(regexp_extract(raw, '^(?:{_titles})[.]?[ ]', 0), if({_UNTITLED} = upper({_UNTITLED}), upper(array_join(s, ' ')), array_join(s, ' ')))"
    return f"case when kind is null then raw when kind in ('phone', 'card') then {digits} when kind = 'ip' then s[0] when kind = 'name' then {name} when kind = 'email' then {cased('array_join(s, chr(64))')} else {cased('s[0]')} end"


def _text_id() -> list[Column]:
    return [F.xxhash64("text").alias("r1"), F.hash("text").alias("r2")]


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, kinds (sorted distinct types); a row for each input row."""
    raw = F.when(may_hold(F.col("text")), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    found = docs.select(*_text_id(), raw.alias("raws")).where(F.size("raws") > 0).select("r1", "r2", F.posexplode("raws").alias("pos", "raw"))
    mentions = written(found.distinct().withColumn("kind", F.expr(_kind("raw"))).withColumn("parts", F.expr(f"if(kind is null, null, {_parts()})")))  # equal texts have equal rows
    parts = mentions.where("kind is not null").select("r1", "r2", "pos", F.explode("parts").alias("p")).select("r1", "r2", "pos", "p.*")
    entities = parts.groupBy("kind", "norm").agg(F.max("female").alias("female"), F.max("male").alias("male"))
    table = surrogate_table(written(entities), key).select("kind", "norm", "surrogate")
    given = parts.select("r1", "r2", "pos", "part", "kind", "norm").join(small(table), ["kind", "norm"]).groupBy("r1", "r2", "pos").agg(F.array_sort(F.collect_list(F.struct("part", "surrogate"))).alias("s"))
    named = mentions.select("r1", "r2", "pos", "raw", "kind").join(given, ["r1", "r2", "pos"], "left").withColumn("s", F.col("s.surrogate")).withColumn("new", F.expr(_laid_out()))
    # a surname stands for its person in the whole text
    alone = F.when(F.col("kind") == "name", F.struct(F.expr(f"split_part({_UNTITLED}, ' ', -1)").alias("old"), F.element_at("s", -1).alias("new")))
    by_text = named.groupBy("r1", "r2").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "kind"))).alias("found"), F.array_sort(F.collect_set(alone)).alias("surnames"))  # bounded by the text's length
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_text_id()).join(small(written(by_text)), ["r1", "r2"], "left")
    bare = r"aggregate(surnames, x, (t, n) -> regexp_replace(t, concat('(?<![\\p{L}\\p{N}])', n.old, '(?![\\p{L}\\p{N}])'), n.new))"  # names hold letters, ' and - only
    rows = rows.withColumn("pieces", F.when(F.col("found").isNotNull(), F.split("text", PATTERN))).withColumn("pieces", F.expr(f"if(size(surnames) = 0, pieces, transform(pieces, x -> {bare}))"))
    put = F.array_join(F.zip_with("pieces", F.col("found.new"), lambda piece, new: F.concat(piece, F.coalesce(new, F.lit("")))), "")
    kinds = F.expr("filter(found.kind, k -> k is not null)")
    return rows.select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(put).alias("text"), F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.array_sort(F.array_distinct(kinds)), F.array().cast("array<string>")).alias("kinds"))
