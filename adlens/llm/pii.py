"""Personal data replaced by surrogates of the same kind.

Entities are found by one expression. Each distinct entity of the table gets one
surrogate, drawn from a keyed hash, of its kind and form: digits for digits, letters for
letters of the same script and case, valid addresses and check digits, names of the same
gender and script. A name that stands behind a title somewhere is also replaced where it stands
without one. The same entity has the same surrogate everywhere. Surrogates that
two entities share, or that another entity of the table has, are drawn again until none is
left, so different entities stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import fresh
from adlens.session import cut_lineage

KEY = "surrogates"
#: after so many draws a surrogate may be longer than its entity, so that there is always room
STRICT_DRAWS = 6
DRAWS = 40

# ---- fixed values: expressions per kind, titles and first and last names
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++"
IP = r"(?<!\d)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d)"
PHONE = (
    r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[\-.]\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])"
    r"|(?<![\d.])\d{3}\.\d{3}\.\d{4}(?![\d.]?\d)|(?<!\d)(?<!\d )\d{3} \d{3} \d{4}(?! ?\d)"
    # national: a trunk prefix, nine to twelve digits, no date and no SSN
    r"|(?<![\d+\-./(])(?<!\d )(?!\d{2}[\-./ ]\d{2}[\-./ ]\d{4})(?!\d{3}-\d{2}-\d{4}(?!\d))(?=\(?\d(?:[ /\-)]{0,2}\d){8,11}(?![ /\-]?\d))"
    r"(?:\(0\d{1,4}\) ?|0\d{1,4}[ /\-])\d{2,8}(?:[ \-]\d{2,8}){0,4}"
)
CARD = r"(?<![\d+])(?:\d[ \-]?){12,18}\d(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
SECRET = (
    r"(?<=(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
    r"[A-Za-z0-9_\-+/=]{8,}+|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"
)
TITLES = {
    "female": ["Mrs.", "Ms.", "Miss", "Frau", "Mme", "Mlle", "Señora", "Г-жа"],
    "male": ["Mr.", "Herr", "Señor", "Г-н"],
    "any": ["Dr.", "Prof."],
}
NAMES = {
    "latin": {
        "female": "Alma Berta Clara Dora Edith Flora Greta Hanna Irene Julia Karla Laura Marta Nora Olga Paula Rosa Sara Tilda Vera".split(),
        "male": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Nils Otto Paul Ralf Simon Theo Viktor".split(),
        "last": "Adler Berg Conti Duran Engel Fabre Gomes Haas Iversen Jansen Keller Lang Moreau Novak Olsen Perez Quist Roth Silva Toth".split(),
    },
    "cyrillic": {
        "female": "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Софья".split(),
        "male": "Антон Борис Виктор Денис Егор Иван Лев Олег Павел Роман".split(),
        "last": "Белов Волков Громов Дубов Зимин Крылов Лебедь Мороз Орлов Соколенко".split(),
    },
}
#: letters without case by script; others of their kind become Latin
CASELESS = [(rf"\p{{Is{script}}}", "".join(chr(k) for k in range(first, last + 1))) for script, first, last in (
    ("Han", 0x4E00, 0x4EFF), ("Arabic", 0x641, 0x64A), ("Hebrew", 0x5D0, 0x5EA), ("Hiragana", 0x304B, 0x3062),
    ("Katakana", 0x30AB, 0x30C2), ("Hangul", 0xAC00, 0xACFF), ("Thai", 0xE01, 0xE2E), ("Devanagari", 0x915, 0x939),
)] + [(r"\p{Lo}|\p{Lm}|\p{Lt}", "abcdefghijklmnopqrstuvwxyz"), (r"\p{N}", "0123456789")]
MAIL_DOMAINS = ["example.com", "example.net", "example.org"]

_ANY_TITLE = "|".join(t.replace(".", r"\.") for kind in TITLES.values() for t in kind)
#: one word of a name, also O'Brien, McDonald and Smith-Jones
NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’](?=\p{Lu})|-(?=\p{L}))*+"
NAME_WORDS = 4
PERSON = rf"(?<=(?<!\p{{L}})(?:{_ANY_TITLE}) ){NAME}(?: {NAME}){{0,{NAME_WORDS - 1}}}+"
#: where a name can stand without a title, if it has two words or more
RUN = rf"(?<![\p{{L}}\p{{N}}]){NAME}(?: {NAME})++"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IP, PHONE, SSN, CARD, PERSON))
#: a text without any of these holds no entity
HINT = rf"\d|@|(?i:token|secret|passw|key)|{_ANY_TITLE}"


def _kind(e: Column, title: Column) -> Column:
    fits = lambda p: F.regexp_like(e, F.lit(f"^(?:{p})$"))
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(F.contains(e, F.lit("@")), "email")
        .when(fits(IP), "ip")
        .when(fits(SSN), "ssn")
        .when(F.startswith(e, F.lit("+")) | fits(PHONE), "phone")
        .when(fits(r"(?:\d[ \-]?){12,18}\d"), F.when(_luhn(digits) == 0, "card"))
        .when(F.regexp_like(e, F.lit(rf"^{NAME}(?: {NAME})*$")) & (title != ""), F.concat(F.lit("person "), title))
        .otherwise("secret")
    )


def _luhn(digits: Column, given: int = 0) -> Column:
    """Luhn sum modulo 10; ``given`` is 1 if the check digit is still missing."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(
        (i + given) % 2 == 1, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))
    ).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _stream(key: str, e: Column, draw: Column) -> Column:
    """128 hex digits that depend on key, entity and draw."""
    salted = lambda k: F.sha2(F.concat_ws("\x1f", F.lit(f"{key}{k}"), e, draw.cast("string")), 256)
    return F.concat(salted("a"), salted("b"))


def _number(stream: Column, i) -> Column:
    """A number up to 65535 from the stream at place i."""
    start = (F.lit(i) if isinstance(i, int) else i) * 3 % 120 + 1
    return F.conv(F.substr(stream, start.cast("int"), F.lit(4)), 16, 10).cast("int")


def _like(text: Column, stream: Column, skip: int = 0, hexadecimal: bool = False, caseless: bool = False) -> Column:
    """Same form: digit for digit, letter for letter of the same script and case; letters of
    scripts without case only if ``caseless``."""
    ranges = [("[0-9]", 48, 10), ("[a-z]", 97, 6 if hexadecimal else 26), ("[A-Z]", 65, 6 if hexadecimal else 26),
              (r"[а-я]", 0x430, 32), (r"[А-Я]", 0x410, 32), (r"[α-ρσ-ω]", 0x3B1, 17),
              (r"[Α-Ρ]", 0x391, 17), (r"\p{Ll}", 97, 26), (r"\p{Lu}", 65, 26)]

    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(CASELESS if caseless else []):
            new = F.substr(F.lit(letters), _number(stream, i) % len(letters) + 1, F.lit(1))
            out = F.when(F.regexp_like(c, F.lit(f"^{pattern}$")), new).otherwise(out)
        for pattern, base, size in reversed(ranges):
            if base < 128:
                new = F.char(F.lit(base) + _number(stream, i) % size)
            else:
                letters = F.array(*[F.lit(chr(base + k)) for k in range(size)])
                new = F.get(letters, _number(stream, i) % size)
            out = F.when(F.regexp_like(c, F.lit(f"^{pattern}$")), new).otherwise(out)
        return F.when(i < skip, c).otherwise(out) if skip else out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _pick(words: list[str], stream: Column, i: int) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), _number(stream, i) % len(words))


def _surrogate(e: Column, kind: Column, draw: Column, key: str) -> Column:
    s = _stream(key, e, draw)
    wide = draw >= STRICT_DRAWS
    octet = lambda c, i: F.when(F.length(c) == 3, 100 + _number(s, i) % 156).when(
        F.length(c) == 2, 10 + _number(s, i) % 90).otherwise(_number(s, i) % 10)
    any_octet = lambda c, i: _number(s, i) % 256
    octets = lambda f: F.array_join(F.transform(F.split(e, r"\."), lambda c, i: f(c, i).cast("string")), ".")
    local = _like(F.substring_index(e, "@", 1), s, caseless=True)
    mail = F.concat(F.when(wide, F.concat(local, F.substr(s, F.lit(1), F.lit(16)))).otherwise(local),
                    F.lit("@mail"), (_number(s, 35) % 10).cast("string"), F.lit("."), _pick(MAIL_DOMAINS, s, 36))
    country = F.regexp_extract(e, r"^(\+\d{1,3}(?=[ .\-(])|\(?0)?", 1)
    phone = F.concat(country, _like(F.substr(e, F.length(country) + 1), s))
    # all digits but the last are drawn, the last one makes the number valid
    drawn = _like(F.substr(e, F.lit(1), F.length(e) - 1), s)
    missing = (10 - _luhn(F.regexp_replace(drawn, r"\D", ""), 1)) % 10
    card = F.concat(drawn, missing.cast("string"))
    secret = F.when(F.regexp_like(e, F.lit("^[0-9a-f]+$|^[0-9A-F]+$")), _like(e, s, hexadecimal=True)).otherwise(_like(e, s))
    cyrillic = F.regexp_like(e, F.lit(r"\p{IsCyrillic}"))
    female = F.contains(kind, F.lit("female")) | ((kind == "person any") & (_number(s, 37) % 2 == 0))
    first, last = F.lit(None).cast("string"), F.lit(None).cast("string")
    for script, test in (("latin", ~cyrillic), ("cyrillic", cyrillic)):
        n = NAMES[script]
        first = F.when(test, F.when(female, _pick(n["female"], s, 1)).otherwise(_pick(n["male"], s, 1))).otherwise(first)
        last = F.when(test, _pick(n["last"], s, 2)).otherwise(last)
    # a name list is short: more draws add letters to the last name
    tail = F.when(draw > 0, F.array_join(F.transform(F.sequence(F.lit(1), draw), lambda i: F.when(
        cyrillic, F.char(F.lit(97)) if False else _pick([chr(0x430 + k) for k in range(32)], s, 5)
    ).otherwise(F.char(97 + _number(s, i + 4) % 26))), "")).otherwise("")
    person = F.when(F.contains(e, F.lit(" ")), F.concat(first, F.lit(" "), last, tail)).otherwise(F.concat(last, tail))
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.when(wide, octets(any_octet)).otherwise(octets(octet)))
        .when(kind == "phone", phone)
        .when(kind == "ssn", _like(e, s))
        .when(kind == "card", card)
        .when(kind == "secret", secret)
        .otherwise(person)
    )


def assign_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``entity``, ``kind`` and ``surrogate`` of distinct entities; no two share a surrogate.

    A round draws for the entities that have none yet. A surrogate is given away if no
    other entity drew it, has it, or is it. Fails if entities are left after DRAWS rounds.
    """
    left = cut_lineage(entities.select("entity", "kind").distinct())
    every = left.select(F.col("entity").alias("surrogate"))
    done = None
    for draw in range(DRAWS):
        made = left.withColumn("surrogate", _surrogate(F.col("entity"), F.col("kind"), F.lit(draw), key))
        made = cut_lineage(made)
        alone = made.groupBy("surrogate").agg(F.min("entity").alias("entity"))
        free = alone.join(every, "surrogate", "left_anti")
        if done is not None:
            free = free.join(done.select("surrogate"), "surrogate", "left_anti")
        kept = made.join(free, ["entity", "surrogate"], "left_semi")
        done = cut_lineage(kept if done is None else done.unionByName(kept))
        left = cut_lineage(left.join(done, "entity", "left_anti"))
        if left.isEmpty():
            return done
    raise RuntimeError("no room for surrogates; raise DRAWS")


def _entities(text: Column) -> Column:
    """All matches of a text, in order, with the title before each (empty if there is none)."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _title_kind(before: Column) -> Column:
    out = F.lit("")
    for kind, titles in TITLES.items():
        ends = "|".join(t.replace(".", r"\.") for t in titles)
        out = F.when(F.regexp_like(before, F.lit(rf"(?:{ends}) $")), kind).otherwise(out)
    return out


def _parts(run: Column) -> Column:
    """All stretches of two to NAME_WORDS words of a run."""
    words = F.split(run, " ")
    return F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(NAME_WORDS), F.size(words))), lambda n: F.transform(
        F.sequence(F.lit(0), F.size(words) - n), lambda at: F.array_join(F.slice(words, at + 1, n), " ")
    )))


def _known(runs: DataFrame, pieces: DataFrame, given: DataFrame) -> DataFrame:
    """``id``, ``hash`` and ``names`` (name to surrogate) of the texts that can hold a name without a title.

    A name of two words or more counts in every text, a single word only in a text that has it
    behind a title, as many last names are common words.
    """
    persons = given.where(F.startswith("kind", F.lit("person")))
    here = pieces.where(F.startswith("kind", F.lit("person"))).select("id", "hash", "entity")
    there = runs.select("id", "hash", F.explode(F.array_distinct(F.flatten(F.transform("runs", lambda run: _parts(run))))).alias("entity"))
    there = there.join(persons.select("entity"), "entity", "left_semi").select("id", "hash", "entity")
    every = here.unionByName(there).distinct().join(persons, "entity")
    return every.groupBy("id", "hash").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("names"))


def replace_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with every entity replaced, and ``n_entities``, how many there were.

    A text is cut at its entities; the entities of all texts are numbered by text and
    place, joined with their surrogates, and put back between the pieces. Numbers that look like a
    card but fail the check digit are not touched. NULL texts stay NULL with 0 entities; rows
    with equal id and text are changed alike. All columns are kept, a column named
    ``n_entities`` is replaced. An empty table gives an empty table.
    """
    text = F.col(text_col)
    hinted = F.coalesce(F.regexp_like(text, F.lit(HINT)), F.lit(False))
    spans = docs.where(hinted).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), text.alias("t"))
    spans = spans.withColumn("found", _entities(F.col("t"))).where(F.size("found") > 0)
    spans = spans.withColumn("gaps", F.split("t", PATTERN, -1))
    pieces = spans.select("id", "hash", F.posexplode(
        F.zip_with("found", F.slice("gaps", 1, F.size("found")), lambda e, g: F.struct(e.alias("entity"), _title_kind(F.right(g, F.lit(12))).alias("title")))
    ).alias("at", "x")).select("id", "hash", "at", "x.entity", _kind(F.col("x.entity"), F.col("x.title")).alias("kind"))
    pieces = cut_lineage(pieces.where(F.col("kind").isNotNull()).distinct())
    # one kind per entity: names under different titles are one person
    # and a gender that is known somewhere holds everywhere
    kinds = pieces.groupBy("entity").agg(F.min(F.struct((F.col("kind") == "person any").alias("open"), "kind")).alias("x"))
    given = assign_surrogates(kinds.select("entity", "x.kind"), key).select("entity", "kind", "surrogate")
    placed = pieces.join(given.select("entity", "surrogate"), "entity").groupBy("id", "hash").agg(
        F.map_from_entries(F.sort_array(F.collect_set(F.struct("at", "surrogate")))).alias("new")
    )
    runs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("runs"))
    known = _known(runs.where(F.size("runs") > 0), pieces, given)
    i, h, new, names = fresh(docs, "pii_id", "pii_hash", "pii_new", "pii_names")
    k = known.toDF("known_id", "known_hash", "names")
    marks = placed.join(k, placed["id"].eqNullSafe(k["known_id"]) & (placed["hash"] == k["known_hash"]), "full").select(
        F.when(F.col("hash").isNull(), F.col("known_id")).otherwise(F.col("id")), F.coalesce("hash", "known_hash"), "new", "names"
    ).toDF(i, h, new, names)
    joined = docs.join(marks, docs[id_col].eqNullSafe(marks[i]) & (F.xxhash64(docs[text_col]) == marks[h]), "left")
    found, gaps = _entities(text), F.split(text, PATTERN, -1)
    words = F.transform(found, lambda e, k: F.coalesce(F.try_element_at(F.col(new), k), e))
    # longer names first; names hold nothing that a pattern reads otherwise
    longest = F.reverse(F.transform(F.array_sort(F.transform(F.map_keys(names), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda x: x["x"]))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))

    def untitled(gap: Column) -> Column:
        swapped = F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), lambda x: F.try_element_at(F.col(names), x))
        return F.array_join(F.zip_with(F.split(gap, pattern, -1), swapped, lambda g, e: F.concat(g, F.coalesce(e, F.lit("")))), "")

    gap = lambda g: F.when(F.col(names).isNull(), g).otherwise(untitled(g))
    rebuilt = F.array_join(F.zip_with(gaps, words, lambda g, e: F.concat(gap(g), F.coalesce(e, F.lit("")))), "")
    more = F.when(F.col(names).isNull(), 0).otherwise(F.aggregate(gaps, F.lit(0), lambda n, g: n + F.regexp_count(g, pattern)))
    n = F.greatest(F.coalesce(F.size(new), F.lit(0)), F.lit(0)) + more
    changed = F.col(new).isNotNull() | F.col(names).isNotNull()
    return joined.select(
        *[F.when(changed, rebuilt).otherwise(text).alias(c) if c == text_col else docs[c]
          for c in docs.columns if c.lower() != "n_entities"],
        F.when(changed, n).otherwise(F.lit(0)).cast("bigint").alias("n_entities"),
    )
