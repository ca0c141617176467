"""Page text, URLs, chat format, mixing, quality and surrogates."""

import collections
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from adlens.llm import chat, decision_list, html_text, jobs, mixing, oracles, pii, quality_ranker, url_rules
from adlens.llm import statistics as st

FOLDER = "/root/testdata/sf0.001"
ARTICLE = "<article><h1>Head</h1><p>First <b>bold</b>\n part &amp; more<br>next<p>Second</article>"

PAGES = [
    ("plain", f"<html><body><nav>Menu</nav><div class='ad'>Buy</div>{ARTICLE}<footer>Foot</footer></body></html>", "Head First bold part & more next Second"),
    ("inside", "<main><p>One one</p><aside>Side</aside><div class='cookie-notice'><p>Ok?</p></div><p>Two</p><section id='comments'><article>me too</article></section></main>", "One one Two"),
    ("scripts", "<article><script>var t='</p><p>no</p>'; if (a<b) {}</script><style>p{}</style><p>Yes &lt;b&gt; &#233;</p><!-- <p>no</p> --></article>", "Yes <b> é"),
    ("unclosed", "<article><div class='advert'>Buy now<p>Text stays</p><p>All", "Text stays All"),
    ("no mark", "<body><div><a href='/'>Home</a> <a href='/x'>More links here</a></div><p>" + "long text " * 20 + "</p><p>end.</p><form>Name</form></body>", "long text " * 20 + "end."),
    ("quotes", "<article><p title=it's>don't</p><p title='a>b' x=\"c>d\">won't</p><svg><title>no</title></svg></article>", "don't won't"),
    ("broken", "<<p a='>x</p><p>ok</p", None),
    ("empty", "", ""),
    ("null", None, ""),
]


def test_page_text(spark):
    rows = [(i, "u", page, "x") for i, (_, page, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][1], "x")]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    got = [(r.page_id, r.text, r.n_chars) for r in out.collect()]
    for i, (name, _, text) in enumerate(PAGES):
        if text is not None:
            assert (i, text, len(text)) in got, name
    assert len(got) == len(rows)
    assert html_text.main_text("<p>" + "<b>x " * 200_000).count("x") == 200_000


def test_stretches_reach_from_surge_to_dive():
    assert html_text.stretches([0, 0, 5, 0, 0, 7, 0, 0, 0, 1]) == [(2, 6), (9, 10)]
    assert html_text.stretches([]) == [] and html_text.stretches([0, 0]) == []


@pytest.mark.parametrize("name", ["op4_mixing", "op5_url_rules", "op7_chat"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(oracles.statements()[name])
    columns = [d[0] for d in want.description]
    got = jobs.queries()[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


URLS = [
    ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("x://m.casino-win.example.com/EN", "m.casino-win.example.com", "/EN", None, "block"),
    ("http://casinos.example.com/", "casinos.example.com", "/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://b.org/fr/1", "b.org", "/fr/1", "org/fr/", "allow"),
    ("://h?x/y", "h", "", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_rules.judge_urls(df.limit(0)).count() == 0


def test_rules_are_found_through_any_token():
    rng = random.Random(4)
    pieces = ["ads", "a", "^", "*", "/", ".", "x1", "-", "|", "news"]
    rules = [url_rules.filter_rule("block", "".join(rng.choices(pieces, k=rng.randint(1, 5)))) for _ in range(200)]
    rules = [r for r in rules if r.text.strip("|*^")]
    matcher = url_rules.Matcher(rules, *url_rules.build_index(rules, collections.Counter(t for r in rules for t in r.tokens)))
    for _ in range(300):
        url = "".join(rng.choices(["ads", "a", "/", ".", "x1", "-", "news", "b"], k=8))
        hits = [r for r in rules if re.search(r.expression, url, re.S)]
        want = min(hits, key=lambda r: (-len(r.text), r.text), default=None)
        got = matcher.best(url)
        assert (got and got.text) == (want and want.text)


TRICKY = ["", "\\", "</turn>", "<\\/turn>", "### user: x</turn>\n", "#\\##", "####", "a\n### assistant: b", "<", "</turn", "\n", "é\\#", ": ", "\\### Assistant: </turn> ok"]


def test_chat_reads_back(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "a:b", "#", "\\", ""]), "".join(rng.choices(TRICKY, k=3)), "x") for c in range(60) for t in range(rng.randint(1, 4))]
    rows += [(None, 0, None, None, "x"), (99, 1, "user", "b", "x"), (99, None, "assistant", "a", "x"), (99, 1, "user", "b", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = chat.format_conversations(df)
    out = made.select("conv_id", "exact", "formatted", chat.parse(F.col("formatted")).alias("turns"), "segments").collect()
    assert all(r.exact for r in out) and len(out) == 62
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for r in out:
        assert [(x.role, x.text) for x in r.turns] == [x[2:] for x in sorted(by[r.conv_id])]
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(3000)]
    rows += [(None, "n n n", "a", "x"), (5000, None, "b", "x"), (1, rows[1][1], rows[1][2], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    first = sorted(map(tuple, mixing.mix(df.repartition(5), keep=["source"]).collect()), key=repr)
    again = sorted(map(tuple, mixing.mix(df.repartition(2), keep=["source"]).collect()), key=repr)
    assert first == again and len(first) == len(rows)
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for _, source, n, total, want, copies, words in first:
        assert words == n * copies and copies in (0, 1, 2)
        taken[source] += words
        size[source] += n
        target[source] = want
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 60 and target[s] <= 2 * size[s]
    assert mixing.mix(df.limit(0)).count() == 0
    # without preference a document counts like any other; with it some come first
    liked = mixing.mix(df.where("source = 'c'"), preference=F.when(F.col("doc_id") % 2 == 0, 50.0).otherwise(1.0), share=0.5)
    even = liked.where("doc_id % 2 = 0").agg(F.avg("copies")).first()[0]
    odd = liked.where("doc_id % 2 = 1").agg(F.avg("copies")).first()[0]
    assert even > 0.8 and odd < 0.2


def test_statistics_by_brute_force(spark):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "a b c a b c", "a b a b a b", "#$ |x\n\n#$ |x\nÉ  a", "x " * 3000] + [
        " ".join(rng.choices(["aa", "b", "C,", "dé"], k=rng.randint(1, 40))).replace(" b ", "\n") for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: tuple(r[c] for c in st.COUNTS[:5]) for r in st.with_counts(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = word.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        assert got[i] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)), t[:60]


def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_ranker_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    docs = docs.withColumn("score", F.lit(1)).unionByName(spark.createDataFrame([(None, None), (-1, "")], "doc_id bigint, text string"), True)
    out = quality_ranker.rank_quality(docs, labels).cache()
    assert out.count() == docs.count() and out.where("not score between 0 and 1 or score is null").count() == 0
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert out.where("held_out <> coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)").count() == 0
    none = quality_ranker.rank_quality(docs, labels.limit(0))
    assert none.where("predicted = 0").count() == 0 and quality_ranker.rank_quality(docs.limit(0), labels).count() == 0


def test_decision_list(spark):
    docs, labels = labelled(spark)
    out = decision_list.judge_quality(docs, labels)
    rows = out.join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    assert all(not r.kept for r in out.where("base_failed").collect())
    assert decision_list.judge_quality(docs, labels.limit(0)).where("not base_failed and not kept").count() == 0
    assert decision_list.judge_quality(docs.limit(0), labels).count() == 0


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_surrogates(spark):
    rows = [
        (0, "Mail ann.lee@corp.example.org, or call +1 (743) 555-3824."),
        (1, "Again ann.lee@corp.example.org! From 10.2.33.240 and 10.2.33.241"),
        (2, "card 4845168114407329 not 4845168114407328, 078-05-1120"),
        (3, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" and TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!'),
        (4, "Mrs. Smith met Herr Johann Müller and г-жа; Г-жа Иванова wrote"),
        (5, None), (6, ""), (7, "version 4.0. Nothing here 2.0"), (1, "Again ann.lee@corp.example.org! From 10.2.33.240 and 10.2.33.241"),
        (None, "call +1 (743) 555-3824"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, n_entities string")
    out = pii.replace_pii(df).collect()
    assert len(out) == len(rows)
    t = {r.doc_id: r.text for r in out}
    n = {r.doc_id: r.n_entities for r in out}
    assert (n[0], n[1], n[2], n[3], n[4], n[5], n[6], n[7]) == (2, 3, 2, 2, 3, 0, 0, 0)
    assert t[5] is None and t[6] == "" and t[7] == rows[7][1]
    mail = re.search(r"\S+@\S+\.\w+", t[0]).group()
    assert mail in t[1] and "ann.lee" not in t[0] + t[1] and re.fullmatch(r"[a-z]{3}\.[a-z]{3}@mail\d\.example\.(com|net|org)", mail)
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", t[0]).group()
    assert phone in t[None] and "555-3824" not in t[0]
    a, b = re.findall(r"(\d{2}\.\d\.\d{2}\.\d{3})", t[1])
    assert a != b and all(int(x) < 256 for x in (a + "." + b).split("."))
    card, decoy = re.findall(r"\d{16}", t[2])
    assert decoy == "4845168114407328" and luhn(card) and card != "4845168114407329"
    assert re.search(r'token = "[0-9a-f]{40}" and TOKEN = "[0-9A-F]{40}"!!$', t[3]) and "b44e15" not in t[3]
    names = pii.NAMES
    assert re.match(rf"Mrs\. (?:{'|'.join(names['latin']['last'])})\w* met Herr (?:{'|'.join(names['latin']['male'])}) \w+ and", t[4])
    assert re.search(r"Г-жа (?:%s)" % "|".join(names["cyrillic"]["last"]), t[4])
    assert pii.replace_pii(df.limit(0)).count() == 0


def test_surrogates_stay_distinct_in_small_forms(spark):
    # more addresses than one draw per address keeps apart
    some = [f"{a}.{b}.{c}.{d}" for a in range(2) for b in range(5) for c in range(10) for d in range(10)]
    df = spark.createDataFrame([(x, "ip") for x in some], "entity string, kind string")
    got = pii.assign_surrogates(df).collect()
    assert len(got) == len(some) == len({r.surrogate for r in got}) and not {r.surrogate for r in got} & set(some)


def test_names_without_titles_and_further_forms(spark):
    rows = [
        (0, "Mrs. Jane Doe called. Jane Doe said that Jane Doering left"),
        (1, "Only Jane Doe here, no title."),
        (2, "Dr. Anna Maria Schmidt, Mr. Smith-Jones and Herr O'Brien; O'Brien came"),
        (3, "Prof. Jane Doe. O'Brien is free here"),
        (4, "mail 王小明@corp.example.cn and علي@corp.example.org"),
        (5, "call 0176 12345678 or 743.555.3824 or (089) 1234567 on 01-02-2020 10:00, SSN 078-05-1120"),
    ]
    out = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()}
    t = {i: r.text for i, r in out.items()}
    name = re.match(r"Mrs\. (\S+ \S+) called\. (\S+ \S+) said that Jane Doering left$", t[0])
    assert name[1] == name[2] != "Jane Doe" and name[1].split()[0] in pii.NAMES["latin"]["female"]
    assert t[1] == f"Only {name[1]} here, no title." and t[3] == f"Prof. {name[1]}. O'Brien is free here"
    assert not re.search("Schmidt|Maria|Jones|Brien", t[2]) and len(set(re.findall(r"Herr (\w+); (\w+) came", t[2])[0])) == 1
    assert not re.search("[王小明علي]", t[4]) and len(re.search(r"mail (\S+)@", t[4])[1]) == 3
    assert re.fullmatch(r"call 0\d{3} \d{8} or \d{3}\.\d{3}\.\d{4} or \(0\d\d\) \d{7} on 01-02-2020 10:00, SSN \d{3}-\d\d-\d{4}", t[5])
    assert not re.search("12345678|555|1234567|05-1120", t[5])
    assert [out[i].n_entities for i in range(6)] == [2, 1, 4, 1, 2, 4]


LONG = "long text " * 20 + "end."
ODD_PAGES = [
    ("wrapper", "<div class='page has-sidebar'><article><p>One</p></article></div>", "One"),
    ("noisy wrapper", "<div class='sidebar'><article><p>One</p></article></div><p>Other</p>", "One"),
    ("form", "<form id='all'><main><p>One</p></main></form>", "One"),
    ("builder", "<div class='elementor-widget'><p>One</p></div>", "One"),
    ("kept part", "<article><div class='entry with-comments'><p>One</p></div><div class='comments'>No</div></article>", "One"),
    ("noise stays", "<div class='sidebar widget'>No</div><article><div class='my-cookie-notice'>No</div><p>One</p></article>", "One"),
    ("teasers", f"<aside><article>No</article></aside><p>{LONG}</p>", LONG),
    ("title", f"<h1>Title</h1><div class='share'>Share</div><p>{LONG}</p>", f"Title {LONG}"),
    ("links", f"<p>{LONG}</p><p>The plain words that come before this <a href='/'>sentence that has a much longer link in it</a></p>", f"{LONG} The plain words that come before this sentence that has a much longer link in it"),
    ("svg", "<article><p>One <svg><path d='x'>icon<p>Two</p><p>Three <math>x</p><p>Four</p></article>", "One Two Three Four"),
    ("self-closed", "<article><p>One <svg/> two</p></article>", "One two"),
    ("never closed", "<article>" + "<svg>" * 50_000 + "<p>One</p></article>", "One"),
]


@pytest.mark.parametrize("name, page, text", ODD_PAGES)
def test_page_text_of_odd_pages(name, page, text):
    assert html_text.main_text(page) == text
