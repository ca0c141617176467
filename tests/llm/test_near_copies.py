"""Near copies, line dedup, leaks and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from adlens.llm import decontaminate, line_dedup, near_texts, simhash
from adlens.llm.components import connected_components
from adlens.llm.tokens import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, text_hash bigint"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstué") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def documents(seed=1):
    """Texts with copies, near copies, shared lines, odd cases, repeated rows and NULLs."""
    rng = random.Random(seed)
    words = vocabulary(300, seed)
    texts = ["", " \n\t", None, "One", "one  two", "ONE TWO", "x " * 500, "y" * 3000]
    for _ in range(25):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(rng.randint(1, 5))]
        texts.append("\n".join(lines))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = [line.split() for line in lines]
            line = rng.choice(copy)
            line[rng.randrange(len(line))] = rng.choice(words)
            texts.append("\n".join(" ".join(x) for x in copy))
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), "clash", 7) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (None, texts[9], None, None, None, None, None), (None, "none", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3)


def reference_fingerprint(text):
    words = WORD.findall(low(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_match_brute_force(spark, docs):
    rows = documents()
    prints = [reference_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 10**9), r[0])
    want = sorted(((r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints))), key=repr)
    got = sorted((tuple(r) for r in simhash.near_copies(docs).collect()), key=repr)
    assert got == want
    kept = [r.doc_id for r in simhash.drop_near_copies(docs).collect()]
    assert len(kept) == len({find(i) for i in range(len(rows))})
    assert set(x for x in kept if x is not None) == set(least.values())


@pytest.mark.parametrize("bucket", [4, 256])
def test_links_are_complete_in_crowded_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = set()
    for _ in range(300):
        x = int(base[rng.integers(4)])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_thresholds_add_up_and_are_cheapest():
    rng = np.random.default_rng(3)
    cost = np.sort(rng.random((50, 4, 5)).astype(np.float32) * 100, axis=2)
    got = simhash.allocate(cost)
    assert (got.sum(axis=1) == simhash.TAU - simhash.PARTS + 1).all()
    options = [t for t in np.ndindex(5, 5, 5, 5) if sum(t) == 4]
    for row, thresholds in zip(cost, got):
        spent = sum(row[i, t + 1] for i, t in enumerate(thresholds))
        assert spent == pytest.approx(min(sum(row[i, e] for i, e in enumerate(t)) for t in options), rel=1e-5)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_words_whose_hashes_agree_in_the_upper_half_are_told_apart(monkeypatch):
    hashes = np.array([5, 9, 5, 9, 5, 9, 5, 7 << 40], dtype=np.uint64) + np.uint64(1 << 60)
    monkeypatch.setattr(line_dedup, "word_hashes", lambda data: (np.array([0, 2, 4, 6, 8, 10, 12, 14]), hashes))
    for levels in (None, np.zeros(1 << line_dedup.SLOT_BITS, dtype=np.uint16)):
        lines = line_dedup.Lines([b"a b a b a\nb a c"], levels)
        assert lines.size.tolist() == [2, 3]
        assert [sorted(x.tolist()) for x in np.split(lines.words, lines.begin[1:])] == [sorted(set(hashes[:5].tolist())), sorted(set(hashes[5:].tolist()))]


def removed_by_brute_force(rows):
    places = []
    for r in rows:
        for k, line in enumerate((r[1] or "").split("\n")):
            words = frozenset(WORD.findall(low(line)))
            if words:
                places.append((r[0] is None, r[0] if r[0] is not None else 0, r[1], k, words))
    gone = {}
    for last, i, text, k, words in places:
        for other in places:
            shared = len(words & other[4])
            # texts of one id are ordered by a hash, so the fixture gives an id one text only
            if shared >= 0.8 * (len(words) + len(other[4]) - shared) and (other[0], other[1], other[3]) < (last, i, k) and (
                (other[1], other[2]) == (i, text) or (other[0], other[1]) != (last, i)
            ):
                gone.setdefault((last, i, text), set()).add(k)
    return gone


@pytest.mark.parametrize("common", [1_000_000, 40, 2])
def test_line_dedup_matches_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(line_dedup, "COMMON", common)
    rows = [r for r in documents(2) if r[0] is not None]
    gone = removed_by_brute_force(rows)
    want = sorted((r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get((False, r[0], r[1]), ()))) for r in rows)
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, DOCS).repartition(3))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_links_of_lines_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in documents(4)] + [(500, "a b c d e\nE d c b a\na  b c d e"), (501, "e a b c d"), (None, "e a b c d\n\nf")]
    lines = [(i, frozenset(WORD.findall(low(x)))) for i, r in enumerate(rows) for x in (r[1] or "").split("\n")]
    lines = [x for x in lines if x[1]]
    want = [0] * len(rows)
    for at, (i, x) in enumerate(lines):
        want[i] += sum(len(x & y) >= 0.8 * len(x | y) for k, (_, y) in enumerate(lines) if k != at)
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), counts=True)
    # rows with equal id and text are told apart by nothing, so each shows the links of all of them
    alike = {}
    for r, n in zip(rows, want):
        alike[r] = alike.get(r, 0) + n
    got = sorted(((r.doc_id, r.n_links) for r in out.collect()), key=repr)
    assert got == sorted(((r[0], alike[r]) for r in rows), key=repr) and max(want) > 9


@pytest.mark.parametrize("words", [2, 3])
def test_removal_is_the_same_with_and_without_counted_links(spark, monkeypatch, words):
    # chains of small changes: many sets match an earlier one, but not the leader of their group
    monkeypatch.setattr(line_dedup, "LEAST_WORDS", words)
    rng, words = random.Random(11), vocabulary(300, 11)
    rows = []
    for g in range(6):
        line = rng.sample(words, 24)
        for i in range(40):
            line[rng.randrange(24)] = rng.choice(words)
            rows.append((rng.randrange(10**6), " ".join(line) + "\n" + " ".join(rng.choices(words, k=12))))
    rows += [(None, rows[0][1]), (None, None), (1, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = line_dedup.drop_repeated_lines(table, counts=True)
    got = line_dedup.drop_repeated_lines(table)
    assert sorted(got.collect(), key=repr) == sorted(want.select("doc_id", "text").collect(), key=repr)
    assert want.where("n_links > 0 and n_removed = 0").count() > 0 and want.where("n_removed > 0").count() > 50


def test_word_hashes_cut_long_texts_anywhere(monkeypatch):
    from adlens.llm import tokens

    data = (" ".join(vocabulary(2000, 4)) + " " + "w" * 500 + "  END\n").encode()
    starts, hashes = word_hashes(data)
    monkeypatch.setattr(tokens, "PIECE", 64)
    again = word_hashes(data)
    assert (again[0] == starts).all() and (again[1] == hashes).all()
    assert len(hashes) == len(data.split()) and len(set(hashes.tolist())) == len(set(data.lower().split()))


def test_leaks_with_replaced_words(spark):
    rng = random.Random(8)
    words = vocabulary(500, 8)
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([6, 13, 20, 40])] + [(4, None), (5, "too short")]
    docs, want = [], set()
    for i in range(60):
        body = rng.choices(words, k=120)
        if i % 3 == 0:
            item = items[i % 4]
            leak = item[1].split()
            if len(leak) >= 13 and i % 2:
                leak[rng.randrange(len(leak))] = "replaced"
            at = rng.randrange(100)
            body[at:at] = [w.upper() + "," for w in leak]
            want.add((i, item[0]))
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()]
    assert set(got) == want | {(102, 3)} and got.count((102, 3)) == 2
    clean = [r.doc_id for r in decontaminate.drop_leaks(d, b).collect()]
    assert sorted(clean) == sorted(i for i, _ in docs if i not in {x for x, _ in want} and i != 102)
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0 and decontaminate.drop_leaks(d, b.limit(0)).count() == len(docs)


def test_masks_hit_every_overlap_that_counts():
    def hit(n, replaced, masks):
        for mask in masks:
            counted = [i for i, c in enumerate(mask) if c == "1"]
            if any(replaced.isdisjoint(k + i for i in counted) for k in range(n - len(mask) + 1)):
                return True
        return False

    # 26 words and more hold a stretch of 13 to 25 words with the same share or a better one
    for n in range(decontaminate.SHORTEST_ITEM, 2 * decontaminate.LEAST_WORDS):
        masks = decontaminate.MASKS + (decontaminate.SHORT_MASKS if n < decontaminate.LEAST_WORDS else ())
        for replaced in itertools.combinations(range(n), n // 5):
            assert hit(n, set(replaced), masks), (n, replaced)


def leaks_by_brute_force(docs, items):
    """(document, item, first word, words, equal words) of the best place, every item laid at every place."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for doc_id, text in docs:
        words = split(text)
        for item_id, item_text in items:
            item, best = split(item_text), None
            if len(item) < 5:
                continue
            need = min(13, len(item))
            for start in range(-len(item) + 1, len(words)):
                a, b = max(0, start), min(len(words), start + len(item))
                equal = [words[i] == item[i - start] for i in range(a, b)]
                spans = [(a, b)] if sum(equal) >= 0.8 * len(equal) else [
                    (a + x, a + y) for x in range(len(equal)) for y in range(x + need, len(equal) + 1) if sum(equal[x:y]) >= 0.8 * (y - x) - 1e-9
                ]
                spans = [(x, y) for x, y in spans if y - x >= need]
                if spans:
                    x, y = max(spans, key=lambda p: (p[1] - p[0], -p[1]))
                    seen = (sum(equal[x - a : y - a]), -x, y - x)
                    best = seen if best is None or seen[:2] > best[:2] else best
            if best:
                out.append((doc_id, item_id, -best[1], best[2], best[0]))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(31)
    words = vocabulary(400, 31)
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([5, 7, 10, 13, 14, 15, 16, 20, 25, 31, 60])]
    items += [(50, items[9][1]), (51, None), (52, "")]
    docs = [(200, None), (201, ""), (202, "w " * 400)]
    for i in range(110):
        body = rng.choices(words, k=rng.choice([0, 30, 60]))
        leak = items[i % 11][1].split()
        for at in rng.sample(range(len(leak)), rng.randint(0, len(leak) // 4 + 1)):
            leak[at] = rng.choice(words)
        # now and then a part of the item only, and the same text twice
        leak = leak[: rng.choice([len(leak), len(leak), 13, 14])]
        at = rng.randrange(len(body) + 1)
        body[at:at] = leak
        docs += [(i, " ".join(body))] * (1 + (i % 40 == 0))
    want = sorted(leaks_by_brute_force(docs, items))
    # columns with the names of the result are not looked at
    table = spark.createDataFrame([(*d, "clash", -1) for d in docs], "doc_id bigint, text string, item_id string, first_word int").repartition(3)
    given = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.find_leaks(table, given).collect())
    assert got == want and 40 < len(want) < 110 + 20
    clean = sorted(r.doc_id for r in decontaminate.drop_leaks(table, given).collect())
    assert clean == sorted(d for d, _ in docs if d not in {w[0] for w in want})


def test_leaks_in_a_very_long_text_and_without_ids(spark):
    rng = random.Random(5)
    words = vocabulary(3000, 5)
    leak = " ".join(rng.choices(words, k=20))
    long = rng.choices(words, k=400_000)
    long[399_000:399_000] = leak.split()
    docs = spark.createDataFrame([(None, " ".join(long)), (None, leak), (None, None), (1, leak)], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, leak), (3, leak)], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.first_word) for r in decontaminate.find_leaks(docs, items).collect()), key=repr)
    assert got == sorted([(d, i, at) for d, at in [(None, 399_000), (None, 0), (1, 0)] for i in (None, 3)], key=repr)
    assert [tuple(r) for r in decontaminate.drop_leaks(docs, items).collect()] == [(None, None)]


def test_pipeline_on_odd_rows_and_empty_tables(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 4 > 0, 0) for i in range(30)], "doc_id bigint, q boolean, toxic int").select(
        "doc_id", F.col("q").cast("int").alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "one two three four five six")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept.columns, stage(spark, kept, str(tmp_path))
        assert kept.columns[: len(before)] == before or name == "mixing sources"
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        kept = spark.createDataFrame(kept.collect(), kept.schema)
    assert kept.count() > 0 and "copies" in kept.columns


def runs_of_five(text):
    words = WORD.findall(low(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_rows():
    """Long texts with one to eight replaced words, and the odd rows of documents()."""
    rng = random.Random(17)
    words = vocabulary(2000, 17)
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(30, 200))
        texts.append(" ".join(base))
        for n in (1, 2, 4, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), n):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy).upper() if n == 2 else "\n".join(copy))
    return documents() + [(1000 + i, t, "en", "a", len(t), "clash", 7) for i, t in enumerate(texts)]


def test_near_copies_of_the_pipeline_match_brute_force(spark):
    rows = near_rows()
    sets = [runs_of_five(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                far += bin(reference_fingerprint(rows[i][1]) ^ reference_fingerprint(rows[j][1])).count("1") > simhash.TAU
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**9), 10**9 if r[0] is None else r[0])
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()]
    assert far > 20
    assert sorted(10**9 if x is None else x for x in kept) == sorted(least.values())
    assert near_texts.drop_near_copies(spark.createDataFrame([], DOCS)).count() == 0
