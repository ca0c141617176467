"""Token alignment, ranked lexical search and nearest vectors against brute force."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import jobs, learned_partitions, lexical_search, oracles, token_alignment

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, n_a int, a_ids string, id string"
TEXTS = [
    "plain words, 123 and  two blanks", None, "", " ", "\n\t x \r\n", "naïve café – 東京 😀👍🏽 é", "<|endoftext|> <s></s><unk>", "▁ cut", "-" * 500,
    "plain words, 123 and  two blanks", "aaaa" * 3000, "\x00\x7f​ end", "don't we'll I'm x",
]


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=token_alignment.PIECES)
    alphabet = token_alignment._byte_alphabet()
    made = []
    for text in texts:
        whole = f" {text or ''}".encode()
        ids_a, ids_b = a.encode(f" {text or ''}", add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            made.append([])
            continue
        groups, one, other, end_a, end_b = [], [], [], 0, 0
        left, right = list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))
        while left or right:
            if left and end_a <= end_b:
                i, t = left.pop(0)
                one.append(i)
                end_a += len(t)
            else:
                i, t = right.pop(0)
                other.append(i)
                end_b += len(t)
            if end_a == end_b:
                groups.append((one, other))
                one, other = [], []
        made.append(groups)
    return made


@pytest.mark.parametrize("block,large", [(token_alignment.BLOCK_LINKS, token_alignment.LARGE_GROUP), (5, 1)])
def test_link_statistics_equal_brute_force(spark, monkeypatch, block, large):
    monkeypatch.setattr(token_alignment, "BLOCK_LINKS", block)
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", large)
    rows = [(i if i != 3 else None, t, 1, "x", "y") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1, "x", "y")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    groups = brute_alignment([r[1] for r in rows])
    links = [[(x, y) for one, other in g for x in one for y in other] for g in groups]
    held = collections.Counter(p for doc in links for p in set(doc))
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = []
    for r, g, doc in zip(rows, groups, links):
        written = ";".join(f"{','.join(map(str, one))}|{','.join(map(str, other))}" for one, other in g)
        want.append((r[0], sum(len(o) for o, _ in g), sum(len(o) for _, o in g), len(g), len(doc), sum(held[p] == best[p[0]] for p in doc),
                     sum(held[p] for p in doc), hashlib.sha256(written.encode()).hexdigest() if g else ""))
    got = [tuple(r) for r in token_alignment.link_statistics(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_alignment.link_statistics(df.limit(0)).count() == 0


def test_spans_cut_both_lists(spark):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(TEXTS)], DOCS)
    got = {r.doc_id: r for r in token_alignment.align_tokens(df).collect()}
    assert len(got) == len(TEXTS)
    for i, groups in enumerate(brute_alignment(TEXTS)):
        r = got[i]
        cuts = list(zip([0, *r.a_cuts], r.a_cuts, [0, *r.b_cuts], r.b_cuts))
        assert [(r.a_ids[a:b], r.b_ids[c:d]) for a, b, c, d in cuts] == groups


def test_ranks_give_the_ids_of_the_file():
    pair = token_alignment._pair(token_alignment.BYTE_LEVEL, token_alignment.PIECES)
    assert pair.ranked is not None
    for first in range(0, 0x30000, 64):
        text = " ".join(f"a{chr(c)}1{chr(c)}" for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        assert pair.ranked.encode_ordinary(text) == pair.a.encode(text, add_special_tokens=False).ids


def brute_search(docs, items, wanted):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, collections.Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    made = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        made += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:wanted], 1)]
    return made


@pytest.mark.parametrize("block_docs,item_terms,first", [(32_768, 1_000_000, 64), (4, 400, 1)])
def test_ranking_equals_brute_force(spark, monkeypatch, block_docs, item_terms, first):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", item_terms)
    monkeypatch.setattr(lexical_search, "FIRST_MASKS", first)
    rng = random.Random(3)
    words = ["Ä", "ä", "Zoë", "a1", "A1", "it's", "x-y", "naïve", "東京", *(f"w{i}" for i in range(90))]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60)))) for i in range(70)]
    docs += [(None, docs[5][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "... !"), (903, "w1 " * 5000), (904, docs[5][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 80, 120])))) for i in range(12)] + [(3, "w1 w1 w2"), (None, "w2"), (70, None), (71, "nowhere"), (72, "")]
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id bigint, text string, rank int, item_id string, score string").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    got = [tuple(r) for r in lexical_search.rank_documents(df, asked).collect()]
    assert sorted(got, key=repr) == sorted(brute_search(docs, items, 10), key=repr)
    assert lexical_search.rank_documents(df.limit(0), asked).count() == 0
    assert lexical_search.rank_documents(df, asked.limit(0)).count() == 0


def test_masks_that_cannot_win_are_not_scored():
    n = 4000
    rng = np.random.default_rng(0)
    term = np.repeat(np.arange(8), n // 2)
    docs = np.concatenate([np.sort(rng.choice(n, n // 2, replace=False)) for _ in range(8)])
    block = lexical_search.Block(np.full(n, 40), docs, term, np.ones(len(docs), np.int64), n, 40 * n)
    question = lexical_search.Question(np.arange(8, dtype=np.uint64), np.arange(8, dtype=np.uint64), np.array([5000, 10, 10, 10, 10, 10, 10, 10]))
    found, scores = block.best(question, 10, 0)
    assert len(found) == 10 and (np.diff(scores) <= 0).all()
    assert len(block.best(question, 10, int(scores[0]) + 1)[0]) == 0


def test_search_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(oracles.statements()["op13_lexical_search"])
    columns = [d[0] for d in want.description]
    got = jobs.op13_lexical_search(spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def brute_nearest(rows, k):
    good = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 4]
    made = collections.Counter()
    for n, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            scored = []
            for m, (j, u) in enumerate(good):
                if m != n:
                    total = 0.0
                    for a, b in zip(v, u):
                        total += float(np.float32(a)) * float(np.float32(b))
                    scored.append((-total, j is None, j or 0, j))
            for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
                made[i, rank, s[3], -s[0]] += 1
    return made


def test_few_vectors_are_found_exactly(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(70)]
    rows += [(0, rows[0][1]), (60, rows[0][1]), (None, rows[1][1]), (200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 1.0, 1.0]),
             (204, [float("nan"), 1.0, 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0, 1.0]), (220, [1.0, 2.0]), *[(300 + i, rows[2][1]) for i in range(50)]]
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "vec_id bigint, embedding array<float>, rank int, part string, score double")
    got = collections.Counter(tuple(r) for r in learned_partitions.search(df.repartition(3), F.col("vec_id") % 20 == 0, 7).collect())
    assert got == brute_nearest(rows, 7)
    assert learned_partitions.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert learned_partitions.search(df.where("vec_id > 200 and vec_id < 206"), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_are_balanced_and_routing_reaches_the_recall(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "SHELF_ROWS", 300)
    monkeypatch.setattr(learned_partitions, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(24, 16))
    x = (centres[rng.integers(0, 24, 1600)] + 0.25 * rng.normal(size=(1600, 16))).astype(np.float32)
    graph = learned_partitions.neighbour_graph(x, 10)
    part = learned_partitions.balanced_parts(x, graph, 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(learned_partitions.SLACK * 200)
    # fewer edges leave their part than under equal cuts alone
    cut = lambda p: (p[graph] != p[:, None]).mean()
    assert cut(part) < cut(learned_partitions._halves(x, 8))
    seen = {}

    made = learned_partitions.Router.__init__

    def watched(self, *given):
        made(self, *given)
        seen.update(parts=self.parts, probes=self.probes, shelves=self.shelves)

    monkeypatch.setattr(learned_partitions.Router, "__init__", watched)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in learned_partitions.search(df, F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert seen["parts"] >= 2 and seen["probes"] < seen["parts"] and seen["shelves"] > 1
    hits = 0
    for i in range(0, 1600, 20):
        near = x.astype(float) @ x[i].astype(float)
        near[i] = -np.inf
        hits += len({j for j, _ in got[i]} & set(np.argsort(-near)[:10].tolist()))
        assert len(got[i]) == 10 and [s for _, s in got[i]] == sorted((s for _, s in got[i]), reverse=True)
    assert hits >= 0.9 * 10 * 80


def test_recall_on_the_sample_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = collections.defaultdict(set)
    for r in jobs.op11_nearest_vectors(spark, "/root/testdata/sf0.1").collect():
        found[r.query_id].add(r.vec_id)
    hits, asked = 0, np.flatnonzero(ids % 20 == 0)
    for i in asked:
        near = x @ x[i]
        near[i] = -np.inf
        hits += len(found[ids[i]] & set(ids[np.lexsort((ids, -near))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(asked)
