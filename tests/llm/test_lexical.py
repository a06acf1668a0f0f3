"""Ranked search against scores of every document, and bounds of pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spoor.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(SMALL))


def expected(docs, items, k):
    read = [(i, Counter(words(t))) for i, t, *_ in docs]
    read = [(i, c, sum(c.values())) for i, c in read if c]
    total = sum(n for _, _, n in read)
    df = Counter(t for _, c, _ in read for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c, n in read:
            m = 100 - 50 + (50 * n * len(read)) // total
            s = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * len(read) + 2) / (2 * df[t] + 1)))
                s += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else i, -s))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "中文", "Ab", "aB", "１"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n)) + rng.choice(["", ".", "\0", "\n-_"])
    docs = [(i, text(rng.randint(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(120)]  # more ties than results
    docs += [(None, docs[3][1]), (7, "w1 w2"), (7, "w1 w2"), (2000, None), (2001, ""), (2002, " .-\t"), (2003, "w59 " * 30_000)]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)] + [(30, None), (31, "?"), (32, "unseen"), (33, docs[3][1])]
    return docs, [*items, (34, "w1"), (34, "w5 w1"), (None, "w3 w4"), (35, "w0")]


@pytest.mark.parametrize("k, shard, block", [(5, 16_384, 1 << 20), (5, 37, 200), (50, 100, 900)])
def test_equals_scores_of_all_documents(spark, docs_of, k, shard, block):
    docs, items = corpus()
    queries = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, id string, rank int")
    found = lexical.ranked(docs_of(docs).repartition(3), queries, k, shard_docs=shard, block_bytes=block)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(docs, items, k)


def test_empty_tables(spark, docs_of):
    queries = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked(docs_of([]), queries).count() == 0
    assert lexical.ranked(docs_of([(1, None)]), queries).count() == 0
    assert lexical.ranked(docs_of([(1, "w1")]), queries.limit(0)).count() == 0


class Watched(lexical.Postings):
    read = 0

    def joined(self, terms_of):
        found = super().joined(terms_of)
        self.read += sum(len(self.of(t)[0]) for t in terms_of)
        return found


def shard_of(rng, n_docs, n_terms):
    """Random postings; the two terms of each pair mostly stand in different documents."""
    at, impact, df = [], [], []
    for term in range(n_terms):
        docs = np.flatnonzero(rng.random(n_docs) < 0.4 / (1 + term // 2))
        docs = docs[docs % 2 == term % 2] if term < n_terms - 2 else docs
        at.append(docs)
        impact.append(rng.integers(1, 1000, len(docs)))
        df.append(len(docs))
    row = {"lengths": np.ones(n_docs), "terms": np.arange(n_terms), "df": np.array(df), "at": np.concatenate(at).astype(np.int32),
           "impact": np.concatenate(impact)}
    return Watched(row, rng.integers(1, 50, n_terms))


def test_pairs_skip_more_than_single_maxima():
    rng = np.random.default_rng(1)
    saved = 0
    for _ in range(30):
        held = shard_of(rng, 3000, 8)
        tops, pairs = held.tops(), [(0, 1), (2, 3), (4, 5), (6, 7)]
        docs, sums = held.joined(range(8))
        want = sorted(zip(-sums, docs))[:10]
        bounds, best = {}, {}
        for u in pairs:
            docs, sums = held.joined(u)
            top = np.argsort(-sums)[:10]
            bounds[u], best[u] = int(sums[top[0]]), docs[top]
            assert max(tops[t] for t in u) <= bounds[u] <= sum(tops[t] for t in u)
        reads = []
        for known in (bounds, {u: sum(tops[t] for t in u) for u in pairs}):
            held.read = 0
            docs, scores = lexical.search_shard(held, pairs, tops, known, best, 1, 10)
            reads.append(held.read)
            assert sorted(zip(-scores, docs))[:10] == want
        saved += reads[0] < reads[1]
        assert reads[0] <= reads[1]
    assert saved
