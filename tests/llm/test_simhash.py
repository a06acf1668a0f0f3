import random

import xxhash
from pyspark.sql import functions as F

from spoor.llm import common, simhash

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def changed(text, n, r=R):
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(VOCABULARY)
    return " ".join(words)


def brute_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, prints, near):
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near(prints[i], prints[j]):
                group[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def test_groups_match_brute_force(docs_of):
    base = prose(600)
    rows = [(i, changed(base, i % 4)) for i in range(40)] + [(100 + i, prose(60)) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "Ä b"), (203, "Ä b"), (204, "A B"), (205, "a b")]
    rows += [(206, "x " * 30_000)]
    prints = [brute_print(t) for _, t in rows]
    roots = brute_groups(rows, prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for (i, _), root in zip(rows, roots):
        least[root] = min(least.get(root, i), i)
    want = sorted((i, format(p, "016x"), least[r]) for (i, _), p, r in zip(rows, prints, roots))
    out = simhash.near_groups(docs_of(rows)).select("id", simhash.fingerprint_hex(), "component")
    assert sorted(map(tuple, out.collect())) == want


def test_null_ids_and_empty_table(docs_of):
    out = simhash.near_groups(docs_of([(None, "a b c d"), (7, "a b c d"), (None, "q r s t u")])).collect()
    assert sorted((str(r["id"]), str(r["component"])) for r in out) == [("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.near_groups(docs_of([])).count() == 0


def test_links_find_every_pair_within_radius(spark):
    r = random.Random(1)
    prints = {r.getrandbits(64) for _ in range(50)}
    for p in list(prints):
        for _ in range(4):
            q = p
            for b in r.sample(range(64), r.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.links_within(spark.createDataFrame([(p,) for p in signed], "fp long"))
    want = {
        frozenset((a, b)) for a in signed for b in signed
        if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    }
    assert {frozenset((x["a"], x["b"])) for x in got.collect()} == want


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (5, None)]
    got = dict(map(tuple, common.components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)} | {200: 200, 300: 200}
    assert got == want


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_of_each_keeps_one_of_near_copies_and_all_others(docs_of):
    r = random.Random(3)
    rows, groups = [], []
    for g in range(8):
        base = prose(200, r)
        ids = [g * 100 + i for i in range(6)]
        rows += [(ids[0], base)] + [(i, changed(base, 2, r)) for i in ids[1:]]
        groups.append(ids)
    apart = [(1000 + i, prose(120, r)) for i in range(30)]
    half = [(2000 + i, t + " " + prose(120, r)) for i, (_, t) in enumerate(apart[:10])]
    rows += apart + half + [(3000, None), (3001, ""), (3002, "  "), (apart[0][0], apart[0][1])]
    out = simhash.one_of_each(docs_of(rows))
    assert out.columns == docs_of([]).columns
    kept = [x["doc_id"] for x in out.collect()]
    assert len(kept) == len(set(kept))
    for ids in groups:
        assert [i for i in ids if i in kept] == ids[:1]
    assert {i for i, _ in apart + half} <= set(kept)
    assert [i for i in kept if i >= 3000] == [3000]
    assert simhash.one_of_each(docs_of([])).count() == 0


def test_wide_prints_of_similar_texts_are_near():
    r = random.Random(9)
    for _ in range(20):
        a = prose(150, r)
        b = changed(a, 2, r)
        x, y = simhash.fingerprint_wide(a), simhash.fingerprint_wide(b)
        bits = sum(bin(int(i) ^ int(j)).count("1") for i, j in zip(x, y))
        assert (bits <= simhash.WIDE_RADIUS) or jaccard(a, b) < 0.85
        assert sum(bin(int(i) ^ int(j)).count("1") for i, j in zip(x, simhash.fingerprint_wide(prose(150, r)))) > 100


def test_one_of_each_matches_brute_force_similarity(docs_of):
    r = random.Random(21)
    rows = []
    for g in range(150):
        base = prose(320, r)
        words = base.split(" ")
        # 3 to 11 single words replaced, far apart: similarity about 0.91 to 0.70
        for i in r.sample(range(8, 312, 8), 3 + g % 9):
            words[i] = "changed" + str(i)
        rows += [(2 * g, base), (2 * g + 1, " ".join(words))]
    near = [jaccard(rows[2 * g][1], rows[2 * g + 1][1]) >= 0.8 for g in range(150)]
    assert 40 < sum(near) < 110
    kept = {x["doc_id"] for x in simhash.one_of_each(docs_of(rows)).collect()}
    assert kept == {2 * g for g in range(150)} | {2 * g + 1 for g in range(150) if not near[g]}
