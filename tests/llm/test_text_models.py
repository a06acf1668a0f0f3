import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spoor.llm import boosting, common, decontam, html_main, langid, quality

R = random.Random(21)
GOOD = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(2000)]
BAD = ["".join(R.choice("qrstuvwxyz") for _ in range(R.randint(2, 9))) for _ in range(300)]


def prose(n, words=GOOD, r=R):
    return " ".join(r.choice(words) for _ in range(n))


def test_held_out_rows_follow_crc32(spark):
    ids = [*range(-3, 200), 10**12]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", common.held_out(F.col("i")))
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.collect())


def test_quality_held_out_accuracy(spark, docs_of):
    rows = [(i, prose(R.randint(3, 80)) if i % 4 else R.choice([prose(40, BAD), prose(20).upper() + "!!"])) for i in range(400)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where("doc_id < 300"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 > 0) for i in range(300, 400)]) >= 0.97


def test_quality_edge_rows(spark, docs_of):
    model = quality.train([prose(20) for _ in range(30)] + [prose(20, BAD) for _ in range(30)], [1] * 30 + [0] * 30)
    odd = [None, "", " ", "a", "\u0000", "word " * 100_000, prose(10)]
    got = quality.score(docs_of(list(enumerate(odd)) + [(6, odd[6])]), model).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 6}) == 1
    assert quality.score(docs_of([]), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs_of([(1, "x")]), none).score("x") == 0.5
    clash = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.fit(docs_of([(1, "x"), (2, "y"), (None, "z")]), clash).score("x") == 0.5


def test_word_hashes_depend_on_the_word_alone():
    a, b = quality.features("alpha beta"), quality.features("gamma alpha  beta ")
    assert set(a.tolist()) & set(b.tolist())
    assert decontam.words_of("Alpha, beta!").tolist() == decontam.words_of("x alpha\nBETA y")[1:3].tolist()


def languages(n, seed):
    r = random.Random(seed)
    words = {"aa": ["kala", "mana", "tola"], "bb": ["schti", "brung", "zwerf"], "cc": ["été", "œuvre", "ça"]}
    return [(i, prose(r.randint(1, 30), words[k], r), k) for i, k in enumerate(r.choice(sorted(words)) for _ in range(n))]


def test_language_held_out_accuracy_and_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred string"
    rows = languages(300, 1)
    train = spark.createDataFrame([(*r, "x", "x") for r in rows[:200]] + [(900, None, "aa", "", ""), (901, "kala", None, "", "")], schema)
    langs, logs = langid.fit(train)
    assert langs == ["aa", "bb", "cc"]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 .. !", "aa"), (1003, "kala " * 50_000, "aa"), (1004, "KALA", "aa"), (1004, "KALA", "aa")]
    test = spark.createDataFrame([(*r, "x", "x") for r in rows[200:] + odd], schema)
    out = langid.predict(test, langs, logs)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = out.collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] not in (1000, 1001, 1002))
    assert [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert len(got) == len(rows[200:]) + 6 and all(0 <= r["score"] <= 1 for r in got)
    empty_langs, empty = langid.fit(test.where("false"))
    assert empty_langs == [] and {r["lang_pred"] for r in langid.predict(test, [], empty).collect()} == {"und"}


def brute_leaks(items, text):
    words = lambda s: re.findall(r"[a-z0-9\x80-\U0010ffff]+", s.lower())
    w, found = words(text or ""), set()
    for item, t in items:
        q = words(t or "")
        if not q:
            continue
        k, n = min(5, len(q)), len(q)
        want = Counter(tuple(q[i : i + k]) for i in range(n - k + 1))
        for s in range(max(1, len(w) - n + 1)):
            win = w[s : s + n]
            got = Counter(tuple(win[i : i + k]) for i in range(len(win) - k + 1))
            if sum((want & got).values()) >= 0.8 * sum(want.values()):
                found.add(item)
                break
    return found


def test_leaks_match_brute_force(spark, docs_of):
    r = random.Random(4)
    items = [(i, prose(r.choice([3, 5, 12, 30, 31, 60]), GOOD, r)) for i in range(60)] + [(70, None), (71, ""), (72, "x x x x x x x")]
    rows = []
    for i in range(60):
        words = items[i][1].split(" ")
        if i % 3 == 1 and len(words) > 20:
            words[r.randrange(len(words))] = "changed"
        if i % 3 == 2 and len(words) > 20:
            words[::4] = ["other"] * len(words[::4])
        rows.append((i, prose(80, GOOD, r) + ", " + " ".join(words).upper() + ". " + prose(40, GOOD, r)))
    rows += [(100 + i, prose(150, GOOD, r)) for i in range(10)]
    rows += [(200, None), (201, ""), (202, items[3][1]), (202, items[3][1]), (203, "x " * 30_000)]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows)
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, table).collect()}
    want = {(i, q) for i, t in rows for q in brute_leaks(items, t)}
    assert got == want and len(want) > 30
    small = decontam.leaks(docs, table, block_words=100)
    blocks = docs.select("doc_id", F.explode(small).alias("f")).select("doc_id", "f.item_id")
    assert {tuple(x) for x in blocks.collect()} == want
    kept = decontam.clean(docs, table)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.clean(docs, table.where("false")).count() == len(rows)
    assert decontam.contaminated(docs_of([]), table).count() == 0


def test_leaks_in_another_order_and_in_other_scripts(spark, docs_of):
    r = random.Random(17)
    words = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    item, around = words(60), words(400)
    chinese = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(80))
    quoted = [f"\u201c{w}\u201d" if i % 4 == 0 else w for i, w in enumerate(item)]
    items = [(1, " ".join(item)), (2, chinese), (3, None), (4, "\u201c\u2026\u201d")]
    rows = [
        (1, " ".join(around[:200] + item[30:] + item[:30] + around[200:])),  # halves swapped
        (2, " ".join(around[:90] + quoted + around[90:])),
        (3, "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(50)) + chinese + "\u3002" + "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(50))),
        (4, " ".join(around)), (5, "\u2026 \u201c\u201d"), (6, None),
        (7, " ".join(w for w in item for _ in range(9))),  # every word nine times: no shingle
        (8, " ".join(around * 300 + item)),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs_of(rows), table).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (8, 1)}


def test_radius_is_guaranteed_by_the_tables():
    r = random.Random(8)
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        parts = zip(a.to_bytes(8, "little"), b.to_bytes(8, "little"))
        assert any(bin(x ^ y).count("1") <= decontam.BALL for x, y in parts)


def test_boosting_learns_and_is_steady():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = np.where(x[:, 0] * x[:, 1] > 0, 2, (x[:, 2] > 0).astype(int))
    a, b = (boosting.Boosted(3, rounds=30, depth=4, share=1.0).fit(x[:1000], y[:1000]) for _ in range(2))
    p = a.log_p(x[1000:])
    assert (p.argmax(1) == y[1000:]).mean() > 0.9
    assert np.allclose(np.exp(p).sum(1), 1) and np.array_equal(p, b.log_p(x[1000:]))


def test_dom_keeps_text_through_broken_markup():
    page = """<body><p>one <b>two<br><p>three &amp; four<!-- x <p>no</p> --><script>if (a<b) "</p>"</script>
      <ul><li>five<li>six</ul><td>seven</p>eight < 9<style>p{}</style><a href='>'>ten</a>"""
    leaves = [html_main.clean(n.text) for n in html_main.listed(html_main.parse(page)) if n.text is not None]
    assert leaves == ["one two", "three & four", "five", "six", "seven", "eight < 9ten"]
    assert html_main.listed(html_main.parse(None)) == [] == html_main.listed(html_main.parse("<div> </div>"))


def test_decoding_never_contradicts_an_ancestor():
    page = "<div><p>a b</p><div><p>c</p><p>d</p></div></div><p>e</p>"
    nodes = html_main.listed(html_main.parse(page))
    rng = np.random.default_rng(1)
    for _ in range(200):
        p = np.log(rng.dirichlet([0.3] * 3, len(nodes)))
        kept = html_main.decode(nodes, p)
        assert not any(k for n, k in zip(nodes, kept) if n.text is None)
        inner = [k for n, k in zip(nodes, kept) if n.text is not None][1:3]
        assert len(kept) == len(nodes) and all(isinstance(bool(k), bool) for k in inner)


def test_main_text_of_made_pages_and_edges(spark):
    texts = [prose(R.randint(20, 200)) + "." for _ in range(200)]
    model = html_main.train(texts, pages=300)
    maker, score = html_main.Maker(texts, seed=99), []
    for _ in range(80):
        page = maker.page()
        nodes = html_main.listed(html_main.parse(page))
        want = {html_main.clean([t.replace(maker.SIGN, "") for t in n.text]) for n in nodes
                if n.text is not None and any(maker.SIGN in t for t in n.text)} - {""}
        got = set(html_main.extract([page.replace(maker.SIGN, "")], model)[0].split("\n")) - {""}
        score.append(2 * sum(map(len, want & got)) / max(1, sum(map(len, want)) + sum(map(len, got))))
    assert np.mean(score) > 0.93
    article = "<html><body><nav><a href='/'>home</a></nav><article><h1>T</h1>" + "<p>%s</p>" * 3 % tuple(texts[:3]) + "</article><footer>&copy; us</footer></body></html>"
    rows = [(1, article), (1, article), (2, None), (3, ""), (4, "<html></html>"), (5, "<p>" + "w " * 200_000)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, html string, text string, h string")
    got = [(r["page_id"], r["text"]) for r in html_main.main_text(df, model).collect()]
    assert got[0] == got[1] == (1, "\n".join(["T", *texts[:3]]))
    assert [t for i, t in got if i in (2, 3, 4)] == ["", "", ""]
    assert html_main.main_text(df.where("false"), model).count() == 0
    assert html_main.fit(df.where("page_id > 1 AND page_id < 5")) is not None
