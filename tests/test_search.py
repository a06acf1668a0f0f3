"""Text search by the rarest piece against plain string tests."""

import random
import re

from pyspark.sql import functions as F

from spoor.operators import search as S

FENCE = "[\\s=\"'/\\\\]"


def lines_of(spark, texts):
    return spark.createDataFrame(
        [(f"f{n % 3}", n, t) for n, t in enumerate(texts)], "source_file string, line_no bigint, content string"
    )


def expected(keys, texts):
    out = set()
    for i, term, how in keys:
        low = term.lower()
        for n, t in enumerate(texts):
            if t is None:
                continue
            if how == "substring":
                hit = low in t.lower()
            else:
                edge = (r"\b", r"\b") if how == "word" else (f"(?:^|{FENCE})", f"(?:$|{FENCE})")
                hit = re.search(edge[0] + re.escape(low) + edge[1], t, re.I) is not None
            if hit:
                out.add((i, n))
    return out


def corpus():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "alphabet", "Grüße", "x1", "10.0.0.7", "cmd.exe", "C:\\Temp\\a.exe", "--", "::", "a_b", "the"]
    seps = [" ", "  ", "=", "/", "\\", ".", "\t", "|"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    keys = []
    for k in range(120):
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        term = t[a : a + rng.randint(1, 14)].strip() or "the"
        keys.append((k, term, rng.choice(["word", "substring", "delimited"])))
    keys += [(200, "nowhere", "word"), (201, "zz", "substring"), (202, "::", "substring"), (203, "ALPHA", "word"), (204, "--", "substring")]
    return keys, [*texts, None, ""]


def test_equals_plain_string_tests(spark, monkeypatch):
    keys, texts = corpus()
    lines = lines_of(spark, texts)
    table = S.anchored(spark.createDataFrame(keys, "i int, term string, how string"), "term", F.col("how"))
    want = expected(keys, texts)
    got = {(r["i"], r["line_no"]) for r in S.match_lines(table, lines).collect()}
    assert got == want
    monkeypatch.setattr(S, "fits", lambda *a: False)  # many anchors: pairs are shuffled
    again = [(r["i"], r["line_no"]) for r in S.match_lines(table, lines).collect()]
    assert set(again) == want and len(again) == len(want)


def test_a_key_is_found_by_its_rarest_piece(spark):
    texts = ["common words of all lines"] * 50 + ["common rare", "common unrarely", "rare"]
    keys = [(1, "common rare", "word"), (2, "mon rare", "substring"), (3, "of all", "word"), (4, "words of", "substring")]
    table = S.anchored(spark.createDataFrame(keys, "i int, term string, how string"), "term", F.col("how"))
    found = {}
    for r in S.anchors(table, lines_of(spark, texts)).collect():
        found.setdefault(r["_low"], set()).add(r["word"])
    counts = {w: sum(w in t.split() for t in texts) for t in texts for w in t.split()}
    # its rarest word; the words that begin with "rare" rather than those that end with "mon"
    assert found["common rare"] == {"rare"} and found["mon rare"] == {"rare"}
    assert sum(counts[w] for w in found["of all"]) == 50


def test_a_capped_search_moves_no_text(spark):
    keys = spark.createDataFrame([(1, "alpha", "word")], "finding_id int, term string, mode string")
    _, texts = corpus()
    plan = S.pivot_lines(keys, lines_of(spark, texts))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.splitlines()[0]
    files = S.file_ranks(spark, ["f0", "f1"])
    rows = S.pivot_search(keys, lines_of(spark, texts), files, 2, 3).orderBy("rank").collect()
    hits = [n for _, n in sorted(expected([(1, "alpha", "word")], texts), key=lambda p: (p[1] % 3, p[1])) if n % 3 < 2]
    first = [n for n in hits if n % 3 == 0][:2] + [n for n in hits if n % 3 == 1][:2]
    assert [r["line_no"] for r in rows] == first[:3] and all(r["content"] == texts[r["line_no"]] for r in rows)


def test_findings_that_share_a_text_are_joined_last(spark):
    keys, texts = corpus()
    lines = lines_of(spark, texts)
    rows = [(i % 7 if i % 2 else 1000 + i, term, "path" if how == "substring" else "word") for i, term, how in keys if how != "delimited"]
    rows += [(2000 + n, "alpha", "word") for n in range(50)]
    table = spark.createDataFrame(rows, "finding_id int, term string, mode string")
    want = expected([(i, t, "substring" if m == "path" else "word") for i, t, m in rows], texts)
    hits = S.pivot_hits(table, lines)
    got = [(r["finding_id"], r["line_no"], r["content"]) for r in hits.collect()]
    assert len(got) == len(want) and set(got) == {(i, n, texts[n]) for i, n in want}
    # lines of a finding with one key pass no shuffle after they met it
    one = S.pivot_hits(table.where("finding_id >= 1000"), lines)
    assert "Aggregate" not in one._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_keys_of_other_files_meet_no_line(spark):
    lines = lines_of(spark, ["PID=17 x2", "p27.exe", "PID=22", None])
    keys = S.anchored(
        spark.createDataFrame(
            [("17", "word", "f0"), ("22", "word", "f0"), ("22", "word", "f2"), ("2", "substring", "none"), ("7", "substring", "f1")],
            "term string, how string, source_file string",
        ), "term", F.col("how"),
    )
    hits = S.match_terms(keys, lines, ["source_file"]).select("source_file", "line_no", "_low")
    assert sorted(map(tuple, hits.collect())) == [("f0", 0, "17"), ("f1", 1, "7"), ("f2", 2, "22")]


def test_words_beyond_ascii(spark):
    rng = random.Random(3)
    odd = "aZ_9 -é ßİḰ‍‿  —日本、\U0001d7d8\U0001f600\n\x00"
    texts = ["".join(rng.choice(odd) for _ in range(40)) for _ in range(300)]
    both = lines_of(spark, texts).select(
        F.sort_array(S._line_pieces([])).alias("got"),
        F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(S.WORDS), F.lit(0)))).alias("want"),
    )
    assert both.where("got <> want").count() == 0


def test_queries_that_share_a_needle_meet_its_first_lines_only(spark, monkeypatch):
    asked = spark.createDataFrame(
        [(f"q{i}", "domain", "evil.example") for i in range(300)], "query_id string, entity_type string, entity_value string"
    )
    lines = spark.createDataFrame(
        [(f, i, f"seen evil.example at {i}") for f in ("b.txt", "a.txt") for i in range(200)],
        "source_file string, line_no long, content string",
    )
    ranked, rank = [], S.capped_rank
    monkeypatch.setattr(S, "capped_rank", lambda df, *a, **b: ranked.append(df.count()) or rank(df, *a, **b))
    got = S.entity_lookup(asked, lines, S.type_files(spark, {"domain": ["b.txt", "a.txt"]}), 3).collect()
    assert sorted((r["query_id"], r["source_file"], r["line_no"], r["rank"]) for r in got) == sorted(
        (f"q{i}", "b.txt", n, n + 1) for i in range(300) for n in range(3)
    )
    assert max(ranked) <= 300 * 2 * 3


def test_lines_are_made_distinct_only_where_a_finding_has_several_keys(spark):
    lines = lines_of(spark, ["alpha beta", "beta", "gamma alpha", "alpha"])
    keys = lambda rows: spark.createDataFrame(rows, "finding_id string, term string, mode string")
    found = lambda df: sorted((r.finding_id, r.line_no) for r in df.collect())
    numbers = [r.line_no for r in lines.orderBy("line_no").collect()]
    one = S.pivot_lines(keys([("f", "alpha", "word"), ("g", "beta", "word")]), lines)
    assert found(one) == sorted([("f", numbers[i]) for i in (0, 2, 3)] + [("g", numbers[i]) for i in (0, 1)])
    two = S.pivot_lines(keys([("f", "alpha", "word"), ("f", "beta", "word")]), lines)
    assert found(two) == [("f", n) for n in numbers]
    top = lambda df: df._jdf.queryExecution().optimizedPlan().nodeName()
    assert top(one) != "Aggregate" and top(two) == "Aggregate"
