import random

from spoor.llm import winnow

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 8))) for _ in range(3000)]


def prose(n):
    out = []
    while n > 0:
        k = min(n, R.randint(3, 11))
        out.append(" ".join(R.choice(WORDS) for _ in range(k)) + R.choice([".", ".", ",", ".\n"]))
        n -= k
    return " ".join(out)


def result(df):
    return {r["doc_id"]: r["text"] for r in winnow.drop_repeats(df).collect()}


def test_later_passages_go_and_first_stay(docs_of):
    passage = prose(70)
    rows = [(i, prose(60) + " " + passage + " " + prose(60)) for i in range(1, 6)]
    clean = [(i, prose(200)) for i in range(10, 16)]
    got = result(docs_of(rows + clean))
    assert got[1] == rows[0][1]
    lines = [x.strip() for x in passage.replace("\n", " ").split(". ") if len(x.split()) > 3]
    for i, text in rows[1:]:
        assert 120 <= len(got[i].split()) <= 120 + 25
        assert sum(x in got[i] for x in lines[1:-1]) == 0
        assert got[i].startswith(" ".join(text.split(" ")[:40]))
    for i, text in clean:
        assert got[i] == text


def test_copies_become_empty_and_short_repeats_stay(docs_of):
    copy = prose(120)
    line = "one short line of boilerplate.\n"
    got = result(docs_of([(1, copy), (2, copy), (3, line + prose(40)), (4, line + prose(40)), (5, copy.upper())]))
    assert got[1] == copy and got[2] == "" and got[5] == ""
    assert got[3].startswith(line) and got[4].startswith(line)


def test_repeats_inside_one_text(docs_of):
    passage = prose(60) + " "
    got = result(docs_of([(1, passage * 4)]))
    assert got[1].strip() == passage.strip()


def test_one_changed_line_is_kept(docs_of):
    lines = [prose(9).replace("\n", " ").strip() + "\n" for _ in range(20)]
    other = lines[:10] + ["an altogether different line here.\n"] + lines[11:]
    got = result(docs_of([(1, "".join(lines)), (2, "".join(other))]))
    assert "an altogether different line here." in got[2]
    assert len(got[2].split()) < 40


def test_nulls_ties_empty_and_long(docs_of):
    copy = prose(80)
    long = "word " * 50_000
    rows = [(None, copy), (1, copy), (1, copy), (2, None), (3, ""), (4, long), (5, long)]
    df = winnow.drop_repeats(docs_of(rows))
    assert df.columns == docs_of([]).columns
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in df.collect() if r["text"] is not None)
    assert got == [(0, copy), (1, ""), (1, ""), (3, ""), (4, long), (5, "")]
    assert winnow.drop_repeats(docs_of([])).count() == 0


def test_no_python_in_the_plan(docs_of):
    df = winnow.drop_repeats(docs_of([(1, prose(50))]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_passages_at_any_offset_go(docs_of):
    r = random.Random(4)
    plain = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        text = prose(400) if i % 2 else plain(400)
        words, n = text.split(), 30 + i % 61
        at = r.randrange(len(words) - n)
        passage = " ".join(words[at : at + n])
        before, after = plain(r.randint(0, 40)), plain(r.randint(0, 40))
        rows += [(i, text), (1000 + i, f"{before} {passage} {after}")]
        want[1000 + i] = (before + " " + after).split()
    got = result(docs_of(rows))
    assert all(got[i] == text for i, text in rows if i < 1000)
    for i, words in want.items():
        # a neighbour may be the same word by chance
        left = got[i].split()
        assert len(words) - 2 <= len(left) <= len(words) and set(left) <= set(words)


def test_passages_without_blanks_go(docs_of):
    r = random.Random(6)
    signs = lambda n: "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n))
    passage = signs(60)
    a, b = signs(50) + passage + signs(40), [signs(33), signs(21)]
    got = result(docs_of([(1, a), (2, b[0] + passage + b[1]), (3, "  " + b[0] + "\u3000" + passage)]))
    assert got[1] == a and got[2] == b[0] + b[1]
    assert got[3].strip() in ("", b[0])
