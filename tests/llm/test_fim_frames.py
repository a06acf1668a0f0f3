"""Fill-in-middle over frames against the same cut made on whole strings."""

import hashlib
import random
import re

import pytest
import zstandard

from spoor.llm import fim_frames

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def expected(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(5)
    letters = ["a", "é", "中", "🙂", " ", "\n", "\t", "\x0b", " ", "<", "P", ">", "\x00", "x"]
    found = [None, "", " ", "\n\n ", "word", "a<P>b", "<", "  lead and trail  ", "é" * 50, "x" * 200_000, "ab " * 70_000]
    found += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(300)]
    return [*enumerate(found), (3, "again the same id"), (3, "again the same id"), (None, "an id that is null, four times over")]


@pytest.mark.parametrize("size", [5, 64, fim_frames.FRAME])
def test_equals_the_cut_of_whole_strings(docs_of, size):
    rows = [r for r in texts() if size > 64 or len(r[1] or "") < 1000]
    store = fim_frames.frames(docs_of(rows), size=size)
    out = fim_frames.texts(fim_frames.transform(store, size=size), "output", "made")
    back = fim_frames.texts(fim_frames.restore(out, size=size), "restored", "whole")
    got = sorted(
        (
            repr((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["made"], r["output_sha256"], r["whole"], r["restored_sha256"]))
            for r in back.collect()
        )
    )
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        n, form, pre, mid, made = expected(i, t)
        want.append(repr((i, n, form, pre, mid, made, sha(made), t or "", sha(t or ""))))
    assert got == sorted(want)
    assert len({x.split(", ")[2] for x in want}) == 3


def test_frames_are_independent_and_bounded(docs_of):
    text = "wörter und zahlen " * 20_000
    row = fim_frames.frames(docs_of([(1, text)]), size=1000).first()
    read = zstandard.ZstdDecompressor()
    parts = [read.decompress(x).decode() for x in row["data"]]  # each decodes by itself
    assert "".join(parts) == text and max(len(p.encode()) for p in parts) <= 1003
    assert row["units"][-1] == len(TOKEN.findall(text)) and row["chars"][-1] == len(text)
    assert row["units"] == sorted(row["units"])


def test_a_cut_reads_one_frame(docs_of):
    row = fim_frames.frames(docs_of([(1, "some words and more " * 5_000)]), size=500).first().asDict()

    class Counting:
        def __init__(self):
            self.inner, self.n = zstandard.ZstdDecompressor(), 0

        def decompress(self, data):
            self.n += 1
            return self.inner.decompress(data)

    read = Counting()
    fim_frames.place_of(row["units"][-1] // 2, row, read)
    assert read.n == 1


def test_empty_table(docs_of):
    made = fim_frames.restore(fim_frames.transform(fim_frames.frames(docs_of([]))))
    assert made.count() == 0 and made.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored", "restored_sha256"]
