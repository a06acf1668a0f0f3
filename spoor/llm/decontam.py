"""Benchmark passages inside documents: SimHash windows, multi-index blocks, exact check.

A window of a document that is as long as a benchmark item gets a SimHash fingerprint if
enough of its shingles belong to items of that length, wherever they stand. Multi-index
Hamming tables of the items' fingerprints give all items within the radius; the similarity
of the two weighted shingle sets then decides.

Words are runs of letters and digits, lower-cased; each character of a script that is
written without spaces is a word. A shingle is five words, or all words of a shorter item,
and weighs as often as it occurs. The similarity of an item and a window is the shared
weight over the item's weight. It cannot exceed the share of the window's shingles that
belong to any item of that length, so the other windows are left out at no loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.textvec import STEP, mixed, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
SEGMENTS = 8
BALL = 2
# all fingerprints within this many bits are found: one segment of eight differs in two at most
RADIUS = SEGMENTS * (BALL + 1) - 1
# the words of items that one broadcast block holds; more items make more blocks
BLOCK_WORDS = 200_000
FOUND = "array<struct<item_id:bigint,similarity:double,start_word:int,n_words:int>>"

WORD_BYTES = np.full(256, 32, np.uint64)
for low, high in ((48, 58), (97, 123), (128, 256)):
    WORD_BYTES[low:high] = np.arange(low, high)
BALLS = np.array([v for v in range(256) if bin(v).count("1") <= BALL])


# most texts hold nothing beyond ASCII and accented Latin letters
UNUSUAL = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
NO_LETTER = regex.compile(r"[^\p{L}\p{M}\p{N}\x00-\x7f]+")
# scripts that are written without spaces: each character is a word
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*")


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: runs of letters, marks and digits in small letters.

    Each character of a script that is written without spaces is a word.
    """
    low = (text or "").lower()
    if UNUSUAL.search(low):
        low = UNSPACED.sub(r" \g<0> ", NO_LETTER.sub(" ", low))
    raw = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    data = np.full(len(raw) + 2, 32, np.uint64)
    data[1:-1] = WORD_BYTES[raw]
    return word_hashes(data)[0]


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-word shingles, in order."""
    n = len(words) - k + 1
    if k < 1 or n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * STEP + mixed(words[j : j + n])
    return mixed(h)


def simhash(rows: np.ndarray) -> np.ndarray:
    """Fingerprints of equally long rows of shingle hashes: the bits set in over half."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(*rows.shape, 8), axis=2)
    ones = 2 * bits.sum(1, dtype=np.int32) > rows.shape[1]
    return np.packbits(ones, axis=1).view(np.uint64)[:, 0]


def shared_weight(a: np.ndarray, b: np.ndarray) -> int:
    """Number of shingles two rows share, repeats counted."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


@dataclass
class Sized:
    """The items of one length, with their multi-index tables."""

    items: list[int] = field(default_factory=list)  # places in the block
    prints: np.ndarray | None = None
    tables: np.ndarray | None = None  # segment x value x packed items


class Block:
    """Tables of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.rows: list[np.ndarray] = []
        self.size: list[int] = []
        self.sized: dict[int, Sized] = {}
        owner = []
        for item_id, text in items:
            words = words_of(text)
            if not len(words):
                continue
            rows = shingles_of(words, min(SHINGLE, len(words)))
            self.sized.setdefault(len(words), Sized()).items.append(len(self.ids))
            owner.append(np.full(len(rows), len(self.ids)))
            self.ids.append(item_id)
            self.rows.append(rows)
            self.size.append(len(words))
        flat = np.concatenate(self.rows) if self.rows else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.count = np.unique(
            flat[order], return_index=True, return_counts=True
        )
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, int)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.short = sorted({min(SHINGLE, n) for n in self.size})
        self.sizes = np.array(self.size, int)
        for group in self.sized.values():
            group.prints = np.concatenate([simhash(self.rows[i][None]) for i in group.items])
            bytes_ = group.prints.view(np.uint8).reshape(-1, SEGMENTS)
            member = np.zeros((SEGMENTS, 256, len(group.items)), bool)
            for s in range(SEGMENTS):
                near = bytes_[:, s][:, None] ^ BALLS[None, :].astype(np.uint8)
                member[s, near, np.arange(len(group.items))[:, None]] = True
            group.tables = np.packbits(member, axis=2)

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """Items in a text: id, similarity, first word and number of words of the best window."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        for k in self.short:
            rows = shingles_of(words, k)
            hits = np.flatnonzero(self.filter[(rows >> np.uint64(44)).astype(np.int64)])
            place = np.searchsorted(self.keys, rows[hits])
            place[place == len(self.keys)] = 0
            right = self.keys[place] == rows[hits] if len(self.keys) else np.zeros(len(hits), bool)
            hits, place = hits[right], place[right]
            if len(hits):
                self._windows(words, rows, k, hits, place, best)
        return [(self.ids[i], *best[i]) for i in sorted(best)]

    def _windows(self, words, rows, k, hits, place, best) -> None:
        """Every window that can reach the similarity, wherever its shared shingles stand.

        A window shares no more shingles with an item than it has places whose shingle belongs
        to some item of that size; running sums of such places tell the windows with enough.
        """
        marks: dict[int, np.ndarray] = {}
        for at in range(0, len(hits), 4096):
            many = self.count[place[at : at + 4096]]
            ends = np.cumsum(many)
            posting = np.arange(ends[-1]) - np.repeat(ends - many - self.first[place[at : at + 4096]], many)
            spot = np.repeat(hits[at : at + 4096], many)
            size = self.sizes[self.owner[posting]]
            for n in np.unique(size):
                if min(SHINGLE, n) == k:
                    marks.setdefault(int(n), np.zeros(len(rows), bool))[spot[size == n]] = True
        for n, mark in marks.items():
            group, m = self.sized[n], min(n, len(words)) - k + 1
            sums = np.zeros(len(rows) + 1, np.int64)
            np.cumsum(mark, out=sums[1:])
            shared = sums[m:] - sums[:-m]
            starts = np.flatnonzero(shared >= SIMILARITY * (n - k + 1) - 1e-9)
            for at in range(0, len(starts), max(1, 50_000 // m)):
                some = starts[at : at + max(1, 50_000 // m)]
                windows = rows[some[:, None] + np.arange(m)]
                self._match(group, some, windows, n, best)

    def _match(self, group: Sized, starts, windows, n, best) -> None:
        prints = simhash(windows)
        bytes_ = prints.view(np.uint8).reshape(-1, SEGMENTS)
        near = np.zeros((len(prints), group.tables.shape[2]), np.uint8)
        for s in range(SEGMENTS):
            near |= group.tables[s, bytes_[:, s]]
        w, i = np.nonzero(np.unpackbits(near, axis=1, count=len(group.items)))
        close = np.bitwise_count(prints[w] ^ group.prints[i]) <= RADIUS
        for row, at in zip(w[close], i[close]):
            item = group.items[at]
            share = shared_weight(self.rows[item], windows[row]) / len(self.rows[item])
            if share >= SIMILARITY and share > best.get(item, (0.0,))[0]:
                best[item] = (share, int(starts[row]), n)


def blocks_of(items: DataFrame, id_col: str, text_col: str, words: int) -> Iterator[Block]:
    """Blocks of at most about ``words`` words; the driver holds one at a time."""
    part: list[tuple[int, str]] = []
    held = 0
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    for r in rows.where(F.col("t").isNotNull() & F.col("i").isNotNull()).toLocalIterator():
        part.append((r["i"], r["t"]))
        held += len(r["t"]) // 4 + 1
        if held >= words:
            yield Block(part)
            part, held = [], 0
    if part:
        yield Block(part)


def leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> Column:
    """Column of ``docs``: the items found in each whole text, by item id.

    Each entry has the item's id, the similarity, and the first word and length of its best
    window (the first of equals). Items are taken in blocks of bounded size, each broadcast
    once. Defined results: a null or word-less text holds nothing; items without id or words
    are never found; a text shorter than an item is one window; repeated rows each get their
    result; an item id given twice is found twice; no items give empty arrays.
    """
    sc = docs.sparkSession.sparkContext
    columns = []
    for block in blocks_of(items, item_id, item_text, block_words):
        columns.append(_found(sc.broadcast(block))(F.col(text_col)))
    if not columns:
        return F.array().cast(FOUND)
    return F.concat(*columns) if len(columns) > 1 else columns[0]


def _found(block):
    @F.pandas_udf(FOUND)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "similarity", "start_word", "n_words")
        for batch in texts:
            yield pd.Series([[dict(zip(names, x)) for x in block.value.find(t)] for t in batch])

    return found


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item found in it."""
    found = docs.select("doc_id", leaks(docs, items).alias("found"))
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with the same columns."""
    kept = docs.withColumn("__leaks", leaks(docs, items)).where(F.size("__leaks") == 0)
    return kept.drop("__leaks")
