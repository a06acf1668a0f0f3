"""Ranked lexical search: MaxScore with bounds of term pairs.

Documents are indexed in shards of bounded size: per term the documents and their impacts. The
terms of a query are taken two by two. For each pair the two lists are joined beforehand, per
shard, and the largest joint impact and the documents with the best ones are stored. So the bound
of a pair is what one document really has of both, mostly less than the sum of two maxima, which
often stand in different documents.

A query takes its terms from the smallest maximum up and adds their bounds: that of the pair
where both terms are among them, else the maximum of the term. Terms whose sum stays under the
score of the k-th document known so far cannot bring a new document to the top; only the postings
of the others are read, and a candidate leaves as soon as its score and the bound of what is left
cannot reach that score. The k-th joint impact over all shards is such a score before any
posting is read. Bounds never fall short and equal scores always stay, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spoor.llm.common import stored
from spoor.scale import capped_rank

SHARD_DOCS = 16_384
SHARD_POSTINGS = 2_000_000
BLOCK_BYTES = 4 << 20  # text of the queries that go over the index together
K = 50
# fixed value: a term is a run of ASCII letters and digits and of anything beyond ASCII
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text; only A-Z become small (``bytes.lower`` knows no others)."""
    return (text or "").encode().lower().translate(FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting brings before its weight; 64-bit whole numbers throughout."""
    m = 50 + (50 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Shard:
    """Documents and postings of one shard, as they are gathered."""

    def __init__(self, most: int):
        self.most = most
        self.ids, self.lengths, self.sizes, self.term, self.tf = [], [], [], [], []

    def full(self) -> bool:
        return len(self.ids) >= self.most or len(self.term) >= SHARD_POSTINGS

    def add(self, doc_id, words: list[bytes], vocabulary: dict[bytes, int]) -> None:
        counts = Counter(filter(vocabulary.__contains__, words))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.sizes.append(len(counts))
        self.term.extend(map(vocabulary.__getitem__, counts))
        self.tf.extend(counts.values())

    def row(self, name: str, id_type: pa.DataType) -> pa.RecordBatch:
        term, tf = np.array(self.term, np.int32), np.array(self.tf, np.int32)
        at = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        order = np.argsort(term, kind="stable")
        seen, df = np.unique(term, return_counts=True)
        lists = {
            "ids": pa.array([self.ids], pa.list_(id_type)),
            "lengths": pa.array([self.lengths], pa.list_(pa.int64())),
            "terms": pa.array([seen.astype(np.int32)], pa.list_(pa.int32())),
            "df": pa.array([df.astype(np.int32)], pa.list_(pa.int32())),
            "at": pa.array([at[order]], pa.list_(pa.int32())),
            "tf": pa.array([tf[order]], pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_arrays([pa.array([name]), *lists.values()], ["shard", *lists])


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row per shard: its documents with terms, and the postings of the terms of ``vocabulary``.

    ``at`` and ``tf`` hold the postings, term by term in the order of ``terms``, ``df`` of them
    each. A shard is closed at ``shard_docs`` documents or ``SHARD_POSTINGS`` postings.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard = TaskContext.get().partitionId(), 0, Shard(shard_docs)
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column("id").type
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                words = terms(text.as_py())
                if words:
                    shard.add(doc_id, words, sent.value)
                if shard.full():
                    yield shard.row(f"{part}-{made}", id_type)
                    made, shard = made + 1, Shard(shard_docs)
        if shard.ids:
            yield shard.row(f"{part}-{made}", id_type)

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = "terms array<int>, df array<int>, at array<int>, tf array<int>"
    return named.mapInArrow(build, f"shard string, ids array<{kind}>, lengths array<bigint>, {lists}")


class Postings:
    """The contributions of a shard, by term: positions and weighted impacts."""

    def __init__(self, row: dict[str, np.ndarray], weights: np.ndarray):
        stops = np.cumsum(row["df"], dtype=np.int64)
        self.n = len(row["lengths"])
        self.slices = dict(zip(row["terms"].tolist(), zip((stops - row["df"]).tolist(), stops.tolist())))
        self.at, self.impact, self.weights = row["at"], row["impact"], weights
        self.room = np.zeros(self.n, np.int64)

    def tops(self) -> dict[int, int]:
        """The largest contribution of each term."""
        return {t: int(self.impact[a:b].max()) * int(self.weights[t]) for t, (a, b) in self.slices.items()}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        start, stop = self.slices.get(term, (0, 0))
        return self.at[start:stop], self.impact[start:stop] * self.weights[term]

    def joined(self, terms_of: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents with one of the terms, in ascending order, and what they have of all."""
        for term in terms_of:
            at, part = self.of(term)
            self.room[at] += part
        docs = np.flatnonzero(self.room)
        sums = self.room[docs]
        self.room[docs] = 0
        return docs, sums

    def lookup(self, terms_of: Sequence[int], docs: np.ndarray) -> np.ndarray:
        """What ``docs`` have of all the terms."""
        out = np.zeros(len(docs), np.int64)
        for term in terms_of:
            at, part = self.of(term)
            if len(at):
                k = np.minimum(np.searchsorted(at, docs), len(at) - 1)
                out += np.where(at[k] == docs, part[k], 0)
        return out


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 1 if there are fewer: only scores above 0 count."""
    return max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else 1


def pair_lists(shards: DataFrame, units: list[tuple[int, ...]], weights: np.ndarray, totals: tuple[int, int], k: int) -> DataFrame:
    """``shards`` with impacts and the list of each pair: its bound and its best documents.

    ``best`` holds up to ``k`` documents of each pair with their joint impacts in ``joint``,
    largest first; no document of the shard has more of a pair than its ``bound``.
    """
    sent = shards.sparkSession.sparkContext.broadcast((units, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, by_term = sent.value
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {c: batch.column(c)[k_row].values.to_numpy(zero_copy_only=False) for c in ("lengths", "terms", "df", "at", "tf")}
                row["impact"] = impacts(row["tf"].astype(np.int64), row["lengths"][row["at"]], *totals)
                held = Postings(row, by_term)
                found, bounds, best, joint = [], [], [], []
                for number, unit in enumerate(pairs):
                    docs, sums = held.joined(unit)
                    if not len(docs):
                        continue
                    top = np.argpartition(-sums, k)[:k] if len(sums) > k else np.arange(len(sums))
                    top = top[np.argsort(-sums[top], kind="stable")]
                    found.append(number)
                    bounds.append(int(sums[top[0]]))
                    best.append(docs[top].astype(np.int32))
                    joint.append(sums[top])
                lists = {
                    "impact": pa.array([row["impact"].astype(np.int32)], pa.list_(pa.int32())),
                    "pairs": pa.array([found], pa.list_(pa.int32())),
                    "bounds": pa.array([bounds], pa.list_(pa.int64())),
                    "best": pa.array([best], pa.list_(pa.list_(pa.int32()))),
                    "joint": pa.array([joint], pa.list_(pa.list_(pa.int64()))),
                }
                kept = batch.slice(k_row, 1)
                same = ("shard", "ids", "lengths", "terms", "df", "at")
                yield pa.RecordBatch.from_arrays([*map(kept.column, same), *lists.values()], [*same, *lists])

    kind = shards.schema["ids"].dataType.simpleString()
    return shards.mapInArrow(
        run,
        f"shard string, ids {kind}, lengths array<bigint>, terms array<int>, df array<int>, at array<int>,"
        " impact array<int>, pairs array<int>, bounds array<bigint>, best array<array<int>>, joint array<array<bigint>>",
    )


def prefix_bounds(item: list[tuple[int, ...]], tops: dict[int, int], bounds: dict[tuple[int, ...], int]) -> tuple[list[int], np.ndarray]:
    """The terms of an item by rising maximum, and what one document can have of the first n.

    A term brings its maximum, unless the other of its pair is among them: then both bring the
    bound of the pair, which is never more than the two maxima.
    """
    pair_of = {t: pair for pair in item for t in pair if t in tops}
    order = sorted(pair_of, key=lambda t: (tops[t], t))
    seen: set[int] = set()
    steps = []
    for term in order:
        other = [t for t in pair_of[term] if t != term and t in seen]
        steps.append(bounds[pair_of[term]] - tops[other[0]] if other else tops[term])
        seen.add(term)
    return order, np.cumsum(steps, dtype=np.int64)


def search_shard(
    held: Postings, item: list[tuple[int, ...]], tops: dict[int, int], bounds: dict[tuple[int, ...], int],
    best: dict[tuple[int, ...], np.ndarray], least: int, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the shard's documents that may be among the ``k`` best of an item.

    ``item`` lists the pairs of the item; ``tops`` has the largest contribution of a term here,
    ``bounds`` and ``best`` bound and best documents of a pair here; ``least`` is a score that at
    least ``k`` documents of the whole table reach, or 1.
    """
    order, sums = prefix_bounds(item, tops, bounds)
    if not order or sums[-1] < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the best documents of the pairs, scored in full, raise the score to beat
    docs = np.unique(np.concatenate([best[pair] for pair in item if pair in best]))
    least = max(least, kth(held.lookup(order, docs), k))
    skipped = int(np.searchsorted(sums, least, "left"))
    docs, scores = held.joined(order[skipped:])
    for place in range(skipped - 1, -1, -1):
        least = max(least, kth(scores, k))
        kept = scores + sums[place] >= least
        docs, scores = docs[kept], scores[kept]
        scores = scores + held.lookup(order[place : place + 1], docs)
    kept = scores >= max(least, kth(scores, k))
    return docs[kept], scores[kept]


def search(scored: DataFrame, items: list[tuple[object, list[int]]], units: list[tuple[int, ...]], weights: np.ndarray, least: list[int], k: int, item_type: T.DataType) -> DataFrame:
    """``(item, id, score)``: of each shard the ``k`` best documents of each item, if they can matter."""
    sent = scored.sparkSession.sparkContext.broadcast((items, units, weights, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, pairs, by_term, floors = sent.value
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {c: batch.column(c)[k_row].values for c in batch.schema.names if c != "shard"}
                ids, best = row.pop("ids"), row.pop("best")
                row = {c: v.to_numpy(zero_copy_only=False) for c, v in row.items()}
                held = Postings(row, by_term)
                tops = held.tops()
                here = [pairs[u] for u in row["pairs"].tolist()]
                bounds, best = dict(zip(here, row["bounds"].tolist())), dict(zip(here, (x.values.to_numpy() for x in best)))
                names, found, scores = [], [], []
                for (name, item), floor in zip(queries, floors):
                    docs, sums = search_shard(held, [pairs[u] for u in item], tops, bounds, best, floor, k)
                    got = ids.take(pa.array(docs)).to_pylist()
                    # ties to the smaller id, null ids last
                    order = sorted(range(len(got)), key=lambda i: (-sums[i], got[i] is None, got[i]))[:k]
                    names += [name] * len(order)
                    found += [got[i] for i in order]
                    scores += [int(sums[i]) for i in order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, item_arrow), pa.array(found, ids.type), pa.array(scores, pa.int64())], ["item", "id", "score"]
                )

    item_arrow = to_arrow_type(item_type)
    kind = scored.schema["ids"].dataType.elementType.simpleString()
    return scored.drop("joint").mapInArrow(run, f"item {item_type.simpleString()}, id {kind}, score bigint")


def ranked(
    docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """``(item, rank, id, score)``: the ``k`` best documents of each item with a score above 0.

    Queries go over the documents in blocks of about ``block_bytes`` of text, so what is sent to
    the executors is bounded whatever the number of queries; one item is never split. Defined
    results: null and empty texts have no terms, such documents count nowhere and such items
    have no rows; rows with the same item id are one item with the terms of all; rows with the
    same document id are documents of their own, in any order among themselves; equal scores
    rank by ascending id, null ids last; empty tables give an empty result; other columns are
    ignored. Scores fit 64 bits up to 10^10 documents of 10^7 terms.
    """
    named = queries.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, math.ceil(size / block_bytes))
    item_type = queries.schema[item_col].dataType
    out = None
    for block in range(blocks):
        held: dict[object, set[bytes]] = {}
        for r in named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toLocalIterator():
            held.setdefault(r["item"], set()).update(terms(r["text"]))
        found = _block(docs, held, k, id_col, text_col, item_type, shard_docs)
        out = found if out is None else out.unionByName(found)
    return out.select("item", "rank", "id", "score")


def _block(docs: DataFrame, queries: dict[object, set[bytes]], k: int, id_col: str, text_col: str, item_type: T.DataType, shard_docs: int) -> DataFrame:
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*queries.values())))}
    shards = stored(index(docs, vocabulary, id_col, text_col, shard_docs))
    total = shards.select(
        F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)).alias("l"),
    ).first()
    counted = (
        shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t"))
        .groupBy(F.col("t.terms").alias("term"))
        .agg(F.sum("t.df").alias("df"))
    )
    df = {r["term"]: r["df"] for r in counted.collect()}  # terms of this block at most
    weights = np.zeros(len(vocabulary), np.int64)
    for term, n in df.items():
        weights[term] = weight(total["n"], n)
    # frequent terms go together: their bounds decide how much is skipped
    numbers: dict[tuple[int, ...], int] = {}
    items = []
    for name, words in queries.items():
        present = sorted((vocabulary[t] for t in words if vocabulary[t] in df), key=lambda t: (-df[t], t))
        pairs = [tuple(present[n : n + 2]) for n in range(0, len(present), 2)]
        items.append((name, [numbers.setdefault(p, len(numbers)) for p in pairs]))
    units = list(numbers)
    scored = stored(pair_lists(shards, units, weights, (total["n"], total["l"]), k))
    joint = scored.select("shard", F.explode(F.arrays_zip("pairs", "joint")).alias("u")).select(
        "shard", F.col("u.pairs").alias("pair"), F.explode("u.joint").alias("joint")
    )
    ranks = capped_rank(joint, ["pair"], [F.col("joint").desc()], k, F.col("shard"))
    floors = {r["pair"]: r["joint"] for r in ranks.where(F.col("rank") == k).collect()}  # one number a pair
    least = [max([1, *(floors.get(u, 1) for u in item)]) for _, item in items]
    hits = search(scored, items, units, weights, least, k, item_type)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    return capped_rank(hits, ["item"], order, k, F.col("id"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS k FROM documents),
n AS (SELECT r, doc_id, k, len(k)::BIGINT AS n FROM d WHERE len(k) > 0),
t AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT r, unnest(k) AS term FROM n),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM p, t GROUP BY term),
s AS (
  SELECT item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN n USING (r), t GROUP BY ALL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM o WHERE k <= 50
"""
