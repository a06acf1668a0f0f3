"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most
``segments * (ball + 1) - 1`` bits agree in some segment up to ``ball`` bits, so
probing every segment's small Hamming ball in a table of segment values finds all
of them; complete distances are then verified inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import components, cut

SEED = 42
# the bits set in each byte value, most significant first
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words: runs of bytes other than space and tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles_of(words: list[bytes], k: int) -> list[bytes]:
    """All k-word shingles with repeats; the whole sequence if it is shorter; none for no word."""
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    starts = [0, *ends[: len(words) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    return [joined[a:b] for a, b in zip(starts, stops)]


def majority(digests: np.ndarray) -> bytes:
    """Bits set in over half the rows of ``digests`` (rows x bytes, big-endian)."""
    ones = np.concatenate(
        [np.bincount(column, minlength=256) @ BYTE_BITS for column in digests.T]
    )
    return np.packbits(2 * ones > len(digests)).tobytes()


def fingerprint64(text: str | None, k: int = 3) -> bytes:
    """The 64-bit fingerprint of all shingles by XXH64; zero for a text without words."""
    shingles = shingles_of(words_of(text), k)
    if not shingles:
        return bytes(8)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
    return majority(hashes.view(np.uint8).reshape(-1, 8))


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(id, fp)`` per row; a null text counts as empty, ids are kept as they are."""

    @F.pandas_udf("binary")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint64(t, k) for t in batch])

    return df.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def links_within(prints: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """All pairs ``(a, b)`` of different 64-bit fingerprints at most ``radius`` bits apart.

    ``prints(fp)`` holds distinct fingerprints as longs. Each segment's table has one row
    per fingerprint. The probes are the segment value with up to ``radius // segments``
    bits changed; of two values one bit apart only the one with the zero bit probes, so a
    pair is met once per segment.
    """
    ball = radius // segments
    if ball > 1:
        raise ValueError("segments probe one changed bit at most: use more segments")
    width = 64 // segments
    mask = (1 << width) - 1
    cuts = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("s"),
                    F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask)).alias("x"),
                )
                for i in range(segments)
            ]
        )
    ).alias("c")
    cells = prints.select("fp", cuts).select("fp", "c.s", "c.x")
    held = cells.select(F.col("fp").alias("b"), "s", "x")
    flips = [0, *([1 << i for i in range(width)] if ball else [])]
    probes = (
        cells.withColumn("f", F.explode(F.array(*[F.lit(v).cast("long") for v in flips])))
        .where(F.col("x").bitwiseAND(F.col("f")) == 0)
        .select(F.col("fp").alias("a"), "s", F.col("x").bitwiseOR(F.col("f")).alias("x"), "f")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    once = (F.col("f") != 0) | (F.col("a") < F.col("b"))
    same = (probes["s"] == held["s"]) & (probes["x"] == held["x"])
    return probes.join(held, same & near & once).select("a", "b").distinct()


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3
) -> DataFrame:
    """Fingerprint and near-duplicate group of every row: ``(id, fp, component)``.

    Rows link when their fingerprints differ in at most ``radius`` bits; ``component`` is
    the smallest id reachable. Equal fingerprints are folded before any join, so a group
    of copies of any size is one vertex. Defined results: a null or word-less text has
    fingerprint zero and links like any other; a null id keeps its row and never becomes
    the smallest id unless its group has no other (then null); repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    marked = cut(
        fingerprints(df, id_col, text_col, k).withColumn(
            "fp", F.conv(F.hex("fp"), 16, -10).cast("long")
        )
    )
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links_within(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = cut(rooted.join(least, "root").select("fp", "component"))
    return marked.join(named, "fp").select("id", "fp", "component")


def fingerprint_hex(fp: str = "fp"):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# the wide fingerprint: 16 segments of 22 bits. Shingle sets of similarity 0.8 differ in 52 of
# its 352 bits on average, with a deviation of 6.7. It describes a text; one_of_each decides by
# the shingle sets themselves
WIDE_SEGMENTS, WIDE_BITS, WIDE_RADIUS = 16, 22, 58
WEIGHTS = 1 << np.arange(WIDE_BITS)[::-1]


def fingerprint_wide(text: str | None, k: int = 5) -> np.ndarray:
    """Segments of the majority bits over the set of ``k``-word shingles; zeros for no word."""
    shingles = set(shingles_of(words_of(text), k))
    if not shingles:
        return np.zeros(WIDE_SEGMENTS, np.int32)
    digest = xxhash.xxh3_128_digest
    data = b"".join(digest(s, 1) + digest(s, 2) + digest(s, 3) for s in sorted(shingles))
    bits = np.unpackbits(
        np.frombuffer(majority(np.frombuffer(data, np.uint8).reshape(-1, 48)), np.uint8)
    )[: WIDE_SEGMENTS * WIDE_BITS]
    return (bits.reshape(WIDE_SEGMENTS, WIDE_BITS) @ WEIGHTS).astype(np.int32)


# near copies: shingle sets of at least this similarity (intersection over union)
NEAR, NEAR_OF = 4, 5
# candidates share one of BANDS bands of ROWS least hashes: sets of similarity 0.8 have none in
# common with probability (1 - 0.8 ** 4) ** 24, three in a million
BANDS, ROWS = 24, 4
MIXERS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * 2 + 1
# shingles hashed at once, which bounds the memory of a long text
SLICE = 4096


def shingle_hashes(text: str | None, k: int = 5) -> np.ndarray:
    """The set of ``k``-word shingles as sorted 64-bit hashes; empty for no word."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles_of(words_of(text), k)], np.uint64))


def bands_of(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit number a band, its number mixed in; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), SLICE):
        mixed = (hashes[None, i : i + SLICE] ^ MIXERS[0]) * MIXERS[1]
        np.minimum(least, mixed.min(axis=1), out=least)
    return [
        int.from_bytes(xxhash.xxh64_digest(band.tobytes(), i), "big", signed=True)
        for i, band in enumerate(least.reshape(BANDS, ROWS))
    ]


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
    among: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id, nulls last.

    ``among(id)`` names the rows that an earlier step left, if there was one; the others go.

    Texts link when the sets of their ``k``-word shingles have a similarity of at least 0.8
    (4 of 5, counted exactly on 64-bit hashes); groups are connected. Texts that share a band
    of least hashes are compared: a pair at 0.8 is missed with probability 3e-6, a nearer one
    less often.

    A large group costs no more than its size times a few: each band value first links its
    texts to its least and greatest one only; then texts of different groups that still share
    a band are compared. Equal texts are one vertex. Defined results: null, empty and
    word-less texts are copies of each other; repeated rows are copies; an empty table gives
    an empty result; columns stay as they are.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))

    @F.pandas_udf("n int, x array<long>")
    def banded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingle_hashes(t, k) for t in batch]
            yield pd.DataFrame({"n": [len(s) for s in sets], "x": [bands_of(s) for s in sets]})

    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__t": F.xxhash64(whole)})
    marked = rows.select(F.col("__id").alias("_id"), F.col("__t").alias("_t"), banded(whole).alias("_g"))
    marked = cut(
        marked.select(
            "_id", "_t", "_g", F.when(F.col("_g.n") == 0, F.lit(0).cast("long")).otherwise(F.col("_t")).alias("v")
        )
    )
    if among is not None:  # the step before has chosen rows; their texts are not moved for it
        marked = cut(marked.join(among, F.col("_id").eqNullSafe(among["id"].cast("long")), "left_semi"))
    classes = cut(marked.groupBy("v").agg(F.first("_g").alias("g")))
    texts = rows.select(F.col("__t").alias("v"), whole.alias("x"))

    cells = classes.select("v", F.col("g.n").alias("n"), F.explode("g.x").alias("x"))
    ends = (
        cells.groupBy("x")
        .agg(F.min(F.struct("v", "n")).alias("low"), F.max(F.struct("v", "n")).alias("high"))
        .where("low.v < high.v")
    )
    stars = cells.join(ends, "x").select("v", "n", F.explode(F.array("low", "high")).alias("e"))
    stars = stars.where((F.col("v") != F.col("e.v")) & _sizes_fit(F.col("n"), F.col("e.n")))
    stars = stars.select(F.least("v", "e.v").alias("a"), F.greatest("v", "e.v").alias("b"))
    first = components(_verified(stars.distinct(), texts, k))
    named = cut(
        classes.select("v").join(first, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
    )

    placed = cells.join(named, "v")
    mixed = placed.groupBy("x").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    placed = cut(placed.join(mixed.where("low < high").select("x"), "x"))
    side = lambda c: placed.select("x", *[F.col(f).alias(f + c) for f in ("v", "n", "root")])
    other = (F.col("va") < F.col("vb")) & (F.col("roota") != F.col("rootb"))
    pairs = side("a").join(side("b"), "x").where(other & _sizes_fit(F.col("na"), F.col("nb")))
    found = _verified(pairs.select(F.col("va").alias("a"), F.col("vb").alias("b")).distinct(), texts, k)
    root_of = lambda c: named.select(F.col("v").alias(c), F.col("root").alias("r" + c))
    bridges = found.join(root_of("a"), "a").join(root_of("b"), "b")
    second = components(bridges.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    final = (
        named.join(second.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left")
        .select("v", F.coalesce("top", "root").alias("top"))
    )
    members = cut(
        marked.groupBy("_id", "_t", "v").agg(F.count(F.lit(1)).alias("n")).join(final, "v")
    )
    best = members.groupBy("top").agg(
        F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_t")).alias("m")
    )
    kept = cut(
        members.join(best, "top")
        .where(F.col("_id").eqNullSafe(F.col("m._id")) & (F.col("_t") == F.col("m._t")))
        .select(F.col("_id").alias("__ki"), F.col("_t").alias("__kt"), F.col("n").alias("__n"))
    )
    out = rows.join(kept, F.col("__id").eqNullSafe(F.col("__ki")) & (F.col("__t") == F.col("__kt")))
    if kept.where("__n > 1").limit(1).count():
        out = out.dropDuplicates(["__id", "__t"])
    return out.select(*docs.columns)


def _sizes_fit(n: Column, m: Column) -> Column:
    """False if sets of ``n`` and ``m`` shingles cannot be near copies."""
    return NEAR_OF * F.least(n, m) >= NEAR * F.greatest(n, m)


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are similar enough; ``texts(v, x)`` may repeat."""

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_hashes(t, k).view(np.int64) for t in batch])

    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    sets = cut(
        texts.join(wanted, "v", "left_semi").groupBy("v").agg(F.first("x").alias("x")).select("v", hashes("x").alias("g"))
    )
    of = lambda c: sets.select(F.col("v").alias(c), F.col("g").alias("g" + c))
    both = F.size(F.array_intersect("ga", "gb"))
    near = (NEAR + NEAR_OF) * both >= NEAR * (F.size("ga") + F.size("gb"))
    return cut(pairs.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b"))
