"""Whitelists and rule lists of path prefixes as tables of any length."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.scale import small_side

# lists up to this length are tested in the row itself, without a join
INLINE = 64
HOT_ROWS = 500_000  # rows that agree as far as prefixes reach; where they are more, they are dealt out
HOT_WAYS = 64  # parts of such rows
LONE = "\\"  # stands for the reach of rows that no prefix can fit; no plain path begins so
LONE_WAYS = 4096  # parts of such rows


def plain_path(c: Column) -> Column:
    """Small letters, backslashes, no quotes before it, no drive and no separators in front."""
    low = F.replace(F.lower(F.trim(c)), F.lit("/"), F.lit("\\"))
    return F.regexp_replace(low, r'^[" ]*(?:[a-z]:)?\\*', "")


@dataclass(frozen=True)
class Product:
    """The prefixes ``head + tail`` of all pairs of ``heads(head, *link)`` and ``tails(tail, *link)``
    that agree in ``link``, with one rule. The pairs are never built, so such a list costs what its
    two tables do. No head may be blank or end in a blank."""

    heads: DataFrame
    tails: DataFrame
    link: Sequence[str] = ()
    rule: str | None = None


def _listed(prefix: Column) -> Column:
    """The shape of a prefix: how many separators it has, and the characters after the last."""
    return F.struct(
        (F.length(prefix) - F.length(F.replace(prefix, F.lit("\\"), F.lit("")))).alias("depth"),
        F.length(F.substring_index(prefix, "\\", -1)).alias("tail"),
    )


def _ways(listed: DataFrame, prefix: str) -> list:
    """The distinct shapes of a list, depths and lengths of names, a few hundred pairs at most; each
    with the text that all its prefixes begin with, and where the name begins if that text says so."""
    c = F.col(prefix)
    ends = listed.groupBy(_listed(c).alias("s")).agg(F.min(c).alias("a"), F.max(c).alias("b")).select("s.*", "a", "b")
    ways = []
    for r in ends.collect():
        begin = commonprefix([r["a"], r["b"]])
        ways.append((r["depth"], r["tail"], begin, begin.rfind("\\") + 1 if begin.count("\\") == r["depth"] else -1))
    return sorted(ways)


def _key_lengths(ways: Sequence) -> Column:
    """For each shape the length of the head of ``_p`` that has it, or null. No two shapes give the same head."""
    p, slash = F.col("_p"), F.lit("\\")

    def fitting(depth: Column, tail: Column, start: Column, at: Column) -> Column:
        begin = F.when(at < 0, F.length(F.call_function("substring_index", p, slash, depth)) + 1).otherwise(at)
        name = F.substring(p, begin + 1, tail)
        fit = F.startswith(p, start) & (begin <= F.length(p)) & (F.length(name) == tail) & ~F.contains(name, slash)
        return F.when(fit, begin + tail)

    if len(ways) <= INLINE:  # written out, they are compiled
        return F.array(*[fitting(*map(F.lit, way)) for way in ways])
    shapes = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("dtsa", way)]) for way in ways])
    return F.transform(shapes, lambda s: fitting(s["d"], s["t"], s["s"], s["a"]))


def _keys(ways: Sequence) -> Column:
    return F.transform(F.array_compact(_key_lengths(ways)), lambda n: F.substring(F.col("_p"), F.lit(1), n))


def _cut(df: DataFrame, path: Column, longest: int) -> DataFrame:
    """``df`` with the plain path ``_p`` as far as prefixes go."""
    return df.withColumn("_p", F.substring(plain_path(path), 1, longest + 1))


def _longest(listed: DataFrame, column: str) -> int:
    return listed.agg(F.coalesce(F.max(F.length(column)), F.lit(0))).first()[0]


def _inline(listed: DataFrame) -> list[str] | None:
    """The prefixes of a short list, else None."""
    few = [r[0] for r in listed.select("_key").limit(INLINE + 1).collect()]
    return few if len(few) <= INLINE else None


def _inline_length(few: Sequence[str], ways: Sequence) -> Column:
    """The length of the longest of ``few`` prefixes that ``_p`` has; null if it has none."""
    known = F.array(*[F.lit(k) for k in few])
    return F.array_max(F.transform(F.filter(_keys(ways), lambda k: F.array_contains(known, k)), F.length))


def _meet(
    df: DataFrame, path: str, listed: DataFrame, products: Sequence[Product], answer: Callable, how: str
) -> DataFrame:
    """``df`` joined, as ``how`` says, with ``answer`` of its prefixes.

    A path counts only as far as some prefix could reach by its shape, ``_k``; paths of one folder agree
    there. ``answer`` gets ``(_k, _rows, _r0, n0, n1, ...)``: rows of ``df`` that have this ``_k``,
    the rule and length of its longest prefix in the list, and the length of that in each product,
    null where there is none. A ``_k`` without any is left out.

    ``_k`` meets the list by equality, once for each shape of prefix it is long enough for, and
    a product by its head first and then by what follows the head. Rows that no prefix can fit, and
    those of a ``_k`` with very many, are dealt out evenly.
    """
    pairs = []
    for one in products:
        # the sign behind the head keeps its own end from being trimmed
        heads = one.heads.select(*one.link, plain_path(F.concat("head", F.lit("x"))).alias("_h")).select(
            *one.link, F.expr("substring(_h, 1, length(_h) - 1)").alias("_key")
        )
        tails = one.tails.select(*one.link, F.rtrim(F.replace(F.lower("tail"), F.lit("/"), F.lit("\\"))).alias("_tail"))
        heads, tails = heads.where(F.col("_key").isNotNull()).distinct(), tails.where(F.col("_tail").isNotNull()).distinct()
        sizes = sorted(r[0] for r in tails.select(F.length("_tail")).distinct().collect())
        pairs.append((heads, tails, one.link, _ways(heads, "_key") if sizes else [], sizes))
    ways = _ways(listed, "_key")
    longest = max([_longest(listed, "_key"), *[_longest(h, "_key") + max(z, default=0) for h, _, _, _, z in pairs]])
    ends = [F.array_max(_key_lengths(w)) + room for w, room in [(ways, 0), *[(w, max(z, default=0)) for *_, w, z in pairs]] if w]
    none, unruled = F.lit(None).cast("int"), F.lit(None).cast(listed.schema["_r0"].dataType)
    reach = F.coalesce(F.substring(F.col("_p"), F.lit(1), F.greatest(none, none, *ends)), F.lit(LONE))
    rows = _cut(df, F.col(path), longest).withColumn("_k", reach).drop("_p")
    counted = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_rows"))
    cut = counted.withColumn("_p", F.nullif(F.col("_k"), F.lit(LONE)))
    names = [f"n{i}" for i in range(len(pairs) + 1)]
    own = lambda i, n, rule: [
        "_k", "_rows", rule.alias("_r0"), *[n.alias(c) if c == f"n{i}" else none.alias(c) for c in names]]
    found = [counted.limit(0).select(*own(0, none, unruled))]
    if ways:
        met = cut.select("_k", "_rows", F.explode(_keys(ways)).alias("_key")).join(small_side(listed), "_key")
        found.append(met.select(*own(0, F.length("_key"), F.col("_r0"))))
    for i, (heads, tails, link, ways, sizes) in enumerate(pairs, 1):
        if not ways:
            continue
        met = cut.select("_k", "_rows", F.explode(_keys(ways)).alias("_key")).join(small_side(heads), "_key")
        rest = F.expr("substring(_k, length(_key) + 1)")
        begun = F.transform(
            F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s <= F.length("_rest")),
            lambda s: F.substring(F.col("_rest"), F.lit(1), s),
        )
        met = met.select("_k", "_rows", *link, F.length("_key").alias("_n"), rest.alias("_rest")).select(
            "_k", "_rows", *link, "_n", F.explode(begun).alias("_tail")
        ).join(small_side(tails), [*link, "_tail"])
        found.append(met.select(*own(i, F.col("_n") + F.length("_tail"), unruled)))
    met = reduce(DataFrame.unionByName, found[1:] or found).groupBy("_k", "_rows").agg(
        F.max_by("_r0", "n0").alias("_r0"), *[F.max(c).alias(c) for c in names]
    )
    spread = lambda ways: F.pmod(F.xxhash64(F.col(path)), F.lit(ways)).cast("int")
    many = F.col("_rows") > HOT_ROWS
    copies = F.when(many, F.sequence(F.lit(0), F.lit(HOT_WAYS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(F.broadcast(counted.where(many).select("_k", F.lit(True).alias("_hot"))), "_k", "left").withColumn(
        "_salt", F.when(F.col("_k") == LONE, spread(LONE_WAYS)).when(F.col("_hot"), spread(HOT_WAYS)).otherwise(0)
    )
    given = answer(met)
    more = [c for c in given.columns if c not in ("_k", "_rows")]
    joined = dealt.join(given.withColumn("_salt", F.explode(copies)).drop("_rows"), ["_k", "_salt"], how)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *(more if how != "left_anti" else []))


def _best(met: DataFrame) -> DataFrame:
    lengths = [F.col(c) for c in met.columns if c[0] == "n"]
    best = met.withColumn("_n", F.greatest(*lengths, F.lit(-1)))
    return best.withColumn("prefix", F.substring(F.col("_k"), F.lit(1), F.col("_n")))


def _plain_list(table: DataFrame, rule: Column | None = None) -> DataFrame:
    """The distinct plain prefixes ``_key`` of a table, each with its smallest rule ``_r0``."""
    named = table.select(plain_path(F.col("prefix")).alias("_key"), (F.lit(None).cast("string") if rule is None else rule).alias("_r0"))
    return named.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_r0").alias("_r0"))


def longest_prefix(
    paths: DataFrame, table: DataFrame, path: str = "path", products: Sequence[Product] = ()
) -> DataFrame:
    """``(path, prefix)``: the longest prefix of ``table`` or ``products`` with which each distinct
    path starts.

    Both sides are compared by :func:`plain_path`. A path is cut after its folders, each carried
    on by as many characters as prefixes of that depth have behind their last separator, and met
    with the table by equality; so a list may have millions of prefixes, and no path meets more of
    them than there are such shapes. Paths with no prefix are left out; an empty prefix fits every
    path.
    """
    distinct = paths.select(F.col(path).alias("path")).where(F.col(path).isNotNull()).distinct()
    return _meet(distinct, "path", _plain_list(table), products, lambda met: _best(met).select("_k", "_rows", "prefix"), "inner")


def prefix_rules(
    df: DataFrame, table: DataFrame, path: str = "path", products: Sequence[Product] = ()
) -> DataFrame:
    """``df`` with ``prefix`` and ``rule`` of its longest prefix in ``table(prefix, rule)`` or ``products``.

    Null where no prefix fits. If a prefix is listed with several rules, the smallest counts.
    """
    given = [F.when(F.col(f"n{i}") == F.col("_n"), F.lit(p.rule)) for i, p in enumerate(products, 1)]
    rule = F.least(F.when(F.col("n0") == F.col("_n"), F.col("_r0")), F.lit(None), *given)
    answer = lambda met: _best(met).select("_k", "_rows", "prefix", rule.alias("rule"))
    return _meet(df, path, _plain_list(table, F.col("rule")), products, answer, "left")


def drop_prefixed(df: DataFrame, table: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path starts with no prefix of the table; null paths stay.

    A short list is tested in the row itself; a longer one is met once per distinct path.
    """
    listed = _plain_list(table)
    few = _inline(listed)
    if few is not None:
        if not few:
            return df
        tested = _cut(df, F.col(path), max(map(len, few))).withColumn("_n", _inline_length(few, _ways(listed, "_key")))
        return tested.where(F.col("_n").isNull()).select(*[F.col(f"`{c}`") for c in df.columns])
    return _meet(df, path, listed, (), lambda met: met.select("_k", "_rows"), "left_anti")
