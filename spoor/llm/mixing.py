"""Mixing sources by temperature, with DataFrame operations only.

A source with token share ``s`` gets a weight in proportion to ``s ** a``. The exponent is
the largest one that reaches the target entropy, raised if need be until no source repeats
more often than the limit. Weights become token budgets. A budget is met by whole passes
over the source and a part of one more: the source's documents lie in blocks, the blocks
and the documents inside are permuted by hash, and the part takes them in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import cut

# share of the entropy of equal weights, and passes over a source
ENTROPY = 0.98
REPEATS = 4.0
SEED = "mix"
SECTIONS, PASSES = 128, 4
# hex digits of the hash that number a block
BLOCK_DIGITS = 3


def tokens_of(text: Column) -> Column:
    """Words of a text, counted as its blanks and line ends plus one; 0 for null or empty."""
    blanks = F.length(text) - F.length(F.translate(text, " \t\n", ""))
    return F.when(F.length(text) > 0, blanks + 1).otherwise(0).cast("long")


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent for ``sources(tokens)``, between 0 (equal) and 1 (as they are).

    Found by sections: each pass measures a grid of exponents in one aggregate and goes on
    between the two that enclose the wanted one. Entropy and repeats fall as it rises, and
    the driver sees one row a grid point.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["t"]:
        return 1.0
    shares = sources.select((F.col("tokens") / F.lit(float(total["t"]))).alias("s"))
    goal = entropy * F.log(F.lit(float(total["n"])))

    def last_true(test: Column) -> float:
        """The largest exponent at which ``test`` holds, 0 if none."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            step = (high - low) / SECTIONS
            grid = F.transform(F.sequence(F.lit(0), F.lit(SECTIONS)), lambda k: F.lit(low) + k * F.lit(step))
            measured = (
                shares.select("s", F.explode(grid).alias("a"))
                .groupBy("a")
                .agg(
                    F.sum(F.pow("s", "a")).alias("z"),
                    F.sum(F.pow("s", "a") * F.log("s")).alias("l"),
                    F.max(F.pow("s", F.col("a") - 1)).alias("m"),
                )
                .select("a", test.alias("ok"))
                .orderBy("a")
                .collect()
            )
            good = [i for i, r in enumerate(measured) if r["ok"]]
            if not good:
                return 0.0
            low = measured[good[-1]]["a"]
            if good[-1] == len(measured) - 1:
                return low
            high = measured[good[-1] + 1]["a"]
        return low

    even = last_true(F.log("z") - F.col("a") * F.col("l") / F.col("z") >= goal)
    often = last_true(F.col("m") / F.col("z") > F.lit(float(repeats)))
    return max(even, often)


def mix(
    docs: DataFrame,
    budget: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
) -> DataFrame:
    """``docs`` with ``repeats``, how often each document is used, and ``block``.

    Documents that the budget does not reach go. ``budget`` counts tokens of the mixture,
    by default as many as the table has. Defined results: a null source is a source of its
    own; texts that are null or empty have no tokens, follow their source's whole passes
    and the part if their turn comes before its end, and go if their source has no tokens;
    rows that are alike in source and id stand at one place of the permutation, so the part
    takes all of them or none; an empty table gives an empty result; columns of ``docs``
    named like the new ones are replaced.
    """
    mark = F.concat_ws(
        "|", F.lit(SEED), F.coalesce(F.concat(F.lit("s"), source_col), F.lit("n")),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
    )
    docs = docs.drop("repeats", "block")
    rows = docs.withColumns(
        {
            "__s": F.coalesce(F.concat(F.lit("s"), source_col), F.lit("n")),
            "__n": tokens_of(F.col(text_col)),
            "__h": F.md5(mark),
        }
    ).withColumn("block", F.substring("__h", 1, BLOCK_DIGITS))
    blocks = cut(rows.groupBy("__s", "block").agg(F.sum("__n").alias("tokens")))
    sources = cut(blocks.groupBy("__s").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    power = exponent(sources, entropy, repeats)
    total = sources.agg(
        F.sum("tokens").alias("t"),
        F.sum(F.pow(F.col("tokens").cast("double"), F.lit(power))).alias("z"),
    ).first()
    goal = float((total["t"] if budget is None else budget) or 0)
    planned = sources.select(
        "__s",
        F.floor(
            F.pow(F.col("tokens").cast("double"), F.lit(power)) / F.lit(total["z"] or 1.0) * F.lit(goal) + 0.5
        ).alias("budget"),
        "tokens",
    ).select(
        "__s",
        F.floor(F.col("budget") / F.col("tokens")).alias("passes"),
        (F.col("budget") % F.col("tokens")).alias("part"),
    )
    # one row a block: at most 16 ** BLOCK_DIGITS for any source
    order = Window.partitionBy("__s").orderBy(F.md5(F.concat_ws("|", F.lit(SEED), "__s", "block")))
    placed = cut(
        blocks.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .join(planned, "__s")
        .select(
            "__s", "block", "passes", "part", (F.col("upto") - F.col("tokens")).alias("start"),
            F.when(F.col("upto") <= F.col("part"), "in")
            .when(F.col("upto") - F.col("tokens") >= F.col("part"), "out")
            .otherwise("cut")
            .alias("side"),
        )
    )
    # only the block in which a part ends is looked into, one for each source
    ends = placed.where("side = 'cut'")
    inside = Window.partitionBy("__s", "block").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        rows.select("__s", "block", "__h", "__n")
        .join(ends, ["__s", "block"])
        .groupBy("__s", "block", "__h", "start", "part")
        .agg(F.sum("__n").alias("__n"))
        .withColumn("before", F.col("start") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .where("before < part")
        .select("__s", "block", "__h", F.lit(1).alias("__in"))
    )
    extra = F.when(F.col("__side") == "in", 1).otherwise(F.coalesce("__in", F.lit(0)))
    used = (
        rows.join(placed.select("__s", "block", F.col("passes").alias("__passes"), F.col("side").alias("__side")), ["__s", "block"])
        .join(taken, ["__s", "block", "__h"], "left")
        .withColumn("repeats", F.col("__passes") + extra)
        .where("repeats > 0")
    )
    return used.select(*docs.columns, "repeats", "block")


def _sections(name: str, test: str) -> str:
    """The passes of ``exponent`` as common table expressions; the last one is ``name``."""
    parts = ["{n}0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high)"]
    for k in range(1, PASSES + 1):
        parts.append(
            f"{{n}}g{k} AS (SELECT low + g * ((high - low) / {SECTIONS}) AS a FROM {{n}}{k - 1}, range({SECTIONS + 1}) r(g)),"
            f" {{n}}m{k} AS (SELECT a, sum(pow(s, a)) AS z, sum(pow(s, a) * ln(s)) AS l, max(pow(s, a - 1)) AS m FROM shares, {{n}}g{k} GROUP BY a),"
            f" {{n}}t{k} AS (SELECT a, ({test}) AS ok FROM {{n}}m{k}),"
            f" {{n}}{k} AS (SELECT coalesce(max(a) FILTER (ok), 0.0) AS low,"
            f" coalesce((SELECT min(a) FROM {{n}}t{k} WHERE a > (SELECT max(a) FROM {{n}}t{k} WHERE ok)), max(a) FILTER (ok), 0.0) AS high FROM {{n}}t{k})"
        )
    return ", ".join(parts).replace("{n}", name)


ORACLE = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS s0,
    CASE WHEN length(text) > 0 THEN length(text) - length(translate(text, ' ' || chr(9) || chr(10), '')) + 1 ELSE 0 END AS n,
    md5('{SEED}|' || coalesce('s' || source, 'n') || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cells AS (SELECT *, substr(h, 1, {BLOCK_DIGITS}) AS block FROM rows),
sources AS (SELECT s0, sum(n)::BIGINT AS tokens FROM cells GROUP BY s0 HAVING sum(n) > 0),
shares AS (SELECT tokens / (SELECT sum(tokens) FROM sources)::DOUBLE AS s FROM sources),
{_sections("e", f"ln(z) - a * l / z >= {ENTROPY} * ln((SELECT count(*) FROM shares)::DOUBLE)")},
{_sections("r", f"m / z > {REPEATS}")},
power AS (SELECT greatest((SELECT low FROM e{PASSES}), (SELECT low FROM r{PASSES})) AS a),
planned AS (SELECT s0, tokens, floor(pow(tokens::DOUBLE, (SELECT a FROM power))
    / (SELECT sum(pow(tokens::DOUBLE, (SELECT a FROM power))) FROM sources) * (SELECT sum(tokens) FROM sources) + 0.5)::BIGINT AS budget FROM sources),
places AS (SELECT s0, block, h, md5('{SEED}|' || s0 || '|' || block) AS o, sum(n) AS n FROM cells GROUP BY ALL),
running AS (SELECT *, sum(n) OVER (PARTITION BY s0 ORDER BY o, h) - n AS before FROM places)
SELECT doc_id, source, (budget // tokens + CASE WHEN before < budget % tokens THEN 1 ELSE 0 END)::BIGINT AS repeats, c.block
FROM cells c JOIN running USING (s0, block, h) JOIN planned USING (s0)
WHERE budget // tokens + CASE WHEN before < budget % tokens THEN 1 ELSE 0 END > 0
"""
