"""Repeated passages by winnowing over word hashes, with DataFrame operations only.

A text is cut into words: at white space, and around every character of scripts that are
written without it. Every ``GRAM`` neighbouring words are hashed; of each window of such
hashes the least one (the first of equals) becomes a fingerprint, so any repeated run of
``WINDOW + GRAM - 1`` words, wherever it begins, shares one. Fingerprints met before are
joined to their first position, matches are extended word by word both ways, and runs that
are long enough are deleted wherever they come later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import cut

SPACE = r"\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Thai to Myanmar, Khmer, kana, ideographs
SINGLE = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}"
INNER = rf"(?<=[{SINGLE}])(?=[^{SPACE}])|(?<=[^{SPACE}])(?=[{SINGLE}])"
BETWEEN = rf"[{SPACE}]+|{INNER}"
# before each word, so that texts rejoin whole; as many pieces as between
WORD_END = rf"(?<=[{SPACE}])(?=[^{SPACE}])|{INNER}"
# words of a fingerprint, and fingerprints of which one is taken: gapless in a match
GRAM, WINDOW = 16, 15
# words that a repeated run needs to be deleted: no more than WINDOW + GRAM - 1
MIN_WORDS = 30
# how far a match can go beyond its outermost fingerprint without containing another one
REACH = WINDOW - 1
POSITION_BITS = 28
# stands for a null id in joins
NO_ID = -(1 << 63)


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(d, t, h)`` per text: id, hash of the text and the hashes of its words."""
    low = F.lower("text")
    # most texts have no such script: their pieces are the same by the shorter pattern
    pieces = F.when(low.rlike(f"[{SINGLE}]"), F.split(low, BETWEEN)).otherwise(F.split(low, f"[{SPACE}]+"))
    return (
        docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"),
            F.col(text_col).alias("text"),
        )
        .where(F.length("text") > 0)
        .select(
            "d",
            F.xxhash64("text").bitwiseAND((1 << 35) - 1).alias("t"),
            F.explode(F.array(pieces)).alias("w"),  # split once
        )
        # white space at the end leaves an empty piece
        .withColumn("w", F.expr("CASE WHEN element_at(w, -1) = '' THEN slice(w, 1, size(w) - 1) ELSE w END"))
        .select("d", "t", F.explode(F.array(F.expr("transform(w, x -> hash(x))"))).alias("h"))
    )


def fingerprints(words: DataFrame) -> DataFrame:
    """``(g, d, p, k, q)``: hash, document, position and number of words of each fingerprint.

    ``p`` holds the text's hash above the number of the first word; ``q`` tells if all words
    are the same one.
    """
    # exploding an array of one value makes each step a column: in a plain projection the
    # steps before would be computed again at every use
    once = lambda df, step: df.select("d", "t", "h", F.explode(F.array(F.expr(step))).alias("m"))
    out = words.where(F.size("h") >= GRAM).withColumn("m", F.col("h"))
    for j in (1, 2, 4, 8):
        out = once(out, f"transform(m, (x, i) -> hash(x, get(m, i + {j})))")
    # the hash of a whole gram above its position
    out = once(
        out, f"transform(slice(m, 1, size(m) - {GRAM - 1}), (x, i) -> shiftleft(CAST(x AS BIGINT), 31) + i)"
    )
    for j in (1, 2, 4, 7):
        out = once(out, f"transform(m, (x, i) -> least(x, get(m, i + {j})))")
    out = once(out, f"array_distinct(slice(m, 1, greatest(size(m) - {WINDOW - 1}, 1)))")
    chosen = out.select(
        "d",
        "t",
        F.explode(
            F.expr(
                "transform(m, x -> struct(CAST(x & 2147483647 AS INT) AS i,"
                f" slice(h, CAST(x & 2147483647 AS INT) + 1, {GRAM}) AS s))"
            )
        ).alias("f"),
    )
    place = F.shiftleft("t", POSITION_BITS).bitwiseOR(F.col("f.i").cast("long"))
    return chosen.select(
        F.xxhash64("f.s").alias("g"), "d", place.alias("p"), F.lit(GRAM).cast("byte").alias("k"),
        (F.array_min("f.s") == F.array_max("f.s")).alias("q"),
    )


def repeated_runs(words: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(d, t, i, j)``: runs of words ``i`` to ``j`` that also stand at an earlier place.

    Places are ordered by document id, then by text, then by word. One word over and over is
    no repeat of its own text.
    """
    prints = cut(fingerprints(words))
    first = (
        prints.groupBy("g")
        .agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "p")).alias("first"))
        .where("c > 1")
        .select("g", F.col("first.d").alias("sd"), F.col("first.p").alias("sp"))
    )
    text_of = lambda c: F.shiftright(c, POSITION_BITS)
    word_of = lambda c: F.col(c).bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    apart = (F.col("d") != F.col("sd")) | (F.col("p") != F.col("sp"))
    own = (F.col("d") == F.col("sd")) & (text_of("p") == text_of("sp"))
    seeds = prints.join(first, "g").where(apart & ~(own & F.col("q")))
    seeds = seeds.select(
        "d", text_of("p").alias("t"), word_of("p").alias("i"), "k",
        "sd", text_of("sp").alias("st"), word_of("sp").alias("si"),
    )
    # stretches of words that seeds cover without a gap
    before = Window.partitionBy("d", "t").orderBy("i", "k").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("d", "t").orderBy("i", "k").rowsBetween(Window.unboundedPreceding, 0)
    stretches = (
        seeds.withColumn("apart", (F.col("i") > F.max(F.col("i") + F.col("k")).over(before)))
        .withColumn("run", F.sum(F.coalesce("apart", F.lit(True)).cast("int")).over(upto))
        .groupBy("d", "t", "run")
        .agg(
            F.min("i").alias("i"),
            F.max(F.col("i") + F.col("k") - 1).alias("j"),
            F.min_by(F.struct("sd", "st", "si"), F.struct("i", "k")).alias("a"),
            F.max_by(
                F.struct("sd", "st", (F.col("si") + F.col("k") - 1).alias("si")), F.struct("i", "k")
            ).alias("z"),
        )
    )
    stretches = cut(stretches.drop("run"))
    # extension: up to REACH words just outside, here and at the first place
    ends = {
        "ob": (F.col("d"), F.col("t"), F.col("i"), -1),
        "oa": (F.col("d"), F.col("t"), F.col("j"), 1),
        "sb": (F.col("a.sd"), F.col("a.st"), F.col("a.si"), -1),
        "sa": (F.col("z.sd"), F.col("z.st"), F.col("z.si"), 1),
    }
    places = [
        stretches.select(d.alias("d"), t.alias("t"), at.alias("at"), F.lit(step).alias("step"))
        for d, t, at, step in ends.values()
    ]
    places = places[0].union(places[1]).union(places[2]).union(places[3]).distinct()
    near = cut(
        words.join(places, ["d", "t"]).select(
            "d", "t", "at", "step",
            F.expr(
                f"CASE WHEN step > 0 THEN slice(h, at + 2, {REACH}) ELSE"
                f" reverse(slice(h, greatest(at - {REACH} + 1, 1), least(at, {REACH}))) END"
            ).alias("near"),
        ).distinct()
    )
    grown = stretches
    for name, (d, t, at, step) in ends.items():
        side = near.where(F.col("step") == step).select(
            F.col("d").alias("nd"), F.col("t").alias("nt"), F.col("at").alias("na"),
            F.col("near").alias(name),
        )
        grown = grown.join(side, (d == side["nd"]) & (t == side["nt"]) & (at == side["na"]), "left")
        grown = grown.drop("nd", "nt", "na")
    steps = ", ".join(str(m + 1) for m in range(REACH))
    equal = (
        f"size(filter(array({steps}), m -> m <= least(size({{0}}), size({{1}}))"
        " AND slice({0}, 1, m) = slice({1}, 1, m)))"
    )
    grown = grown.select(
        "d",
        "t",
        (F.col("i") - F.expr(equal.format("ob", "sb"))).alias("i"),
        (F.col("j") + F.expr(equal.format("oa", "sa"))).alias("j"),
    )
    # stretches that meet after extension are one run
    before = Window.partitionBy("d", "t").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("d", "t").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        grown.withColumn("apart", F.col("i") > F.max("j").over(before) + 1)
        .withColumn("run", F.sum(F.coalesce("apart", F.lit(True)).cast("int")).over(upto))
        .groupBy("d", "t", "run")
        .agg(F.min("i").alias("i"), F.max("j").alias("j"))
    )
    return runs.where(F.col("j") - F.col("i") + 1 >= min_words).select("d", "t", "i", "j")


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with later repeated runs of at least ``min_words`` words cut out of the text.

    Every row stays; a text that is one whole repeat becomes empty. Words compare without
    white space and without case. The first place, by id, then text, then word, keeps the run. Defined results: null and empty texts stay as they are; rows with the same id
    and text get the same result (neither counts as a repeat of the other); a null id comes
    first; an empty table gives an empty result; all columns keep their names and order.
    """
    runs = repeated_runs(word_table(docs, id_col, text_col), min_words)
    cuts = cut(
        runs.groupBy(F.col("d").alias("__d"), F.col("t").alias("__t")).agg(
            F.collect_set(F.struct("i", "j")).alias("__cuts")
        )
    )
    marked = docs.withColumn(
        "__d", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    ).withColumn("__t", F.xxhash64(text_col).bitwiseAND((1 << 35) - 1))
    left = F.expr(
        f"array_join(filter(split(`{text_col}`, r'{WORD_END}'),"
        " (x, i) -> NOT exists(__cuts, c -> i BETWEEN c.i AND c.j)), '')"
    )
    kept = marked.join(cuts, ["__d", "__t"], "left").withColumn(
        text_col, F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(left)
    )
    return kept.select(*docs.columns)
