"""Many keys against many lines: exact text search as equality joins.

A key is reduced to its rarest piece: the words of a key, whole or in part, are looked
up in the table of the distinct words of the text, with the lines that have each, and
the piece with the fewest lines becomes the *anchor*. Lines are exploded into their
distinct words, met with the anchors by an equality join, and only those candidates are
checked with the exact predicate. The work grows with the text, not with text times keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor import rules
from spoor.functions import base_name, first_iso, key_class
from spoor.functions.text import IPV4
from spoor.operators.filters import trivially_benign
from spoor.scale import capped_rank, fits, small_side
from spoor.session import durable

# runs of \w in small letters; the plain ranges come first because they are tested first
WORDS = r"(?U)[a-z0-9_[[^\x00-\x7f]&&[\w]]]+"
# the same runs, of text in small letters whose other symbols beyond ASCII are blanks: plain
# ranges are several times faster than the class above
RUNS = r"[a-z0-9_\x80-\x{10ffff}]+"
FOREIGN_SYMBOLS = r"(?U)[\x80-\x{10ffff}&&\W]+"
GRAM = 3
SYMBOL = "\x00"  # stands before a piece made of symbols, never in a word
LINE = ["source_file", "line_no"]
ANCHOR_ROWS = 1_000_000  # short rows: their bytes are bounded as those of any other side
# what may tell lines of the same name and number apart
OWNERS = ["case_id", "path"]


def line_key(lines: DataFrame) -> list[str]:
    """The columns that identify a line: file and number, within its case and path if known."""
    return [*(c for c in OWNERS if c in lines.columns), *LINE]


# ---- keys ------------------------------------------------------------------------


def search_keys(findings: DataFrame) -> DataFrame:
    """``(finding_id, pos, term, mode)`` from ``finding_id, key, secondary, type``.

    The key, the comma-separated secondary keys, the base name after each path, and
    the IPs inside the key of an auth or event finding; at least 3 characters,
    first occurrence of each.
    """
    main = F.coalesce("key", F.lit(""))
    others = F.transform(F.split(F.coalesce("secondary", F.lit("")), ","), lambda s: F.trim(s))
    ips = F.when(
        F.col("type").isin("auth", "event", "event_summary"),
        F.filter(F.split(main, r"\s+"), lambda p: p.rlike(IPV4)),
    ).otherwise(F.array().cast("array<string>"))
    given = F.transform(
        F.filter(F.concat(F.array(main), others, ips), lambda t: F.length(t) >= 3),
        lambda t: F.trim(t),
    )
    with_names = F.flatten(
        F.transform(
            given,
            lambda t: F.when(
                key_class(t) == "path",
                F.array(
                    F.struct(t.alias("term"), F.lit("path").alias("mode")),
                    F.struct(base_name(t).alias("term"), F.lit("word").alias("mode")),
                ),
            ).otherwise(F.array(F.struct(t.alias("term"), key_class(t).alias("mode")))),
        )
    )
    return (
        findings.select("finding_id", F.posexplode(with_names).alias("pos", "_k"))
        .where(F.length("_k.term") >= 3)
        .groupBy("finding_id", F.col("_k.term").alias("term"))
        .agg(
            F.min("pos").cast("bigint").alias("pos"),
            F.min_by(F.col("_k.mode"), "pos").alias("mode"),
        )
    )


def anchored(keys: DataFrame, term: str, how: Column) -> DataFrame:
    """Adds ``_low``, the term in small letters, and ``_how`` (word, substring or delimited)."""
    return keys.withColumns({"_low": F.lower(F.col(term)), "_how": how})


def key_pieces(needles: DataFrame) -> DataFrame:
    """``(_low, _how, piece, fit)``: what every line that matches a key must contain.

    ``fit`` tells how a piece lies in a word of the line: it is the ``whole`` word, its ``end``
    or ``start`` at the edges of a substring, or ``inside`` it. A key without word characters
    gives its pieces of up to GRAM symbols, behind a mark.
    """
    low = F.col("_low")
    runs = F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))
    last = F.size(runs) - 1
    open_left = (F.col("_how") == "substring") & low.rlike(r"(?U)\A\w")
    open_right = (F.col("_how") == "substring") & low.rlike(r"(?U)\w\z")
    left, right = (F.col("_i") == 0) & open_left, (F.col("_i") == last) & open_right
    grams = F.expr(f"transform(sequence(1, greatest(1, length(_low) - {GRAM - 1})), i -> substring(_low, i, {GRAM}))")
    words = needles.select("_low", "_how", F.posexplode(runs).alias("_i", "piece")).select(
        "_low", "_how", "piece",
        F.when(left & right, "inside").when(left, "end").when(right, "start").otherwise("whole").alias("fit"),
    )
    symbols = needles.where((F.size(runs) == 0) & (low != "")).select(
        "_low", "_how", F.explode(F.array_distinct(grams)).alias("piece")
    ).select("_low", "_how", F.concat(F.lit(SYMBOL), "piece").alias("piece"), F.lit("whole").alias("fit"))
    return words.unionByName(symbols).distinct()


def _line_pieces(symbol_sizes: Sequence[int]) -> Column:
    """The distinct words of a line, and its runs of symbols of some sizes behind their mark."""
    low = F.lower(F.col("content"))
    ascii_only = F.octet_length(low) == F.length(low)
    clean = F.when(ascii_only, low).otherwise(F.regexp_replace(low, FOREIGN_SYMBOLS, " "))
    found = [F.regexp_extract_all(clean, F.lit(RUNS), F.lit(0))]
    for size in symbol_sizes:
        runs = F.regexp_extract_all(low, F.lit(f"(?sU)(?=(\\W{{{size}}}))"), F.lit(1))
        found.append(F.transform(runs, lambda r: F.concat(F.lit(SYMBOL), r)))
    return F.array_distinct(F.concat(*found))


def _word_parts(word: Column, fit: str, size: int) -> Column:
    """``(fit, gram)`` structs of a word that is at least ``size`` long, else none."""
    if fit == "start":
        grams = F.array(F.substring(word, 1, size))
    elif fit == "end":
        grams = F.array(F.right(word, F.lit(size)))
    else:
        places = F.sequence(F.lit(1), F.length(word) - size + 1)
        grams = F.array_distinct(F.transform(places, lambda i: F.substring(word, i, F.lit(size))))
    cut = F.transform(grams, lambda g: F.struct(F.lit(fit).alias("fit"), g.alias("gram")))
    return F.when(F.length(word) >= size, cut).otherwise(
        F.array().cast("array<struct<fit:string,gram:string>>")
    )


def expanded(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """``pieces`` with each ``word`` of ``words`` that they fit, and its count ``n``.

    Pieces of a word meet the words by equality: on the word, on its first or last GRAM
    letters, or, inside a word, on that gram of the piece that the fewest words have. Only the
    distinct words of the text are cut into grams, never its lines.
    """
    whole = pieces.where(F.col("fit") == "whole").join(words, F.col("piece") == F.col("word"))
    parts = pieces.where(F.col("fit") != "whole")
    shapes = parts.select("fit", F.least(F.length("piece"), F.lit(GRAM)).alias("size")).distinct().collect()
    if not shapes:  # at most three fits of GRAM sizes
        return whole
    cut = F.concat(*[_word_parts(F.col("word"), r["fit"], r["size"]) for r in shapes])
    grams = parts.withColumn(
        "gram",
        F.explode(
            F.when(F.col("fit") == "start", F.array(F.substring("piece", 1, GRAM)))
            .when(F.col("fit") == "end", F.array(F.right(F.col("piece"), F.lit(GRAM))))
            .otherwise(F.expr(f"transform(sequence(1, greatest(1, length(piece) - {GRAM - 1})), i -> substring(piece, i, {GRAM}))"))
        ),
    ).distinct()
    wanted = small_side(grams.select("fit", "gram").distinct())
    cuts = durable(
        words.select("word", "n", F.explode(cut).alias("c")).select("word", "n", "c.fit", "c.gram").join(
            wanted, ["fit", "gram"], "left_semi"
        )
    )
    seen = cuts.groupBy("fit", "gram").agg(F.count(F.lit(1)).alias("_words"))
    # a gram that no word has is the rarest one: its key meets nothing
    rarest = grams.join(seen, ["fit", "gram"], "left").groupBy("_low", "_how", "piece", "fit").agg(
        F.min_by("gram", F.struct(F.coalesce("_words", F.lit(0)), "gram")).alias("gram")
    )
    fits_word = (
        F.when(F.col("fit") == "start", F.col("word").startswith(F.col("piece")))
        .when(F.col("fit") == "end", F.col("word").endswith(F.col("piece")))
        .otherwise(F.col("word").contains(F.col("piece")))
    )
    return whole.unionByName(cuts.join(small_side(rarest), ["fit", "gram"]).where(fits_word).select(*whole.columns))


def anchors(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """``(_low, _how, word, _sure)``: the words by which the lines of each key are found.

    ``_sure`` is true where the word alone proves the match: it is the whole key of a word
    search, or it holds the whole of a substring.
    Of the pieces of a key the rarest is taken: the one whose words, counted over ``lines``,
    have the fewest lines together. Keys with a piece that no line has are left out.
    """
    pieces = durable(
        key_pieces(keys.select("_low", "_how").distinct()).withColumn(
            "_alone", (F.count(F.lit(1)).over(Window.partitionBy("_low", "_how")) == 1) & (F.col("fit") == "whole")
        )
    )
    # a key of one word has no choice, and nothing is counted for it
    sure = (F.col("_how") == "word") & (F.col("piece") == F.col("_low"))
    alone = pieces.where("_alone").select("_low", "_how", F.col("piece").alias("word"), sure.alias("_sure"))
    pieces = pieces.where("not _alone").drop("_alone")
    kinds = pieces.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.when(F.col("piece").startswith(SYMBOL), F.length("piece") - 1)).alias("sizes"),
        F.count_if(F.col("fit") != "whole").alias("parts"),
    ).first()
    if not kinds["n"]:
        return alone
    found = lines.select(F.explode(_line_pieces(kinds["sizes"])).alias("word"))
    if not kinds["parts"]:  # no word but those of the keys is of interest
        found = found.join(small_side(pieces.select(F.col("piece").alias("word")).distinct()), "word", "left_semi")
    words = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if kinds["parts"]:
        words = durable(words)
    fitting = durable(expanded(pieces, words))
    costs = pieces.join(
        fitting.groupBy("_low", "_how", "piece", "fit").agg(F.sum("n").alias("_cost")), ["_low", "_how", "piece", "fit"], "left"
    )
    best = costs.groupBy("_low", "_how").agg(
        F.min_by(F.struct("piece", "fit"), F.struct(F.coalesce("_cost", F.lit(0)), "piece", "fit")).alias("_best")
    )
    chosen = best.select("_low", "_how", "_best.piece", "_best.fit")
    return alone.unionByName(
        fitting.join(small_side(chosen), ["_low", "_how", "piece", "fit"], "left_semi").select(
            "_low", "_how", "word",
            (((F.col("_how") == "substring") & (F.col("piece") == F.col("_low"))) | sure).alias("_sure"),
        )
    )


def _exact(content: Column) -> Column:
    """The exact predicate of an anchored key against a line."""
    quoted = F.concat(
        F.lit("\\Q"),
        F.replace(F.col("_low"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
        F.lit("\\E"),
    )
    bound = F.concat(F.lit(r"(?iU)\b"), quoted, F.lit(r"\b"))
    fenced = F.concat(
        F.lit(r"""(?iU)(^|[\s="'/\\])"""), quoted, F.lit(r"""($|[\s="'/\\])""")
    )
    return (
        F.when(F.col("_how") == "substring", F.lower(content).contains(F.col("_low")))
        .when(F.col("_how") == "word", F.regexp_like(content, bound))
        .otherwise(F.regexp_like(content, fenced))
    )


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of columns in which nulls are equal; still an equality join."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[f"_right_{c}"])
    return out


def match_lines(keys: DataFrame, lines: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """The columns of ``keys`` and the line key of every line that matches, each pair once.

    ``keys`` comes from :func:`anchored`; ``on`` adds equality columns (such as the file a key
    may be looked up in). The result holds no text; :func:`with_content` adds it.
    """
    return match_terms(keys, lines, on).join(small_side(keys), ["_low", "_how", *on])


def match_terms(keys: DataFrame, lines: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """The line key of every line that matches with ``_low`` and ``_how`` of each distinct key text
    it has, however many keys share the text.

    Anchors proven small are broadcast, and lines are then read without
    a shuffle. Otherwise only ``(line, word)`` pairs are shuffled, and the text joins back for
    the candidates that need it.
    """
    if on:
        lines = lines.join(small_side(keys.select(*on).distinct()), [*on], "left_semi")
        # a key of files without lines has no anchors: a short one lies in many words of the others
        keys = durable(keys.join(small_side(lines.select(*on).distinct()), [*on], "left_semi"))
    own = line_key(lines)
    found = durable(anchors(keys, lines))
    seen = found.agg(
        F.collect_set(F.when(F.col("word").startswith(SYMBOL), F.length("word") - 1)).alias("sizes"),
        F.count_if(~F.col("_sure")).alias("unsure"),
    ).first()
    words = F.explode(_line_pieces(seen["sizes"])).alias("word")
    if fits(found, ANCHOR_ROWS):
        # anchors of a file meet its own lines alone, as long as they may be sent out file by file
        by = found.join(small_side(keys.select("_low", "_how", *on).distinct()), ["_low", "_how"]) if on else found
        near = [*on] if on and fits(by, ANCHOR_ROWS) else []
        pairs = lines.select(*own, *[c for c in on if c not in own], "content", words).join(
            F.broadcast(by if near else found), ["word", *near]
        )
        hits = pairs.where(F.col("_sure") | _exact(F.col("content"))).select(*own, "_low", "_how").distinct()
    else:
        pairs = lines.select(*own, words).join(found, "word")
        pairs = pairs.groupBy(*own, "_low", "_how").agg(F.bool_or("_sure").alias("_sure"))
        hits = pairs.where("_sure").select(*own, "_low", "_how")
        if seen["unsure"]:
            tested = with_content(pairs.where("not _sure"), lines).where(_exact(F.col("content")))
            hits = hits.unionByName(tested.select(*own, "_low", "_how"))
    return hits


def with_content(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """``hits`` with the text of their lines."""
    own = line_key(lines)
    text = lines.select(*[F.col(c).alias(f"_right_{c}") for c in own], "content")
    small = small_side(hits)
    return small.join(text, _same(small, text, own)).drop(*[f"_right_{c}" for c in own])


# ---- pivot search ----------------------------------------------------------------


def file_ranks(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(
        [(f, i) for i, f in enumerate(files)], "source_file string, file_rank int"
    )


def _pivot_keys(keys: DataFrame, lines: DataFrame) -> tuple[DataFrame, list[str]]:
    how = F.when(F.col("mode") == "path", "substring").otherwise("word")
    # a key of one case meets the lines of that case only
    case = [c for c in ("case_id",) if c in keys.columns and c in lines.columns]
    return anchored(keys.select(*case, "finding_id", "term", "mode"), "term", how), case


def pivot_lines(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """``(finding_id, source_file, line_no)``, with case and path if lines have them: each line
    once per finding, whichever of its keys it has."""
    wanted, case = _pivot_keys(keys, lines)
    found = match_lines(wanted, lines, case).select("finding_id", *line_key(lines))
    # a line is met once per key text: where findings have one key each, none comes twice
    several = wanted.groupBy(*case, "finding_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return found if several.isEmpty() else found.distinct()


def pivot_hits(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """``(finding_id, source_file, line_no, content)``: each line once per finding.

    ``keys`` has finding_id, term and mode; ``lines`` has source_file, line_no, content.
    Findings may share texts: lines are met with the distinct texts, and get their own text,
    before findings come in. A finding of one key has no line twice; only lines of findings with
    several keys are made distinct.
    """
    wanted, case = _pivot_keys(keys, lines)
    terms = durable(match_terms(wanted, lines, case))
    own = line_key(lines)
    text = ["_low", "_how"]
    held = wanted.groupBy(*case, "finding_id").agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*text)).alias("_k")
    )
    one = held.where("_n = 1").select(*case, "finding_id", *[F.col("_k")[c].alias(c) for c in text])
    found = with_content(terms, lines).join(small_side(one), [*text, *case]).select("finding_id", *own, "content")
    more = held.where("_n > 1").select(*[F.col(c).alias(f"_right_{c}") for c in (*case, "finding_id")])
    several = durable(wanted.join(more, _same(wanted, more, [*case, "finding_id"]), "left_semi"))
    if several.isEmpty():
        return found
    pairs = terms.join(small_side(several), [*text, *case]).select("finding_id", *own).distinct()
    return found.unionByName(with_content(pairs, lines))


def cap_hits(
    hits: DataFrame,
    files: DataFrame,
    per_file: int = rules.HITS_PER_FILE,
    total: int = rules.HITS_PER_FINDING,
) -> DataFrame:
    """At most ``per_file`` lines of a file and ``total`` of a finding, in file order.

    Adds ``file_rank``, ``rank`` and ``truncated`` (the limit was reached before the
    last file of the order).
    """
    ranked = hits.join(small_side(files), "source_file")
    own = [*(c for c in ("case_id",) if c in hits.columns), "finding_id"]
    order = [F.col("line_no"), *(F.col(c) for c in ("path",) if c in hits.columns)]
    last = files.agg(F.max("file_rank")).first()[0]
    near = capped_rank(
        ranked, [*own, "source_file"], order, per_file, F.col("line_no"), "_n"
    )
    # at most per_file rows of each file are left, so a finding is small here
    kept = capped_rank(
        near, own, [F.col("file_rank"), *order], total, F.col("line_no"),
        "rank", ways=1,
    ).drop("_n")
    early = F.count_if(F.col("file_rank") < F.lit(last)).over(Window.partitionBy(*own))
    return kept.withColumn("truncated", early >= total)


def hits_per_file(hits: DataFrame) -> DataFrame:
    own = [*(c for c in ("case_id",) if c in hits.columns), "finding_id"]
    return hits.groupBy(*own, "source_file").agg(F.count(F.lit(1)).alias("hits"))


def pivot_search(
    keys: DataFrame,
    lines: DataFrame,
    files: DataFrame,
    per_file: int = rules.HITS_PER_FILE,
    total: int = rules.HITS_PER_FINDING,
) -> DataFrame:
    """Capped evidence lines of every finding; only the listed files are searched."""
    searched = lines.join(small_side(files.select("source_file")), "source_file", "left_semi")
    # lines are limited by their numbers alone; only the text of those that stay is fetched
    return with_content(durable(cap_hits(pivot_lines(keys, searched), files, per_file, total)), searched)


def format_pivot(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """Report text per finding. Hits are capped, so a finding's lines fit one row.

    ``findings``: finding_id, type, key, severity, reasons, source, secondary.
    """
    section = hits.groupBy("finding_id", "file_rank", "source_file").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "line_no",
                    F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), "content")
                    .alias("t"),
                )
            )
        ).alias("_l")
    ).select(
        "finding_id", "file_rank",
        F.concat(
            F.lit("--- "), F.col("source_file"), F.lit(" ("), F.size("_l").cast("string"),
            F.lit(" hits) ---\n"), F.array_join(F.col("_l")["t"], "\n"),
        ).alias("_s"),
    )
    text = section.groupBy("finding_id").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("file_rank", "_s")))["_s"], "\n"
        ).alias("_e")
    )
    bar = F.lit("=" * 72)

    def value(c: str, default: str) -> Column:
        return F.coalesce(F.col(c), F.lit(default))

    return findings.join(text, "finding_id", "left").select(
        "finding_id",
        F.concat_ws(
            "\n", bar,
            F.concat(
                F.lit("=== FINDING "), F.col("finding_id").cast("string"), F.lit(": type="),
                value("type", "?"), F.lit(" severity="), value("severity", "?"), F.lit(" ==="),
            ),
            F.concat(F.lit("=== key: "), value("key", "?"), F.lit(" ===")),
            bar,
            F.concat(F.lit("reasons:    "), value("reasons", "")),
            F.concat(F.lit("source:     "), value("source", "")),
            F.concat(F.lit("secondary:  "), value("secondary", "none")),
            F.lit(""),
            F.coalesce("_e", F.lit("(no matching lines in any artifact file)")),
        ).alias("report"),
    )


def pid_keys(processes: DataFrame) -> DataFrame:
    """``(finding_id, pos, term, mode)``: every pid as a whole word, of whatever length.

    ``processes``: pid, ppid, image, cmdline, as read from ``[PROCESS]`` blocks.
    """
    pid = F.col("pid").cast("string")
    return processes.where(F.coalesce(pid, F.lit("")) != "").select(
        pid.alias("finding_id"), F.lit(0).cast("bigint").alias("pos"), pid.alias("term"),
        F.lit("word").alias("mode"),
    ).distinct()


def pivot_memory(
    processes: DataFrame,
    lines: DataFrame,
    files: DataFrame,
    per_file: int = rules.HITS_PER_FILE,
    total: int = rules.HITS_PER_FINDING,
) -> DataFrame:
    """Capped evidence lines of every pid; ``finding_id`` is the pid."""
    return pivot_search(pid_keys(processes), lines, files, per_file, total)


def format_memory_pivot(processes: DataFrame, hits: DataFrame) -> DataFrame:
    """``(pid, report)``: the block of each process in the evidence report."""
    section = hits.groupBy("finding_id", "file_rank", "source_file").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "line_no",
                    F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), "content")
                    .alias("t"),
                )
            )
        )["t"].alias("_t")
    )
    text = section.groupBy("finding_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "file_rank",
                    F.concat(
                        F.lit("\n--- "), "source_file", F.lit(" ---\n"), F.array_join("_t", "\n")
                    ).alias("s"),
                )
            )
        )["s"].alias("_s")
    )
    pid = F.col("pid").cast("string")
    command = F.nullif(F.coalesce("cmdline", F.lit("")), F.lit(""))
    head = F.concat(
        F.lit("=== PID "), pid, F.lit(" ("), F.coalesce("image", F.lit("")), F.lit(", ppid="),
        F.coalesce(F.col("ppid").cast("string"), F.lit("")), F.lit(") ==="),
    )
    return processes.join(text, pid == F.col("finding_id"), "left").select(
        "pid",
        F.concat_ws(
            "\n", head, F.concat(F.lit("Cmdline: "), command),
            F.coalesce(
                F.array_join("_s", "\n"), F.lit("(no matching lines in any artifact file)")
            ),
            F.lit(""),
        ).alias("report"),
    )


def budget_lines(hits: DataFrame, n: int = rules.BUDGET_LINES) -> DataFrame:
    """Per finding and file: hits found and shown when ``n`` lines are shared in file order.

    Works on counts per file, so the lines themselves are never gathered.
    """
    counts = hits.groupBy("finding_id", "file_rank", "source_file").agg(
        F.count(F.lit(1)).alias("found")
    )
    before = Window.partitionBy("finding_id").orderBy("file_rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    used = F.coalesce(F.sum("found").over(before), F.lit(0))
    return counts.withColumn(
        "shown", F.greatest(F.least(F.col("found"), F.lit(n) - used), F.lit(0)).cast("bigint")
    )


# ---- entity queries --------------------------------------------------------------


def type_files(spark: SparkSession, files: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(entity_type, source_file, file_rank)`` from the per-type file lists."""
    return spark.createDataFrame(
        [(t, f, i) for t, fs in files.items() for i, f in enumerate(fs)],
        "entity_type string, source_file string, file_rank int",
    )


def _entity_keys(queries: DataFrame, allowed: DataFrame, module: str) -> DataFrame:
    """The needle of every query with each file it is looked up in."""
    kind = F.col("entity_type")
    name = base_name(F.col("entity_value"))
    bounded = ["pid"] if module == "memory" else ["hash_md5", "hash_sha1", "hash_sha256"]
    how = (
        F.when(kind == "image_name", "delimited")
        .when(kind.isin(bounded), "word")
        .otherwise("substring")
    )
    needle = F.when(
        kind.isin("image_name", "file_path") & (name != ""), name
    ).otherwise(F.col("entity_value"))
    keys = queries.select("query_id", "entity_type", needle.alias("_needle")).join(
        F.broadcast(allowed), "entity_type"  # a fixed list of types and files
    )
    return anchored(keys, "_needle", how)


def entity_lines(queries: DataFrame, lines: DataFrame, allowed: DataFrame,
                 module: str = "disk") -> DataFrame:
    """``query_id, file_rank`` and the key of every line of the allowed files that matches."""
    found = match_lines(_entity_keys(queries, allowed, module), lines, ["source_file"])
    return found.select("query_id", "file_rank", *line_key(lines)).distinct()


def entity_hits(queries: DataFrame, lines: DataFrame, allowed: DataFrame,
                module: str = "disk") -> DataFrame:
    """All lines of the allowed files that match a query, with their text, before any cap."""
    return with_content(entity_lines(queries, lines, allowed, module), lines)


def entity_lookup(
    queries: DataFrame,
    lines: DataFrame,
    allowed: DataFrame,
    cap: int = rules.EVIDENCE_LINES,
    module: str = "disk",
) -> DataFrame:
    """Evidence of each query: the first lines in file order, with their first ISO stamp.

    A ``max_lines`` column of ``queries`` overrides ``cap`` per query. The evidence is stored:
    what follows reads it more than once.
    """
    top = cap
    if "max_lines" in queries.columns:
        top = max(cap, queries.agg(F.max("max_lines")).first()[0] or cap)
    # queries may share a needle: of each file its first lines are taken before queries come in
    keys = _entity_keys(queries, allowed, module)
    text = ["_low", "_how", "source_file"]
    first = durable(
        capped_rank(
            match_terms(keys, lines, ["source_file"]), text, [F.col("line_no")], top, F.col("line_no"), "_n"
        ).drop("_n")
    )
    hits = first.join(small_side(keys), text).select("query_id", "file_rank", *line_key(lines)).distinct()
    ranked = capped_rank(
        hits, ["query_id"], [F.col("file_rank"), F.col("line_no")], top, F.col("line_no"), "rank"
    )
    if "max_lines" in queries.columns:
        ranked = ranked.join(queries.select("query_id", "max_lines"), "query_id").where(
            F.col("rank") <= F.coalesce("max_lines", F.lit(cap))
        ).drop("max_lines")
    # the text of the lines that stay is fetched last
    return durable(
        with_content(durable(ranked), lines).withColumn("timestamp", first_iso(F.col("content")))
    )


def cap_evidence(evidence: DataFrame, verdicts: DataFrame,
                 benign: int = rules.BENIGN_EVIDENCE_LINES) -> DataFrame:
    """Evidence of a rejected query is cut to its first lines."""
    return evidence.join(verdicts.select("query_id", "verdict"), "query_id").where(
        (F.col("verdict") != "REJECTED") | (F.col("rank") <= benign)
    ).drop("verdict")


def answer_queries(
    queries: DataFrame,
    evidence: DataFrame,
    module: str,
    supported: Sequence[str],
    blockers: str = rules.BENIGN_BLOCKERS_DISK,
    prefixes: Sequence[str] = rules.TRUSTED_FILE_PREFIXES,
) -> DataFrame:
    """Verdict of every query, decided on its retrieved evidence.

    ``queries``: query_id, target_module, entity_type, entity_value.
    """
    found = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    benign = trivially_benign(
        queries.select("query_id", "entity_type", "entity_value"), evidence, prefixes, blockers
    ).select("query_id", F.lit(True).alias("_benign"))
    kind, value = F.col("entity_type"), F.col("entity_value")
    wrong = F.col("target_module") != module
    unsupported = ~kind.isin(list(supported))
    n = F.coalesce("n_evidence", F.lit(0))
    return (
        queries.join(found, "query_id", "left")
        .join(benign, "query_id", "left")
        .select(
            *queries.columns,
            F.when(wrong | unsupported, "NOT_APPLICABLE")
            .when(n == 0, "NOT_FOUND")
            .when(F.coalesce("_benign", F.lit(False)), "REJECTED")
            .otherwise("INCONCLUSIVE")
            .alias("verdict"),
            F.when(wrong | unsupported, 0)
            .when(
                F.coalesce("_benign", F.lit(False)),
                F.least(n, F.lit(rules.BENIGN_EVIDENCE_LINES)),
            )
            .otherwise(n)
            .cast("bigint")
            .alias("n_evidence"),
            F.when(
                wrong,
                F.concat(F.lit("Query is for module '"), "target_module",
                         F.lit(f"', not '{module}'.")),
            )
            .when(
                unsupported,
                F.concat(F.lit(f"Module {module} does not handle entity type '"), kind, F.lit("'.")),
            )
            .when(
                n == 0,
                F.concat(F.lit("No matching lines found for "), kind, F.lit("='"), value,
                         F.lit("' in any artifact file.")),
            )
            .when(
                F.coalesce("_benign", F.lit(False)),
                F.concat(
                    F.lit("'"), value,
                    F.lit("' matches the trusted-path list and no suspicious indicator was found."),
                ),
            )
            .otherwise("Evidence found; manual review required.")
            .alias("justification"),
        )
    )
