"""File records: scores, tags, ranking, statistics, time windows, path reconstruction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import rules
from spoor.functions import contains_any, ext_in, iso_z, parse_iso, under_prefix
from spoor.scale import first_per_key, fits, small_side
from spoor.session import durable


@dataclass(frozen=True)
class FileRules:
    """Values a site may change; the defaults are the fixed ones."""

    suspicious: Sequence[str] = field(default_factory=lambda: rules.SUSPICIOUS_PATHS)
    trusted: Sequence[str] = field(default_factory=lambda: rules.TRUSTED_FILE_PREFIXES)
    system_binaries: Sequence[str] = field(default_factory=lambda: rules.SYSTEM_BINARY_PREFIXES)
    escalated: Sequence[str] = field(default_factory=lambda: rules.ALWAYS_ESCALATED_TAGS)
    scored_extensions: Sequence[str] = field(default_factory=lambda: rules.SCORED_EXTENSIONS)
    tagged_extensions: Sequence[str] = field(default_factory=lambda: rules.TAGGED_EXTENSIONS)
    entropy_scored: float = rules.ENTROPY_SCORED
    entropy_tagged: float = rules.ENTROPY_TAGGED
    entropy_counted: float = rules.ENTROPY_COUNTED
    tag_delta: float = rules.TAG_DELTA_SECONDS
    window: tuple[Column, Column] | None = None
    threshold: int = rules.SCORE_THRESHOLD
    top_n: int = rules.TOP_FILES
    compat: bool = False


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000


def _with_facts(df: DataFrame, cfg: FileRules) -> DataFrame:
    """Facts the rules share, computed once per row as ``_`` columns.

    Input: path, entropy, ads, created, fn_created.
    """
    path = F.coalesce(F.col("path"), F.lit(""))
    inside = F.lit(False)
    if cfg.window:
        inside = F.coalesce(F.col("created").between(*cfg.window), F.lit(False))
    return df.withColumns(
        {
            "_low": F.lower(path),
            "_runs_scored": ext_in(path, cfg.scored_extensions),
            "_runs_tagged": ext_in(path, cfg.tagged_extensions),
            "_hot": contains_any(path, cfg.suspicious),
            "_trusted": under_prefix(path, cfg.trusted, cfg.compat),
            "_entropy": F.coalesce(F.col("entropy").cast("double"), F.lit(0.0)),
            "_gap": _seconds("created") - _seconds("fn_created"),
            "_no_zone": ~F.lower(F.coalesce(F.col("ads"), F.lit(""))).contains("zone.identifier"),
            "_inside": inside,
        }
    )


_FACTS = [
    "_low", "_runs_scored", "_runs_tagged", "_hot", "_trusted", "_entropy", "_gap", "_no_zone",
    "_inside",
]


def _far() -> Column:
    return F.coalesce(F.abs("_gap") > rules.SCORE_DELTA_SECONDS, F.lit(False))


def score_files(df: DataFrame, cfg: FileRules = FileRules()) -> DataFrame:
    """Adds ``score``, a sum of independent signals. ``known_good`` is optional."""
    wide = _with_facts(df, cfg)
    runs = F.col("_runs_scored")

    def points(n: int, when: Column) -> Column:
        return F.when(when, n).otherwise(0)

    good = F.coalesce(F.col("known_good"), F.lit(False)) if "known_good" in df.columns else F.lit(False)
    depth = F.length(F.col("_low")) - F.length(F.replace(F.col("_low"), F.lit("\\"), F.lit("")))
    score = (
        points(4, runs & F.col("_hot") & ~F.col("_trusted"))
        + points(3, (F.col("_entropy") > cfg.entropy_scored) & ~F.col("_low").contains("program files"))
        + points(3, _far() & F.col("_hot"))
        + points(2, F.col("_inside"))
        + points(
            2,
            F.col("_low").contains("\\$recycle.bin")
            | (F.col("_low").contains("\\programdata\\") & ~F.col("_trusted")),
        )
        + points(2, runs & ~F.col("_trusted") & F.col("_no_zone"))
        - points(5, good)
        + points(
            1, (depth > 8) & (F.col("_low").contains("windows\\") | F.col("_low").contains("program files"))
        )
    )
    return wide.withColumn("score", score).drop(*_FACTS)


def tag_files(
    df: DataFrame, cfg: FileRules = FileRules(), install_date: Column | None = None
) -> DataFrame:
    """Adds ``tags``: named anomalies with their detail, empty when trusted and not escalated."""
    wide = _with_facts(df, cfg)
    runs = F.col("_runs_tagged")
    mismatch = F.coalesce(F.col("magic_mismatch"), F.lit("")) if "magic_mismatch" in df.columns else F.lit("")
    back = -F.col("_gap")
    early = F.lit(False) if install_date is None else F.coalesce(
        F.col("created") < install_date, F.lit(False)
    )

    def whole(c: Column) -> Column:
        return F.call_function("format_number", c, F.lit("0"))

    tags = F.array_compact(
        F.array(
            F.when(mismatch != "", F.concat(F.lit("extension_magic_mismatch:"), mismatch)),
            F.when(F.col("_low").contains("$recycle.bin") & runs, F.lit("recycle_bin_executable")),
            F.when(
                (F.col("_entropy") > cfg.entropy_tagged) & ~F.col("_trusted"),
                F.concat(F.lit("high_entropy:entropy="), F.call_function("format_number", F.col("_entropy"), F.lit("0.00"))),
            ),
            F.when(runs & F.col("_hot") & F.col("_no_zone"), F.lit("missing_zone_identifier")),
            F.when(
                F.col("_hot") & (F.abs(F.col("_gap")) > cfg.tag_delta),
                F.concat(F.lit("si_fn_mismatch:"), whole(F.abs(F.col("_gap"))), F.lit("s")),
            ),
            F.when(
                under_prefix(F.col("path"), cfg.system_binaries, cfg.compat)
                & runs
                & (back > cfg.tag_delta),
                F.concat(F.lit("system_path_timestomp:"), whole(back), F.lit("s")),
            ),
            F.when(
                F.col("_hot") & early,
                F.concat(F.lit("pre_install_date:si="), iso_z(F.col("created").cast("timestamp"))),
            ),
        )
    )
    names = F.transform("_tags", lambda t: F.substring_index(t, ":", 1))
    loud = F.arrays_overlap(names, F.array(*[F.lit(e) for e in cfg.escalated]))
    return wide.withColumn("_tags", tags).withColumn(
        "tags",
        F.when(F.col("_trusted") & ~loud, F.array().cast("array<string>")).otherwise(
            F.col("_tags")
        ),
    ).drop("_tags", *_FACTS)


def top_files(scored: DataFrame, cfg: FileRules = FileRules(), order: str = "line_no") -> DataFrame:
    """The best files above the threshold, ties in source order."""
    best = scored.orderBy(F.desc("score"), order).limit(cfg.top_n)
    return best.where(F.col("score") >= cfg.threshold)


def file_disposition(
    scored: DataFrame, cfg: FileRules = FileRules(), order: str = "line_no"
) -> DataFrame:
    """Every file with ``passed``, ``overflow`` (good score, beyond the top), ``rejected``
    (some signal, low score) or ``clean``. The score and order of the last passed
    file decide, so no global ranking is needed."""
    last = top_files(scored, cfg, order).agg(
        F.min("score").alias("_s"),
        F.max(F.struct(-F.col("score"), F.col(order).alias("o"))).alias("_last"),
    )
    passed = (F.col("score") > F.col("_s")) | (
        (F.col("score") == F.col("_s")) & (F.col(order) <= F.col("_last.o"))
    )
    return (
        scored.join(F.broadcast(last))  # one row
        .withColumn(
            "disposition",
            F.when((F.col("score") >= cfg.threshold) & passed, "passed")
            .when(F.col("score") >= cfg.threshold, "overflow")
            .when((F.col("score") > 0) | (F.size("tags") > 0), "rejected")
            .otherwise("clean"),
        )
        .drop("_s", "_last")
    )


def file_stats(scored: DataFrame, cfg: FileRules = FileRules()) -> DataFrame:
    """One row of statistics over the whole table, in one pass."""
    runs = F.col("_runs_scored")
    n = F.col("score")
    above = F.count_if(n >= cfg.threshold)
    return _with_facts(scored, cfg).agg(
        F.count(F.lit(1)).alias("total_records"),
        above.alias("above_threshold"),
        F.least(above, F.lit(cfg.top_n).cast("bigint")).alias("filtered_in"),
        (F.count(F.lit(1)) - above).alias("filtered_out"),
        F.count_if(n >= 6).alias("score_ge6"),
        F.count_if(n.between(4, 5)).alias("score_4_5"),
        F.count_if(n == 3).alias("score_3"),
        F.count_if(
            (F.col("_entropy") > cfg.entropy_counted) & ~F.col("_low").contains("program files")
        ).alias("entropy_anomalies"),
        F.count_if(_far()).alias("timestomping_candidates"),
        F.count_if(runs & F.col("_hot") & F.col("_no_zone")).alias("missing_zone_id"),
        F.count_if(F.col("_inside")).alias("attack_window_hits"),
    )


LEVELS = 40  # cells of up to 2**40 seconds


def _cells(first: str, last: str) -> Column:
    """The fewest cells of doubling width that cover whole seconds ``first`` to ``last``.

    At each level only the outermost of the cells inside can miss a cell of the next level,
    so a window has at most two cells a level, however long it is.
    """
    inside = F.expr(
        f"transform(sequence(0, {LEVELS}), l -> named_struct('level', l,"
        f" 'lo', -shiftright(-{first}, l), 'hi', shiftright({last} + 1, l) - 1))"
    )
    left = F.transform(
        F.filter(inside, lambda c: (c["lo"] <= c["hi"]) & (F.pmod(c["lo"], F.lit(2)) == 1)),
        lambda c: F.struct(c["level"].alias("level"), c["lo"].alias("cell")),
    )
    right = F.transform(
        F.filter(inside, lambda c: (c["lo"] <= c["hi"]) & (F.pmod(c["hi"], F.lit(2)) == 0)),
        lambda c: F.struct(c["level"].alias("level"), c["hi"].alias("cell")),
    )
    return F.array_distinct(F.concat(left, right))


def in_window(df: DataFrame, windows: DataFrame, time: str = "created") -> DataFrame:
    """Rows whose time lies in an attack window ``(window_id, start, end)``, bounds included.

    A window is listed under the few cells that cover it, a row under one cell of each level
    that windows use, so the join is an equality on the cell plus the exact bounds, for
    windows of seconds and of decades alike. Rows and windows without a time meet nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = windows.withColumns(
        {"_from": micros("start"), "_to": micros("end")}
    ).withColumns(
        {"_a": F.floor(F.col("_from") / 1_000_000), "_b": F.floor(F.col("_to") / 1_000_000)}
    ).where(F.col("_from") <= F.col("_to"))
    listed = durable(
        spans.withColumn("_c", F.explode(_cells("_a", "_b")))
        .withColumns({"_level": F.col("_c")["level"], "_cell": F.col("_c")["cell"]})
        .drop("start", "end", "_a", "_b", "_c")
    )
    levels = sorted(r[0] for r in listed.select("_level").distinct().collect())  # LEVELS at most
    rows = df.withColumns(
        {"_us": micros(time), "_level": F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))}
    ).withColumn("_cell", F.expr("shiftright(floor(_us / 1000000), _level)"))
    return (
        rows.join(small_side(listed), ["_level", "_cell"])
        .where(F.col("_us").between(F.col("_from"), F.col("_to")))
        .drop("_level", "_cell", "_us", "_from", "_to")
    )


BLOOM_WORDS = 1 << 20  # 64 bits each: with its key 16 MB at most
BLOOM_KEYS = 4  # hashes a word is made for: 16 bits each


def _bloom(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a blocked Bloom filter that a key belongs to, and its three bits there."""
    more = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for n in range(3):
        at = F.shiftright(more, 6 * n).bitwiseAND(F.lit(63))
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int")))
    return F.pmod(F.xxhash64(key), F.lit(words)), mask


def known_good(df: DataFrame, hashes: DataFrame, col: str = "hash") -> DataFrame:
    """Flags files whose hash is on a known-good list ``(hash)``.

    A small list is broadcast. Of a large one a Bloom filter of bounded size is: only files
    that it lets through are shuffled to the list, and the others are known not to be on it.
    """
    listed = hashes.select(F.lower("hash").alias("_h")).where(F.col("_h").isNotNull()).distinct()
    if fits(listed):
        flagged = listed.withColumn("_known", F.lit(True))
        return (
            df.join(F.broadcast(flagged), F.lower(F.col(col)) == F.col("_h"), "left")
            .withColumn("known_good", F.coalesce("_known", F.lit(False)))
            .drop("_h", "_known")
        )
    listed = durable(listed)
    words = max(1, min(BLOOM_WORDS, listed.count() // BLOOM_KEYS))
    word, mask = _bloom(F.col("_h"), words)
    bits = listed.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    word, mask = _bloom(F.lower(F.col(col)), words)
    marked = df.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(bits), "_word", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)) & F.col(col).isNotNull()
    sifted = marked.withColumn("_maybe", maybe).drop("_word", "_mask", "_bits")
    tested = (
        sifted.where("_maybe")
        .join(listed.withColumn("_known", F.lit(True)), F.lower(F.col(col)) == F.col("_h"), "left")
        .withColumn("known_good", F.coalesce("_known", F.lit(False)))
        .drop("_h", "_known", "_maybe")
    )
    return tested.unionByName(sifted.where("not _maybe").drop("_maybe").withColumn("known_good", F.lit(False)))


def install_date(records: DataFrame) -> DataFrame:
    """One row: the first usable install date (epoch above 10^9, or ISO text).

    ``records`` has value, data and line_no.
    """
    epoch = F.trim("data").try_cast("bigint")
    moment = F.coalesce(F.when(epoch > 1_000_000_000, F.timestamp_seconds(epoch)), parse_iso(F.col("data")))
    return (
        records.where(F.lower("value") == "installdate")
        .select("line_no", moment.alias("_m"))
        .where(F.col("_m").isNotNull())
        .agg(F.min_by("_m", "line_no").alias("install_date"))
    )


def magic_records(files: DataFrame) -> DataFrame:
    """Static facts of file bodies: hash, size, magic mismatch."""
    from spoor.functions import magic_mismatch

    return files.select(
        "path",
        F.sha2(F.col("content"), 256).alias("sha256"),
        F.length("content").cast("bigint").alias("size"),
        magic_mismatch(F.col("path"), F.col("content")).alias("magic_mismatch"),
    )


# bytes of a body that one row holds
SLICE = 65_536


def entropy(df: DataFrame, key: Sequence[str], text: str, digits: int = 3) -> DataFrame:
    """Shannon entropy in bits of the bytes of a text or binary column, per key.

    A body is first cut into slices of fixed size, each a row of its own, and symbols are
    counted with map-side combine, so no row grows with the body.
    """
    body = F.col(text).cast("binary")
    last = F.floor(F.greatest(F.octet_length(body) - 1, F.lit(0)) / SLICE).cast("int")
    slices = df.select(*key, body.alias("_body"), F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    cut = slices.select(*key, F.substring("_body", F.col("_i") * SLICE + 1, SLICE).alias("_part")).where(
        F.octet_length("_part") > 0
    )
    # one byte a row, taken by its place: bytes are not written out as text
    places = F.explode(F.sequence(F.lit(1), F.octet_length("_part"))).alias("_at")
    symbols = cut.select(*key, "_part", places).select(
        *key, F.substring("_part", F.col("_at"), F.lit(1)).alias("_s")
    )
    n = F.col("_n")
    return (
        symbols.groupBy(*key, "_s")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*key)
        .agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"))
        .withColumn("entropy", F.round(F.abs("entropy"), digits))
    )


# ---- path reconstruction ---------------------------------------------------------

_NAMESPACE_RANK = {3: 0, 1: 1, 0: 2, 2: 3}  # both, win32, posix, dos
ROOT = 5


def best_names(names: DataFrame) -> DataFrame:
    """The preferred name of each entry: ``(volume, idx, parent, name)``.

    ``names`` has volume, idx, ord, namespace, parent, name; entries without a
    name have a null ``name``.
    """
    rank = F.coalesce(
        F.create_map(*[F.lit(x) for p in _NAMESPACE_RANK.items() for x in p])[F.col("namespace")],
        F.lit(99),
    )
    order = F.struct(F.col("name").isNull(), rank, F.col("ord"))
    return first_per_key(
        names.withColumn("_order", order), ["volume", "idx"], F.col("_order")
    ).select("volume", "idx", "parent", "name")


def _jump(state: DataFrame) -> DataFrame:
    """One doubling step: every pending entry takes over the path and pointer of its target."""
    target = state.select(
        "volume", F.col("idx").alias("up"), F.col("up").alias("_up"),
        F.col("path").alias("_path"), F.col("low").alias("_low"),
    )
    pending = state.where(F.col("up").isNotNull()).join(target, ["volume", "up"])
    moved = pending.select(
        "volume", "idx",
        F.col("_up").alias("up"),
        F.concat("_path", F.lit("\\"), "path").alias("path"),
        F.least("low", "_low").alias("low"),
    )
    return state.where(F.col("up").isNull()).unionByName(moved)


def _double(state: DataFrame) -> tuple[DataFrame, int]:
    """Doubling steps until a step resolves nothing; returns the state and what is pending."""
    state = durable(state)
    pending = state.where(F.col("up").isNotNull()).count()
    while pending:
        state = durable(_jump(state))
        left = state.where(F.col("up").isNotNull()).count()
        if left == pending:
            break
        pending = left
    return state, pending


def resolve_paths(entries: DataFrame) -> DataFrame:
    """Full path of every entry from parent references: ``(volume, idx, path)``.

    ``entries`` has volume, idx, parent, name (one row per entry). The root is 5.
    A missing or nameless parent gives ``<orphan>\\name``; a cycle is broken at the
    edge into its lowest index. Pointers are doubled, so a tree of depth d takes
    log2(d) equality joins, each cut durably.
    """
    e = entries.where(F.col("idx") != ROOT)
    parents = entries.select("volume", F.col("idx").alias("parent"),
                             (F.col("name").isNotNull() | (F.col("idx") == ROOT)).alias("_named"))
    linked = e.where(F.col("name").isNotNull()).join(parents, ["volume", "parent"], "left")
    start = linked.select(
        "volume", "idx",
        F.when((F.col("parent") != ROOT) & F.coalesce("_named", F.lit(False)), F.col("parent"))
        .alias("up"),
        F.when(
            (F.col("parent") == ROOT) | F.coalesce("_named", F.lit(False)), F.col("name")
        ).otherwise(F.concat(F.lit("<orphan>\\"), "name")).alias("path"),
        F.col("idx").alias("low"),
    )
    state, pending = _double(start)
    done = state.where(F.col("up").isNull()).select("volume", "idx", "path")
    if pending:
        loops = _break_cycles(state, linked)
        done = done.unionByName(loops)
    nameless = e.where(F.col("name").isNull()).select(
        "volume", "idx", F.lit("<no-fn>").alias("path")
    )
    root = entries.where(F.col("idx") == ROOT).select("volume", "idx", F.lit("").alias("path"))
    return done.unionByName(nameless).unionByName(root)


def _break_cycles(state: DataFrame, linked: DataFrame) -> DataFrame:
    stuck = state.where(F.col("up").isNotNull()).select("volume", "idx", "up", "low")
    # Widen the minimum until it is stable, so that it covers each whole cycle, and
    # until the set of targets stops shrinking, so that every target is on a cycle.
    targets = None
    while True:
        target = stuck.select("volume", F.col("idx").alias("up"), F.col("up").alias("_up"),
                              F.col("low").alias("_low"))
        wider = durable(
            stuck.join(target, ["volume", "up"]).select(
                "volume", "idx", F.col("_up").alias("up"), F.least("low", "_low").alias("low"),
                (F.col("_low") < F.col("low")).alias("_changed"),
            )
        )
        seen = wider.agg(
            F.count_distinct("volume", "up").alias("n"), F.count_if("_changed").alias("c")
        ).first()
        stuck = wider.drop("_changed")
        if seen["c"] == 0 and seen["n"] == targets:
            break
        targets = seen["n"]
    members = stuck.select("volume", F.col("up").alias("idx")).distinct().join(
        stuck.select("volume", "idx", "low"), ["volume", "idx"]
    )
    edges = linked.join(stuck.select("volume", "idx"), ["volume", "idx"]).join(
        members.select("volume", "idx", F.col("low").alias("_entry")), ["volume", "idx"], "left"
    )
    cut = F.coalesce(F.col("parent") == F.col("_entry"), F.lit(False))
    again, _ = _double(
        edges.select(
            "volume", "idx",
            F.when(~cut, F.col("parent")).alias("up"),
            F.when(cut, F.concat(F.lit("<orphan>\\"), "name")).otherwise(F.col("name")).alias("path"),
            F.col("idx").alias("low"),
        )
    )
    return again.where(F.col("up").isNull()).select("volume", "idx", "path")


