"""Set-based detections over events, processes, files and records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor import rules
from spoor.functions import base_name, contains_any, ext_in
from spoor.operators.process import with_parent
from spoor.scale import lagged, last_before, running_sum, small_side

FAILURE, SUCCESS = 4625, 4624
# stretches of time that one task chains
STRETCHES = 4096


def seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000


def is_private(c: Column) -> Column:
    """RFC 1918, loopback, link-local, unspecified; also IPv6 local forms."""
    return c.rlike(
        r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.0\.0\.0$|::1?$|fe80:|f[cd])"
    )


# ---- logons ----------------------------------------------------------------------


def _looking_back(rows: DataFrame, within: int, measure: Callable, name: str) -> DataFrame:
    """``measure``, given a window, over the rows of a source in the ``within`` seconds up to each row.

    A source is cut into stretches of that length; rows are seen in their own stretch and
    the next, so no task holds more of a source than two stretches.
    """
    timed = rows.withColumn("_t", seconds("time")).withColumn("_s", F.floor(F.col("_t") / within))
    copies = timed.withColumns({"_s": F.col("_s") + 1, "_copy": F.lit(True)})
    span = Window.partitionBy("src", "_s").orderBy("_t").rangeBetween(-within, 0)
    return (
        timed.withColumn("_copy", F.lit(False))
        .unionByName(copies)
        .withColumn(name, measure(span))
        .where(~F.col("_copy"))
        .select(*rows.columns, name)
    )


def failure_bursts(ev: DataFrame, n: int = 10, within: int = 600) -> DataFrame:
    """Failures that are at least the ``n``-th of their source in the time before."""
    failed = ev.where(F.col("id") == FAILURE)
    counted = _looking_back(failed, within, lambda w: F.count(F.lit(1)).over(w), "failures")
    return counted.where(F.col("failures") >= n)


def brute_force(ev: DataFrame, n: int = 10, within: int = 600) -> DataFrame:
    """Sources with ``n`` failures inside any ``within`` seconds.

    ``failures`` is the largest such number; ``first`` and ``last`` are the times at which
    the threshold was first and last reached.
    """
    return failure_bursts(ev, n, within).groupBy("src").agg(
        F.max("failures").alias("failures"), F.min("time").alias("first"), F.max("time").alias("last")
    )


def password_spray(ev: DataFrame, k: int = 3, approximate: bool = False) -> DataFrame:
    """Sources whose failures name at least ``k`` users."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return ev.where(F.col("id") == FAILURE).groupBy("src").agg(
        count("user").alias("users"), F.count(F.lit(1)).alias("failures")
    ).where(F.col("users") >= k)


def burst_then_success(ev: DataFrame, n: int = 10, within: int = 600) -> DataFrame:
    """Successes with at least ``n`` failures from their source in the time before.

    A source is cut into stretches; failures are listed in their own stretch and
    the next, so no task sees more of a source than two stretches.
    """
    rows = ev.where(F.col("id").isin(FAILURE, SUCCESS)).withColumns(
        {"_t": seconds("time"), "_fail": F.col("id") == FAILURE}
    ).withColumn("_s", F.floor(F.col("_t") / within))
    copies = rows.where("_fail").withColumns({"_s": F.col("_s") + 1, "_copy": F.lit(True)})
    both = rows.withColumn("_copy", F.lit(False)).unionByName(copies)
    span = Window.partitionBy("src", "_s").orderBy("_t").rangeBetween(-within, 0)
    return (
        both.withColumn("failures", F.count_if("_fail").over(span))
        .where(~F.col("_copy") & ~F.col("_fail") & (F.col("failures") >= n))
        .select(*ev.columns, "failures")
    )


def remote_logons(ev: DataFrame) -> DataFrame:
    """Network logons from outside and remote-desktop logons from inside."""
    kind = F.when(
        (F.col("logon_type") == "3") & ~is_private(F.col("src_ip")), "external_network"
    ).when((F.col("logon_type") == "10") & is_private(F.col("src_ip")), "internal_desktop")
    return ev.where(F.col("id") == SUCCESS).withColumn("finding", kind).where(
        F.col("finding").isNotNull()
    )


def clear_then_activity(
    ev: DataFrame, cleared: Sequence[int] = rules.ALWAYS_EMIT_EVENTS, within: int = 600,
    by: Sequence[str] = ("computer",),
) -> DataFrame:
    """Events that follow a log clearing on the same host inside ``within`` seconds."""
    marks = ev.where(F.col("id").isin(list(cleared)))
    other = ev.where(~F.col("id").isin(list(cleared)))
    return last_before(
        other, marks, by, seconds("time"), seconds("time"), within, "cleared_at"
    ).where(F.col("cleared_at").isNotNull())


def repeated_clears(ev: DataFrame, cleared: Sequence[int] = rules.ALWAYS_EMIT_EVENTS) -> DataFrame:
    return ev.where(F.col("id").isin(list(cleared))).groupBy("computer").agg(
        F.count(F.lit(1)).alias("clears"), F.min("time").alias("first"), F.max("time").alias("last")
    ).where("clears > 1")


def account_changes(ev: DataFrame, severity: Mapping[int, str] = rules.ACCOUNT_EVENTS) -> DataFrame:
    """Account, group and service changes with their tier."""
    tier = F.create_map(*[F.lit(x) for p in severity.items() for x in p])
    return ev.where(F.col("id").isin(list(severity))).withColumn("severity", tier[F.col("id")])


def lateral_sweep(ev: DataFrame, k: int = 3, within: int = 600) -> DataFrame:
    """Sources with network logons to ``k`` hosts inside any ``within`` seconds.

    ``hosts`` is the largest such number; ``first`` and ``last`` are the times at which the
    threshold was first and last reached. A logon counts for its host in the ``within``
    seconds after it; these intervals are merged per source and host, and a running sum over
    their ends gives the hosts at every time. No row holds a set, and a source is cut into
    stretches of time.
    """
    step = within * 1_000_000
    logons = ev.where((F.col("id") == SUCCESS) & (F.col("logon_type") == "3") & F.col("src").isNotNull())
    times = (
        logons.groupBy("src", "computer", F.unix_micros(F.col("time").cast("timestamp")).alias("_t"))
        .agg(F.min("time").alias("_from"), F.max("time").alias("_until"))
        .where(F.col("_t").isNotNull())
    )
    stretch = F.floor(F.col("_t") / step)
    chained = lagged(times, ["src", "computer"], [F.col("_t")], stretch, F.col("_t"), "_before")
    opened = F.col("_before").isNull() | (F.col("_before") < F.col("_t") - step)
    counted = F.when(F.col("computer").isNotNull(), 1).otherwise(0).cast("bigint")
    none = F.lit(0).cast("bigint")
    steps = chained.select(
        "src", "_t", "_from", "_until", F.when(opened, counted).otherwise(none).alias("_plus"), none.alias("_minus")
    )
    # an interval ends after the last logon before a gap, and after the last one of all
    broken = chained.where(opened & F.col("_before").isNotNull()).select(
        "src", "computer", (F.col("_before") + step).alias("_t")
    )
    closed = broken.unionByName(
        times.groupBy("src", "computer").agg((F.max("_t") + step).alias("_t"))
    ).where(F.col("computer").isNotNull())
    ends = closed.select("src", "_t", none.alias("_plus"), F.lit(1).cast("bigint").alias("_minus"))
    points = steps.unionByName(ends, allowMissingColumns=True).groupBy("src", "_t").agg(
        F.sum("_plus").alias("_plus"), F.sum("_minus").alias("_minus"),
        F.min("_from").alias("_from"), F.max("_until").alias("_until"),
    ).withColumn("_change", F.col("_plus") - F.col("_minus"))
    open_now = running_sum(points, ["src"], [F.col("_t")], F.floor(F.col("_t") / step), "_change", "_open")
    # an interval still counts at its own end
    seen = open_now.withColumn("hosts", (F.col("_open") + F.col("_minus")).cast("int"))
    return seen.where(F.col("_from").isNotNull() & (F.col("hosts") >= k)).groupBy("src").agg(
        F.max("hosts").alias("hosts"), F.min("_from").alias("first"), F.max("_until").alias("last")
    )


def preceded_by(
    left: DataFrame, right: DataFrame, by: Sequence[str], within: int,
    left_time: str = "time", right_time: str = "time",
) -> DataFrame:
    """Left rows with the latest right time in the ``within`` seconds before them."""
    return last_before(
        left, right, by, seconds(left_time), seconds(right_time), within, "preceded_at"
    ).where(F.col("preceded_at").isNotNull())


# ---- processes -------------------------------------------------------------------


def command_rules(proc: DataFrame, table: Sequence[tuple[str, str]] = rules.COMMAND_RULES,
                  cmd: str = "cmd") -> DataFrame:
    """One row per (process, rule) whose pattern occurs in the command line."""
    low = F.lower(F.col(cmd))
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in table]))
    return proc.withColumn("rule", F.explode(hits))


def _shortened(name: Column) -> Column:
    """A text, and what is left of it without any one or two of its characters."""
    def without(one: Column) -> Column:
        places = F.when(F.length(one) > 0, F.sequence(F.lit(1), F.length(one))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            places,
            lambda i: F.concat(F.substring(one, F.lit(1), i - 1), F.substring(one, i + 1, F.length(one))),
        )

    once = F.array_distinct(without(name))
    return F.array_distinct(F.concat(F.array(name), once, F.flatten(F.transform(once, without))))


def near_names(names: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """``(name, known, distance)``: pairs at edit distance 1 to ``most`` (at most 2).

    Two texts within two edits agree after leaving out up to two characters of each, so they
    meet by equality on what is left. Names longer than the longest known one by more than
    ``most`` characters meet none and are not cut. Work grows with the distinct names.
    """
    if not 1 <= most <= 2:
        raise ValueError("most must be 1 or 2")
    listed = known.select(F.col("name").alias("known")).where(F.col("known").isNotNull()).distinct()
    longest = listed.agg(F.coalesce(F.max(F.length("known")), F.lit(0))).first()[0]
    asked = names.select("name").where(F.length("name") <= longest + most).distinct()
    left = asked.select("name", F.explode(_shortened(F.col("name"))).alias("_rest"))
    right = listed.select("known", F.explode(_shortened(F.col("known"))).alias("_rest"))
    return (
        left.join(small_side(right), "_rest")
        .select("name", "known")
        .distinct()
        .withColumn("distance", F.levenshtein("name", "known"))
        .where(F.col("distance").between(1, most))
    )


def typosquats(proc: DataFrame, known: Sequence[str] | DataFrame, image: str = "image") -> DataFrame:
    """Images at edit distance 1 or 2 from a known name that are no known name themselves.

    ``known`` is a list, or a table ``(name)`` of any length; ``resembles`` is sorted.
    """
    if not isinstance(known, DataFrame):
        known = proc.sparkSession.createDataFrame([(k,) for k in known], "name string")
    known = known.select(F.lower("name").alias("name")).where(F.col("name").isNotNull()).distinct()
    short = known.select(F.substring("name", 1, rules.NAME_LIMIT).alias("name"))
    names = proc.select(F.lower(F.col(image)).alias("name")).where(F.col("name").isNotNull()).distinct()
    new = names.join(small_side(known.unionByName(short).distinct()), "name", "left_anti")
    found = near_names(new, known).groupBy("name").agg(
        F.array_sort(F.collect_set("known")).alias("resembles")
    )
    return proc.withColumn("_low", F.lower(F.col(image))).join(
        small_side(found.select(F.col("name").alias("_low"), "resembles")), "_low"
    ).drop("_low")


def parentage(
    proc: DataFrame, expected: Mapping[str, str] = rules.EXPECTED_PARENTS, short: int = 2
) -> DataFrame:
    """Orphans, wrong parents and short-lived processes, as ``signals``.

    ``create_ts`` and ``exit_ts`` are timestamps.
    """
    want = F.create_map(*[F.lit(x) for p in expected.items() for x in p])[F.lower("image")]
    lived = seconds("exit_ts") - seconds("create_ts")
    related = with_parent(proc)
    signals = F.array_compact(
        F.array(
            F.when(F.col("parent_image").isNull() & (F.col("ppid") != 0), F.lit("orphan")),
            F.when(F.coalesce(F.col("parent_image"), F.lit("")) != want, F.lit("wrong_parent")),
            F.when(lived <= short, F.lit("short_lived")),
        )
    )
    return related.withColumn("signals", signals).where(F.size("signals") > 0)


def net_anomalies(nets: DataFrame, ports: Sequence[int] = rules.RED_FLAG_PORTS) -> DataFrame:
    """Connections to red-flag ports or established to public peers."""
    port = F.col("foreign_port").try_cast("int").isin(list(ports))
    public = (F.col("state") == "ESTABLISHED") & ~is_private(F.col("foreign_addr"))
    return nets.withColumns({"red_flag_port": port, "public_peer": public}).where(
        F.coalesce(port, F.lit(False)) | F.coalesce(public, F.lit(False))
    )


def shared_peers(nets: DataFrame) -> DataFrame:
    """Public peers reached by several connections."""
    return (
        nets.where(~is_private(F.col("foreign_addr")))
        .groupBy("foreign_addr")
        .agg(F.count(F.lit(1)).alias("connections"), F.count_distinct("pid").alias("processes"))
        .where("connections > 1")
    )


# ---- files and records -----------------------------------------------------------


def creation_clusters(
    files: DataFrame, gap: int = 300, n: int = 3, time: str = "created", by: Sequence[str] = ()
) -> DataFrame:
    """Runs of at least ``n`` creations with no pause longer than ``gap`` seconds.

    Creations are first counted per stretch of ``gap`` seconds: two of one stretch
    are never further apart than that, so only stretches need to be chained, and
    their number depends on the time span, not on the number of files.
    """
    by = list(by)
    t = seconds(time)
    stretches = files.withColumn("_s", F.floor(t / gap)).groupBy(*by, "_s").agg(
        F.min(t).alias("_a"), F.max(t).alias("_z"), F.count(F.lit(1)).alias("_n")
    )
    # chained in blocks of stretches, so that no task holds the whole span
    block = F.floor(F.col("_s") / STRETCHES)
    order = [F.col("_s")]
    before = lagged(stretches, by, order, block, F.col("_z"), "_before")
    new = F.coalesce(F.col("_a") - F.col("_before") > gap, F.lit(True)).cast("int")
    runs = running_sum(before.withColumn("_new", new), by, order, block, "_new", "_run")
    return (
        runs.groupBy(*by, "_run")
        .agg(F.sum("_n").alias("files"), F.min("_a").alias("start_s"), F.max("_z").alias("end_s"))
        .where(F.col("files") >= n)
        .drop("_run")
    )


def impersonation(
    files: DataFrame, known: Mapping[str, str] = rules.SYSTEM_IMAGE_DIRS, path: str = "path"
) -> DataFrame:
    """System image names outside their directory."""
    low = F.lower(F.replace(F.col(path), F.lit("/"), F.lit("\\")))
    home = F.create_map(*[F.lit(x) for p in known.items() for x in p])[base_name(low)]
    return files.where(home.isNotNull() & ~low.startswith(home))


def hidden_streams(files: DataFrame, paths: Sequence[str] = rules.SUSPICIOUS_PATHS) -> DataFrame:
    """Alternate streams other than the zone mark, and deleted files in suspicious paths."""
    other = F.exists(
        F.split(F.coalesce("ads", F.lit("")), ";"),
        lambda s: (F.trim(s) != "") & ~F.lower(s).contains("zone.identifier"),
    )
    gone = F.coalesce(F.col("deleted"), F.lit(False)) & contains_any(F.col("path"), paths)
    return files.withColumns({"other_stream": other, "deleted_suspicious": gone}).where(
        other | gone
    )


def risky_downloads(
    history: DataFrame, extensions: Sequence[str] = rules.DOWNLOAD_EXTENSIONS
) -> DataFrame:
    """Executable downloads and hits on raw-IP addresses."""
    runs = (F.col("event") == "download") & ext_in(F.col("download_path"), extensions)
    raw = F.col("url").rlike(r"^[a-z]+://\d{1,3}(\.\d{1,3}){3}([:/?#]|$)")
    return history.withColumns(
        {"executable": F.coalesce(runs, F.lit(False)), "raw_ip": F.coalesce(raw, F.lit(False))}
    ).where(F.col("executable") | F.col("raw_ip"))


def writable_autoruns(
    records: DataFrame, paths: Sequence[str] = rules.SUSPICIOUS_PATHS,
    cols: Sequence[str] = ("action", "data", "path"),
) -> DataFrame:
    """Autoruns and tasks that point at user-writable places."""
    have = [F.col(c) for c in cols if c in records.columns]
    target = F.coalesce(*[F.nullif(c, F.lit("")) for c in have])
    return records.withColumn("target", target).where(contains_any(F.col("target"), paths))


def renamed_hashes(records: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """Hashes seen under several file names."""
    return records.where(F.col(digest).isNotNull()).groupBy(F.lower(digest).alias("hash")).agg(
        F.count_distinct(F.lower(base_name(F.col(path)))).alias("names"),
        F.count(F.lit(1)).alias("records"),
    ).where("names > 1")
