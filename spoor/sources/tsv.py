"""Memory-tool tables: banner, header, ragged tab-separated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import rules
from spoor.scale import first_per_key, small_side
from spoor.sources.kv import last_wins_map
from spoor.sources.lines import read_lines


def parse_tool_tsv(lines: DataFrame, keys: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """``(*keys, line_no, row MAP)`` from numbered lines of one or many files."""
    keys = list(keys)
    filled = lines.where(F.trim(F.col("content")) != "")
    banner = filled.groupBy(*keys).agg(
        F.min(F.when(F.col("content").startswith(rules.TOOL_BANNER), F.col("line_no"))).alias(
            "banner_no"
        )
    )
    after = filled.join(small_side(banner), keys).where(
        F.col("line_no") > F.coalesce(F.col("banner_no"), F.lit(0))
    )
    header = after.groupBy(*keys).agg(
        F.min("line_no").alias("header_no"), F.min_by("content", "line_no").alias("header")
    )
    names = F.split(F.col("header"), "\t", -1)
    cells = F.split(F.col("content"), "\t", -1)
    n, m = F.size(names), F.size(cells)
    tail = F.array_join(F.slice(cells, n, F.greatest(m - n + 1, F.lit(1))), "\t")
    fitted = F.when(
        m > n, F.concat(F.slice(cells, F.lit(1), n - 1), F.array(tail))
    ).otherwise(F.concat(cells, F.array_repeat(F.lit(""), n - m)))
    pairs = F.transform(
        F.arrays_zip(names.alias("k"), fitted.alias("v")),
        lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")),
    )
    return (
        filled.join(small_side(header), keys)
        .where(F.col("line_no") > F.col("header_no"))
        .select(*keys, "line_no", last_wins_map(pairs).alias("row"))
    )


def read_tool_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_tool_tsv(read_lines(spark, path))


# ---- typed tables ----------------------------------------------------------------


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col("row")[name], F.lit("")))


def _blank(c: Column, tokens: tuple[str, ...] = ("-", "N/A")) -> Column:
    return F.when(c.isin(*tokens), "").otherwise(c)


def _int(name: str) -> Column:
    return F.nullif(_blank(_text(name)), F.lit("")).try_cast("int")


def _true(name: str) -> Column:
    return F.lower(_text(name)).isin("true", "1", "yes")


def clean_path(c: Column) -> Column:
    """Null marks removed, the kernel's root alias rewritten to a drive path."""
    text = _blank(c)
    return F.regexp_replace(text, r"(?i)^\\SystemRoot\\", r"C:\\Windows\\")


def process_table(rows: DataFrame, via: str) -> DataFrame:
    """Typed process rows; ``via`` is ``pstree`` (full columns) or ``psscan``."""
    pid = F.trim(F.regexp_replace(F.coalesce(F.col("row")["PID"], F.lit("")), r"^[* ]+", "")) \
        if via == "pstree" else _text("PID")
    full = via == "pstree"
    return rows.where(pid.rlike("^[0-9]+$")).select(
        "case_id",
        "line_no",
        pid.try_cast("bigint").alias("pid"),
        F.coalesce(_int("PPID"), F.lit(0)).cast("bigint").alias("ppid"),
        _text("ImageFileName").alias("image"),
        (clean_path(_text("Path")) if full else F.lit("")).alias("path"),
        (_text("Audit") if full else F.lit("")).alias("device_path"),
        (_blank(_text("Cmd")) if full else F.lit("")).alias("cmd"),
        _true("Wow64").alias("wow64"),
        _int("SessionId").alias("session"),
        F.coalesce(_int("Threads"), F.lit(0)).alias("threads"),
        _text("CreateTime").alias("create_time"),
        _blank(_text("ExitTime")).alias("exit_time"),
        F.lit(via).alias("discovered_via"),
    )


def _child(rows: DataFrame, columns: dict[str, Column], keep: Column) -> DataFrame:
    pid = _text("PID")
    return rows.where(pid.rlike("^[0-9]+$")).select(
        "case_id", "line_no", pid.try_cast("bigint").alias("pid"),
        *[c.alias(n) for n, c in columns.items()],
    ).where(keep)


def typed_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Six typed tables (plus the command-line table) from parsed tool rows.

    ``rows`` has ``case_id, source_file, line_no, row``. A missing file gives an
    empty table of the same schema.
    """

    def of(name: str) -> DataFrame:
        return rows.where(F.col("source_file") == name)

    net = {
        "proto": _text("Proto"), "local_addr": _text("LocalAddr"),
        "local_port": _text("LocalPort"), "foreign_addr": _text("ForeignAddr"),
        "foreign_port": _text("ForeignPort"), "state": _text("State"),
    }
    always = F.lit(True)
    cmdline = _child(of("cmdline.txt"), {"args": _text("Args")},
                     ~F.col("args").isin("", "-", "N/A"))
    listed = process_table(of("pstree.txt"), "pstree")
    scanned = process_table(of("psscan.txt"), "psscan")
    return {
        "listed": listed,
        "scanned": scanned,
        "cmdline": cmdline,
        "process": fill_cmd(priority_union(listed, scanned, ["case_id", "pid"]), cmdline),
        "dll": _child(of("dlllist.txt"), {
            "name": _text("Name"), "path": _text("Path"), "load_time": _text("LoadTime")}, always),
        "handle": _child(of("handles.txt"), {"type": _text("Type"), "name": _text("Name")},
                         (F.col("type") != "") | (F.col("name") != "")),
        "privilege": _child(of("privileges.txt"), {
            "privilege": _text("Privilege"), "attributes": _text("Attributes")},
            F.col("privilege") != ""),
        "net": _child(of("netscan.txt"), {**net, "source": F.lit("netscan")}, always).unionByName(
            _child(of("netstat.txt"), {**net, "source": F.lit("netstat")}, always)),
        "sid": _child(of("getsids.txt"), {"sid": _text("SID"), "name": _text("Name")},
                      F.col("sid") != ""),
    }


def load_process_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Typed tables of a folder of tool output; each sub-folder path is one case."""
    lines = read_lines(spark, folder).withColumn(
        "case_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    )
    return typed_tables(parse_tool_tsv(lines, ("case_id", "source_file")))


def priority_union(primary: DataFrame, secondary: DataFrame, keys: list[str],
                   order: str = "line_no") -> DataFrame:
    """Primary rows win; secondary adds unseen keys; first row of a key on each side.

    One aggregation with map-side combine instead of an anti-join.
    """
    both = primary.withColumn("_side", F.lit(0)).unionByName(
        secondary.withColumn("_side", F.lit(1))
    )
    return first_per_key(both, keys, F.struct("_side", order)).drop("_side")


def fill_cmd(proc: DataFrame, cmdline: DataFrame) -> DataFrame:
    """Fill an empty ``cmd`` from the command-line table; its last row per pid wins."""
    last = cmdline.groupBy("case_id", "pid").agg(F.max_by("args", "line_no").alias("_args"))
    return proc.join(last, ["case_id", "pid"], "left").withColumn(
        "cmd", F.coalesce(F.nullif(F.col("cmd"), F.lit("")), F.col("_args"), F.lit(""))
    ).drop("_args")
