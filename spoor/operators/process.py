"""Process snapshots: merged tables, benign exclusion, forest, packing, anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor import rules
from spoor.functions import (
    contains_any,
    glob_any,
    notable_privs,

)
from spoor.scale import first_per_key, fits, lagged, ordinal, running_sum, small_side, tasks_for
from spoor.session import durable

KEY = ["case_id", "pid"]


def is_alive(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).isin("", "N/A")


def with_parent(proc: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds ``parent_image``, ``parent_path``, ``parent_cmd``; null when there is no parent.

    ``tasks`` is the number of tasks that meet, see :func:`spoor.scale.tasks_for`.
    """
    parents = proc.select(
        "case_id",
        F.col("pid").alias("ppid"),
        F.lower("image").alias("parent_image"),
        F.lower("path").alias("parent_path"),
        F.lower("cmd").alias("parent_cmd"),
    )
    if tasks:
        proc, parents = (df.repartition(tasks, "case_id", "ppid") for df in (proc, parents))
    return proc.join(parents, ["case_id", "ppid"], "left")


# ---- child tables ----------------------------------------------------------------


def merge_net(net: DataFrame) -> DataFrame:
    """One row per connection; the first non-empty netstat state wins, else the first state.

    States go through the aggregate as numbers: with texts in its buffer it would sort all
    rows twice by all columns of the key. The distinct states are few and are looked up after.
    """
    key = ["case_id", "pid", "proto", "local_addr", "local_port", "foreign_addr", "foreign_port"]
    state = F.nullif(F.col("state"), F.lit(""))
    known = durable(net.select(state.alias("state")).where("state is not null").distinct())
    known = known.select(F.xxhash64("state").alias("_code"), "state")
    if not known.groupBy("_code").count().where("count > 1").isEmpty():
        return _merge_net_by_text(net, key)
    # unknown sources come first, netstat last, as in the order of the struct
    stat = F.col("source") == "netstat"
    places = {"none": stat.isNull(), "scan": ~stat, "stat": stat}
    line = F.coalesce(F.col("line_no").cast("long"), F.lit(-(1 << 63)))
    coded = net.select(
        *key, F.when(state.isNotNull(), F.xxhash64(state)).alias("_code"),
        *[F.when(is_it, line).alias(f"_{name}") for name, is_it in places.items()],
    )
    merged = coded.groupBy(*key).agg(
        *[F.min(f"_{name}").alias(f"_{name}") for name in places],
        *[F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col(f"_{name}"))).alias(f"_{name}_code") for name in places],
    )
    code = F.coalesce("_stat_code", "_none_code", "_scan_code")
    first = F.coalesce(*[
        F.when(F.col(f"_{name}").isNotNull(), F.struct(
            F.lit({"none": None, "scan": False, "stat": True}[name]).cast("boolean").alias("col1"),
            F.nullif(F.col(f"_{name}"), F.lit(-(1 << 63))).alias("line_no")))
        for name in ("none", "scan", "stat")
    ])
    return merged.select(*key, code.alias("_code"), first.alias("ord")).join(
        small_side(known), "_code", "left"
    ).select(*key, F.coalesce("state", F.lit("")).alias("state"), "ord")


def _merge_net_by_text(net: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same for states of which two have the same 64-bit hash."""
    order = F.struct(F.col("source") == "netstat", F.col("line_no"))
    state = F.nullif(F.col("state"), F.lit(""))
    stat = F.when(F.col("source") == "netstat", state)
    return net.groupBy(*key).agg(
        F.coalesce(
            F.min_by(stat, F.when(stat.isNotNull(), order)),
            F.min_by(state, F.when(state.isNotNull(), order)),
            F.lit(""),
        ).alias("state"),
        F.min(order).alias("ord"),
    )


def _ordered(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One ordered list per process. A list is part of the process row by contract."""
    # sort_array compares natively; array_sort would run a lambda for every comparison
    return (
        df.groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("ord"), value.alias("v")))).alias("_l"))
        .select(*KEY, F.col("_l")["v"].alias(name))
    )


def collect_children(tables: Mapping[str, DataFrame], lists: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Ordered lists per process, duplicates removed before anything is collected."""
    dll = tables["dll"].withColumn(
        "_v", F.coalesce(F.nullif(F.col("path"), F.lit("")), F.col("name"))
    ).withColumn("_k", F.lower("_v")).where(F.col("_k") != "")
    # texts in the buffer make the aggregate sort by its keys in their order: the number comes first,
    # because it decides most comparisons and the case next to none
    dll = dll.groupBy("pid", "case_id", "_k").agg(
        F.min_by("_v", "line_no").alias("_v"), F.min("line_no").alias("ord")
    )
    # equal sids, which are many, are first counted down to one row without any sort
    sid = tables["sid"].groupBy(*KEY, "sid", "name").agg(F.min("line_no").alias("ord")).groupBy(
        *KEY, F.lower("sid").alias("_k")
    ).agg(F.min_by(F.struct("sid", "name"), "ord").alias("_v"), F.min("ord").alias("ord"))

    def barred(df: DataFrame, a: str, b: str) -> DataFrame:
        text = F.rtrim(F.concat_ws("|", a, b), F.lit("|"))
        return df.select(*KEY, F.col("line_no").alias("ord"), text.alias("_v")).where("_v != ''")

    net_item = F.struct(
        "proto", "local_addr", "local_port", "foreign_addr", "foreign_port", "state"
    )
    made = {
        "dlls": lambda: _ordered(dll, F.col("_v"), "dlls"),
        "handles": lambda: _ordered(barred(tables["handle"], "type", "name"), F.col("_v"), "handles"),
        "privs": lambda: _ordered(
            barred(tables["privilege"], "privilege", "attributes"), F.col("_v"), "privs"
        ),
        "nets": lambda: _ordered(merge_net(tables["net"]), net_item, "nets"),
        "sids": lambda: _ordered(sid, F.col("_v"), "sids"),
    }
    return {name: make() for name, make in made.items() if lists is None or name in lists}


def assemble_process(tables: Mapping[str, DataFrame], lists: Sequence[str] | None = None) -> DataFrame:
    """Process rows with their five child lists; empty lists where there is nothing.

    ``lists`` names those wanted: a left join is carried out even if nothing of it is read.
    """
    proc = first_per_key(tables["process"], KEY, F.col("line_no"))
    for name, df in collect_children(tables, lists).items():
        kind = df.schema[name].dataType
        proc = proc.join(df, KEY, "left").withColumn(
            name, F.coalesce(F.col(name), F.array().cast(kind))
        )
    return proc


# ---- benign exclusion ------------------------------------------------------------

_SYS = "c:\\windows\\system32\\"
_WBEM = _SYS + "wbem\\"


@dataclass(frozen=True)
class Benign:
    """One known-benign image: what it must look like to leave the triage set."""

    name: str
    image: str
    path: str | None = None  # None: must have no path
    parents: tuple[str, ...] = ()
    orphan_ok: bool = False
    session: str = "any"  # any | none | zero | user
    state: str = "any"  # any | alive | exited (with no threads)
    count: str = ""  # total | alive | session | session_alive | parent | system_child
    extra: str = ""


# The known-benign images and their conditions, in rule order.
BENIGN_RULES = [
    Benign("system", "system", None, session="none", count="total", extra="pid = 4 and ppid = 0"),
    Benign("memcompression", "memcompression", None, session="none", count="total",
           extra="ppid = 4"),
    Benign("smss_root", "smss.exe", _SYS + "smss.exe", ("system",), session="none",
           count="system_child"),
    Benign("smss_copy", "smss.exe", _SYS + "smss.exe", ("smss.exe",), state="exited"),
    Benign("csrss", "csrss.exe", _SYS + "csrss.exe", ("smss.exe",), True, count="session",
           extra="cmd_low = '' or ((startswith(cmd_low, '%systemroot%\\\\system32\\\\csrss.exe') or "
                 "startswith(cmd_low, 'c:\\\\windows\\\\system32\\\\csrss.exe')) and "
                 "contains(cmd_low, 'objectdirectory=\\\\windows'))"),
    Benign("wininit", "wininit.exe", _SYS + "wininit.exe", ("smss.exe",), True, "zero",
           count="alive"),
    Benign("winlogon", "winlogon.exe", _SYS + "winlogon.exe", ("smss.exe",), True, "user",
           count="session_alive"),
    Benign("services", "services.exe", _SYS + "services.exe", ("wininit.exe",), session="zero",
           count="alive"),
    Benign("lsass", "lsass.exe", _SYS + "lsass.exe", ("wininit.exe",), session="zero",
           count="alive", extra="children = 0"),
    Benign("svchost_alive", "svchost.exe", _SYS + "svchost.exe", ("services.exe",),
           session="zero", state="alive", extra="contains(cmd_low, '-k')"),
    Benign("svchost_exited", "svchost.exe", _SYS + "svchost.exe", ("services.exe",),
           session="zero", state="exited"),
    Benign("fontdrvhost", "fontdrvhost.exe", _SYS + "fontdrvhost.exe",
           ("wininit.exe", "winlogon.exe"), count="parent"),
    Benign("dwm", "dwm.exe", _SYS + "dwm.exe", ("winlogon.exe",), session="user",
           count="session_alive"),
    Benign("logonui", "logonui.exe", _SYS + "logonui.exe", ("winlogon.exe",), session="user"),
    Benign("spoolsv", "spoolsv.exe", _SYS + "spoolsv.exe", ("services.exe",), session="zero",
           count="alive"),
    Benign("msdtc", "msdtc.exe", _SYS + "msdtc.exe", ("services.exe",), session="zero",
           count="alive"),
    Benign("searchindexer", "searchindexer.exe", _SYS + "searchindexer.exe", ("services.exe",),
           session="zero", count="alive", extra="cmd_low = '' or contains(cmd_low, '/embedding')"),
    Benign("wmiprvse", "wmiprvse.exe", _WBEM + "wmiprvse.exe", ("svchost.exe",), session="zero",
           extra="coalesce(parent_cmd, '') = '' or contains(parent_cmd, 'dcomlaunch')"),
    Benign("unsecapp", "unsecapp.exe", _WBEM + "unsecapp.exe", ("svchost.exe",),
           extra="cmd_low = '' or contains(cmd_low, '-embedding')"),
    Benign("dllhost", "dllhost.exe", _SYS + "dllhost.exe", ("svchost.exe",),
           extra="cmd_low rlike '/processid:[{][0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-"
                 "[0-9a-f]{12}[}]'"),
    Benign("conhost", "conhost.exe", _SYS + "conhost.exe",
           extra="(trim(cmd_low) = '' or endswith(trim(cmd_low), '0x4') or "
                 "endswith(trim(cmd_low), '0x0')) and (startswith(parent_path, 'c:\\\\windows') or "
                 "startswith(parent_path, 'c:\\\\program files'))"),
]


def _full_name(low: Column) -> Column:
    """The rule's full name for an observed (possibly shortened) lower-case name."""
    out = low
    for name in sorted({r.image for r in BENIGN_RULES} | {p for r in BENIGN_RULES for p in r.parents}):
        if len(name) > rules.NAME_LIMIT:
            out = F.when(low == name[: rules.NAME_LIMIT], F.lit(name)).otherwise(out)
    return out


def instance_counts(proc: DataFrame, tasks: int | None = None) -> dict[str, DataFrame]:
    """Counts the rules need, each pre-aggregated; ``proc`` comes from ``with_parent``.

    With ``tasks``, rows lie by case and parent in so many tasks. Children of a parent are then
    counted where they lie, and only these counts are dealt out by the other keys, to as many.
    """
    p = proc.withColumns(
        {
            "image_low": F.lower("image"),
            "full": _full_name(F.lower("image")),
            "alive": is_alive(F.col("exit_time")),
        }
    )
    total = F.count(F.lit(1)).alias("_n")
    roots = (F.col("full") == "smss.exe") & (F.col("parent_image") == "system")

    def counted(rows: DataFrame, keys: Sequence[str], n: str, n_alive: str | None = None) -> DataFrame:
        living = [F.count_if("alive").alias("_alive")] if n_alive else []
        names = [n, n_alive] if n_alive else [n]
        if tasks and "ppid" not in keys:
            near = rows.groupBy(*dict.fromkeys(["case_id", "ppid", *keys])).agg(total, *living)
            out = near.repartition(tasks, *keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_n", "_alive")[: len(names)]])
        else:
            out = rows.groupBy(*keys).agg(total, *living)
        return out.select(*keys, *[F.col(c).alias(name) for c, name in zip(("_n", "_alive"), names)])

    return {
        "image": counted(p, ["case_id", "image_low"], "n_total", "n_alive"),
        "session": counted(p.where(F.col("session").isNotNull()), ["case_id", "full", "session"], "n_session", "n_session_alive"),
        "parent": counted(p, ["case_id", "full", "ppid"], "n_parent"),
        "children": counted(p, ["case_id", "ppid"], "children").withColumnRenamed("ppid", "pid"),
        "system_child": counted(p.where(roots), ["case_id"], "n_system_child"),
    }


def _alone(r: Benign) -> Column:
    """What a rule asks of a process and its parent, without any count."""
    ok = (F.col("full") == r.image) & ~F.col("wow64")
    path = F.lower(F.coalesce(F.col("path"), F.lit("")))
    ok = ok & (path == (r.path or ""))
    if r.parents:
        known = F.col("parent_full").isin(*r.parents)
        ok = ok & (F.coalesce(known, F.lit(r.orphan_ok)))
    session = F.col("session")
    ok = ok & {
        "any": F.lit(True), "none": session.isNull(),
        "zero": F.coalesce(session == 0, F.lit(False)),
        "user": F.coalesce(session >= 1, F.lit(False)),
    }[r.session]
    ok = ok & {
        "any": F.lit(True), "alive": F.col("alive"),
        "exited": ~F.col("alive") & (F.col("threads") == 0),
    }[r.state]
    if r.extra and not _of_counts(r):
        ok = ok & F.coalesce(F.expr(f"({r.extra})"), F.lit(False))
    return ok


def _of_counts(r: Benign) -> bool:
    return "children" in r.extra


def _counted(r: Benign) -> Column:
    """What a rule asks of the counts."""
    session = F.col("session")
    ok = {
        "": F.lit(True),
        "total": F.col("n_total") == 1,
        "alive": F.col("n_alive") == 1,
        "session": session.isNull() | (F.col("n_session") <= 1),
        "session_alive": F.col("n_session_alive") <= 1,
        "parent": F.col("n_parent") <= 1,
        "system_child": F.col("n_system_child") == 1,
    }[r.count]
    if _of_counts(r):
        ok = ok & F.coalesce(F.expr(f"({r.extra})"), F.lit(False))
    return ok


def exclude_benign(proc: DataFrame) -> DataFrame:
    """Adds ``excluded_by``: the first known-benign rule a process meets, else null.

    Only processes whose name a rule knows are looked at after the parent join, and the
    counts, taken before anything is excluded, are of those names alone. What rules ask of a
    process and its parent is settled there, as bits; processes with a bit meet the counts
    without their texts, in as many tasks as the rows need. Counts of a whole
    case or image, one row each, are broadcast when they are measured to be small, so that
    a large case does not gather in one task.
    """
    tasks = tasks_for(proc)
    named = with_parent(proc, tasks).withColumns(
        {
            "image_low": F.lower("image"),
            "full": _full_name(F.lower("image")),
            "parent_full": _full_name(F.col("parent_image")),
            "alive": is_alive(F.col("exit_time")),
            "cmd_low": F.lower(F.coalesce(F.col("cmd"), F.lit(""))),
        }
    )
    images = sorted({r.image for r in BENIGN_RULES})
    bits = F.lit(0).cast("long")
    for i, r in enumerate(BENIGN_RULES):
        bits = bits.bitwiseOR(F.when(_alone(r), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    # in a lambda: all rules in the generated code of a stage make a method too long to be compiled
    may = F.transform(F.array(F.lit(True)), lambda _: bits)[0]
    watched = durable(
        named.where(F.col("full").isin(images)).select(
            *KEY, "ppid", "image", "image_low", "full", "session", "exit_time", "parent_image", may.alias("_may")
        )
    )
    counts = instance_counts(watched.repartition(tasks, "case_id", "ppid"), tasks)
    children = proc.groupBy("case_id", F.col("ppid").alias("pid")).agg(
        F.count(F.lit(1)).alias("children")
    )

    def meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
        return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys, "left")

    facts = watched.where("_may != 0").select(*KEY, "ppid", "image_low", "full", "session", "_may")
    if fits(counts["image"]):
        facts = facts.join(F.broadcast(counts["image"]), ["case_id", "image_low"], "left")
    else:
        facts = meet(facts, counts["image"], ["case_id", "image_low"])
    facts = meet(facts, counts["session"], ["case_id", "full", "session"])
    facts = meet(facts, counts["parent"], ["case_id", "full", "ppid"])
    facts = facts.join(small_side(counts["system_child"]), ["case_id"], "left")
    facts = meet(facts, children, KEY).withColumn("children", F.coalesce("children", F.lit(0)))
    first = None
    for i, r in enumerate(BENIGN_RULES):
        hit = (F.col("_may").bitwiseAND(F.lit(1 << i).cast("long")) != 0) & _counted(r)
        first = F.when(hit, r.name) if first is None else first.when(hit, r.name)
    verdict = facts.select(*KEY, first.alias("excluded_by")).where(F.col("excluded_by").isNotNull())
    return meet(proc, verdict, KEY)


# ---- forest ----------------------------------------------------------------------


DOWN, UP = 0, 1


def _tour(proc: DataFrame, group: str) -> DataFrame:
    """The steps of a walk around every tree: down to each process and up from it.

    One row a step: ``node``, ``kind``, and the step that follows (null after the root's way
    up). The next sibling is the next pid under the same parent; a parent with any number of
    children is cut by pid.
    """
    known = proc.select(group, F.col("pid").alias("ppid"), F.lit(True).alias("_known"))
    linked = proc.select(group, "pid", "ppid").join(known, [group, "ppid"], "left")
    up = F.when(
        F.col("_known") & (F.col("ppid") != 0) & (F.col("ppid") != F.col("pid")), F.col("ppid")
    )
    tree = durable(linked.select(group, "pid", up.alias("up"), (-F.col("pid")).alias("_back")))
    children = tree.where(F.col("up").isNotNull())
    after = lagged(
        children, [group, "up"], [F.col("_back")], F.floor(F.col("_back") / 4096), F.col("pid"), "_next"
    )
    first = children.groupBy(group, F.col("up").alias("pid")).agg(F.min("pid").alias("_first"))
    step = lambda node, kind: F.struct(node.alias("node"), F.lit(kind).alias("kind"))
    down = tree.join(first, [group, "pid"], "left").select(
        group, F.col("pid").alias("node"), F.lit(DOWN).alias("kind"),
        F.when(F.col("_first").isNotNull(), step(F.col("_first"), DOWN)).otherwise(step(F.col("pid"), UP)).alias("next"),
    )
    rise = after.select(
        group, F.col("pid").alias("node"), F.lit(UP).alias("kind"),
        F.when(F.col("_next").isNotNull(), step(F.col("_next"), DOWN)).otherwise(step(F.col("up"), UP)).alias("next"),
    )
    ends = tree.where(F.col("up").isNull()).select(
        group, F.col("pid").alias("node"), F.lit(UP).alias("kind"),
        F.lit(None).cast("struct<node:bigint,kind:int>").alias("next"),
    )
    steps = down.unionByName(rise).unionByName(ends)
    return steps.select(
        group, F.col("node").cast("bigint"), "kind", F.col("next.node").cast("bigint").alias("next_node"),
        F.col("next.kind").alias("next_kind"),
    )


def process_forest(proc: DataFrame, group: str = "case_id") -> DataFrame:
    """Pre-order of the parent/child forest.

    Adds ``root_pid``, ``depth``, ``position`` (0-based in the case), and the half-open
    interval ``[root_start, root_end)`` of the root's subtree. A process whose parent is
    absent, 0 or itself is a root; siblings follow their pid. Processes caught in a parent
    cycle are not reachable and are left out. A pid is one process of its case.

    The steps of the walk around each tree form a list, and each step counts what follows it:
    the ways down, the ways down less the ways up, and the last node. Every round each step
    takes over the count of the step it points to and points to where that one points, so a
    list of n steps is counted in log2(n) joins, be it a chain or a star. No row holds a path.
    """
    steps = _tour(proc, group)
    down = F.when(F.col("kind") == DOWN, 1).otherwise(0).cast("bigint")
    state = durable(steps.select(
        group, "node", "kind", "next_node", "next_kind", down.alias("below"),
        F.when(F.col("kind") == DOWN, 1).otherwise(-1).cast("bigint").alias("level"),
        F.col("node").alias("last"),
    ))
    pending = state.where(F.col("next_node").isNotNull()).count()
    while pending:
        ahead = state.select(
            group, F.col("node").alias("next_node"), F.col("kind").alias("next_kind"),
            F.col("next_node").alias("_node"), F.col("next_kind").alias("_kind"),
            F.col("below").alias("_below"), F.col("level").alias("_level"), F.col("last").alias("_last"),
        )
        moved = state.where(F.col("next_node").isNotNull()).join(ahead, [group, "next_node", "next_kind"]).select(
            group, "node", "kind", F.col("_node").alias("next_node"), F.col("_kind").alias("next_kind"),
            (F.col("below") + F.col("_below")).alias("below"), (F.col("level") + F.col("_level")).alias("level"),
            F.col("_last").alias("last"),
        )
        state = durable(state.where(F.col("next_node").isNull()).unionByName(moved))
        left = state.where(F.col("next_node").isNotNull()).count()
        if left == pending:  # only cycles are left
            break
        pending = left
    reached = state.where(F.col("next_node").isNull() & (F.col("kind") == DOWN)).select(
        group, F.col("node").alias("pid"), F.col("last").alias("root_pid"),
        (-F.col("level")).cast("int").alias("depth"), "below",
    )
    sizes = reached.where(F.col("pid") == F.col("root_pid")).select(group, "root_pid", F.col("below").alias("_size"))
    roots = running_sum(
        sizes, [group], [F.col("root_pid")], F.floor(F.col("root_pid") / 4096), "_size", "root_end"
    ).withColumn("root_start", F.col("root_end") - F.col("_size"))
    placed = reached.join(roots, [group, "root_pid"]).withColumn(
        "position", F.col("root_end") - F.col("below")
    ).drop("below", "_size")
    return proc.join(placed, [group, "pid"])


def format_process_line(df: DataFrame) -> Column:
    """One line per process: indent by depth, escaped command, ``;`` lists."""
    def listed(name: str, fields: Sequence[str] = ()) -> Column:
        items = F.col(name)
        if fields:
            items = F.transform(items, lambda i: F.concat_ws("|", *[i[f] for f in fields]))
        return F.array_join(F.filter(items, lambda i: i != ""), ";")

    cmd = F.regexp_replace(
        F.to_json(F.struct(F.coalesce("cmd", F.lit("")).alias("c"))), r'(?s)^\{"c":(.*)\}$', "$1"
    )
    return F.concat(
        F.repeat(F.lit("  "), F.col("depth")),
        F.lit("pid="), F.col("pid").cast("string"),
        F.lit(" ppid="), F.col("ppid").cast("string"),
        F.when(F.col("discovered_via") == "psscan", " discovered_via=psscan").otherwise(""),
        F.lit(" name="), F.col("image"),
        F.lit(" path="), F.col("path"),
        F.lit(" cmd="), cmd,
        F.lit(" start="), F.trim(F.coalesce("create_time", F.lit(""))),
        F.when(is_alive(F.col("exit_time")), "").otherwise(
            F.concat(F.lit(" end="), F.trim("exit_time"))
        ),
        F.lit(" dlls="), listed("dlls"),
        F.lit(" nets="), listed("nets", (
            "proto", "local_addr", "local_port", "foreign_addr", "foreign_port", "state")),
        F.lit(" sids="), listed("sids", ("sid", "name")),
        F.lit(" privs="), listed("privs"),
        F.lit(" handles="), listed("handles"),
        F.lit("\n"),
    )


# ---- packing ---------------------------------------------------------------------

def subtree_tokens(lines: DataFrame, text: str = "line") -> DataFrame:
    """Token estimate of every root subtree: ``(case_id, root_start, root_pid, tokens)``.

    The estimate is of the joined text, so lengths are summed before rounding.
    """
    return lines.groupBy("case_id", "root_start", "root_pid").agg(
        F.sum(F.length(text)).alias("_chars")
    ).select("case_id", "root_start", "root_pid", F.ceil(F.col("_chars") / 4).alias("tokens"))


def pack_chunks(subtrees: DataFrame, budget: int = rules.CHUNK_TOKENS) -> DataFrame:
    """Adds ``chunk`` (1-based per case): whole subtrees, greedy in order.

    An oversized subtree closes the open chunk and stands alone. Every subtree gets the
    start that would follow a chunk beginning with it, from running totals; the starts
    that are reached from the first one are found by pointer doubling, so no task holds
    a case.
    """
    seg = ["case_id", "seg"]
    order = [F.col("root_start")]
    bucket = F.floor(F.col("root_start") / 100_000)
    marked = subtrees.withColumn("_solo", (F.col("tokens") > budget).cast("bigint"))
    # a segment ends with each oversized subtree
    cut = durable(running_sum(marked, ["case_id"], order, bucket, "_solo", "seg"))
    small = running_sum(cut.where("_solo = 0"), seg, order, bucket, "tokens", "total")
    small = durable(small.withColumn("_from", F.col("total") - F.col("tokens")))
    # next start of i: the first j whose total exceeds from(i) + budget
    width = F.lit(budget)
    reach = small.select(
        *seg, F.col("root_start").alias("i"), (F.col("_from") + budget).alias("v"),
        F.lit(None).cast("bigint").alias("j"),
    )
    marks = small.select(
        *seg, F.lit(None).cast("bigint").alias("i"), F.col("total").alias("v"),
        F.col("root_start").cast("bigint").alias("j"),
    )
    both = reach.unionByName(marks).withColumn("_b", F.floor(F.col("v") / width))
    # totals are at most one budget apart: the next one is in this stretch or the following
    firsts = marks.withColumn("_b", F.floor(F.col("v") / width)).groupBy(*seg, "_b").agg(
        F.min_by("j", "v").alias("j"), F.min("v").alias("v")
    )
    carried = firsts.select(*seg, "j", "v", (F.col("_b") - 1).alias("_b"))
    both = both.unionByName(carried.withColumn("i", F.lit(None).cast("bigint")))
    later = Window.partitionBy(*seg, "_b").orderBy(F.desc("v"), F.col("i").isNull()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    nxt = both.withColumn(
        "n", F.min_by(F.col("j"), F.when(F.col("j").isNotNull(), F.col("v"))).over(later)
    ).where(F.col("i").isNotNull()).select(*seg, "i", "n")
    nxt = durable(nxt)
    starts = durable(small.groupBy(*seg).agg(F.min("root_start").cast("bigint").alias("i")))
    hop, found = nxt.where(F.col("n").isNotNull()), starts.count()
    while True:
        landed = starts.join(hop, [*seg, "i"]).select(*seg, F.col("n").alias("i"))
        grown = durable(starts.unionByName(landed).distinct())
        now = grown.count()
        starts = grown
        if now == found:
            break
        found = now
        far = hop.select(*seg, F.col("i").alias("n"), F.col("n").alias("m"))
        hop = durable(hop.join(far, [*seg, "n"]).select(*seg, "i", F.col("m").alias("n")))
    flags = cut.join(
        starts.select("case_id", F.col("i").alias("root_start"), F.lit(1).cast("bigint").alias("_s")),
        ["case_id", "root_start"], "left",
    ).withColumn("_open", F.coalesce("_s", F.col("_solo")))
    return running_sum(flags, ["case_id"], order, bucket, "_open", "chunk").select(
        *subtrees.columns, "chunk"
    )


# ---- anomalies -------------------------------------------------------------------


def spawn_anomaly(proc: DataFrame, pairs: Mapping[str, Sequence[str]] = rules.SPAWN_PAIRS) -> DataFrame:
    """Shells started by document readers or browsers (parent name is a substring test)."""
    child = F.lower("image")
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.col("parent_image").contains(parent) & child.isin(list(children)), parent)
                for parent, children in pairs.items()
            ]
        )
    )
    return with_parent(proc).withColumn("spawned_by", F.explode(hits))


def dual_sid(proc: DataFrame, sids: str = "sids", legit: Sequence[str] = rules.DUAL_SID_IMAGES) -> DataFrame:
    """Processes holding the system SID and a user SID. ``sids``: array of ``sid|name``."""
    low = F.lower(F.array_join(F.col(sids), ";"))
    return proc.where(
        (low.contains("s-1-5-18") | low.contains("system"))
        & low.contains("s-1-5-21")
        & ~F.lower("image").isin(list(legit))
    )


def spawn_volume(
    proc: DataFrame, limit: int = rules.SPAWN_LIMIT, shells: Sequence[str] = rules.SHELLS
) -> DataFrame:
    """Shells with more than ``limit`` children."""
    children = proc.groupBy("case_id", F.col("ppid").alias("pid")).agg(
        F.count(F.lit(1)).alias("children")
    ).where(F.col("children") > limit)
    return proc.where(F.lower("image").isin(list(shells))).join(children, KEY)


def rule_score(
    proc: DataFrame,
    keywords: Sequence[str] = rules.COMMAND_KEYWORDS,
    dirs: Sequence[str] = rules.SUSPICIOUS_DIRS,
    trusted: Sequence[str] = rules.MEMORY_TRUSTED_GLOBS,
    legit: Sequence[str] = rules.LEGITIMATE_IMAGES,
) -> DataFrame:
    """Keyword, folder and name signals: ``score``, ``severity``, ``reasons``; score > 0 only."""
    cmd = F.lower(F.coalesce("cmd", F.lit("")))
    word = None
    for k in keywords:
        word = F.when(cmd.contains(k.lower()), k.lower()) if word is None else word.when(
            cmd.contains(k.lower()), k.lower()
        )

    def odd(c: str) -> Column:
        v = F.coalesce(F.col(c), F.lit(""))
        return (v != "") & ~glob_any(v, trusted) & contains_any(v, dirs)

    place = F.when(odd("path"), F.col("path")).when(odd("image"), F.col("image"))
    name = F.lower("image")
    hexed = ~name.isin(list(legit)) & name.rlike(r"[a-f0-9]{8,}\.exe$")
    score = (
        F.when(word.isNotNull(), 3).otherwise(0)
        + F.when(place.isNotNull(), 2).otherwise(0)
        + F.when(hexed, 2).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("Keyword in cmdline: "), word),
            F.concat(F.lit("Unusual path: "), place),
            F.when(hexed, F.concat(F.lit("Hex-like executable name: "), F.col("image"))),
        )
    )
    return proc.withColumn("score", score).where("score > 0").withColumns(
        {
            "severity": F.when(F.col("score") >= 5, "HIGH").when(F.col("score") >= 3, "MEDIUM")
            .otherwise("LOW"),
            "reasons": reasons,
        }
    )


def preview_lists(proc: DataFrame, trusted: Sequence[str] = rules.MEMORY_TRUSTED_GLOBS,
                  dlls: int = 8, nets: int = 6) -> DataFrame:
    """First non-trusted DLLs, first connections and notable privileges of a process."""
    return proc.withColumns(
        {
            "dll_preview": F.slice(
                F.filter("dlls", lambda d: (F.trim(d) != "") & ~glob_any(d, trusted)), 1, dlls
            ),
            "net_preview": F.slice("nets", 1, nets),
            "notable": notable_privs(F.array_join("privs", ";")),
        }
    )


