"""Report tables: summary, timeline, techniques, indicators, lineage."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import rules
from spoor.functions import clip
from spoor.scale import fits, lagged, ordinal, small_side
from spoor.session import durable

REPORTABLE = ["CONFIRMED", "INCONCLUSIVE"]
CALL_BLOCK = 1024  # calls of a case that meet a finding in one row
CALL_WAYS = 4  # tasks a core, at least
TASK_BLOCKS = 32  # blocks of calls that a task has, about
FINDING_GROUP = 32  # findings of a case in one row, about
CALL_PREFIX = 6  # characters of a call id that cut calls of one order into buckets


def reportable_entities(findings: DataFrame, enrichment: str = "ti") -> DataFrame:
    """Findings of reportable entities: CONFIRMED, INCONCLUSIVE and any enrichment finding.

    ``findings``: entity_type, entity_value, module, verdict, ...
    """
    key = ["entity_type", "entity_value"]
    wanted = F.col("verdict").isin(REPORTABLE)
    subjects = findings.where(wanted).select(*key).distinct()
    return findings.where(wanted | (F.col("module") == enrichment)).join(
        subjects, key, "left_semi"
    )


def report_summary(findings: DataFrame) -> DataFrame:
    """One row: reportable, confirmed and inconclusive-only entities, severities, modules.

    ``findings`` are those of :func:`reportable_entities`.
    """
    confirmed = F.col("verdict") == "CONFIRMED"
    per_entity = findings.groupBy("entity_type", "entity_value").agg(
        F.bool_or(confirmed).alias("c"),
        *[
            F.count_if(confirmed & (F.col("severity") == s)).alias(s.lower())
            for s in rules.SEVERITIES
        ],
    )
    return per_entity.agg(
        F.count(F.lit(1)).alias("reportable_entities"),
        F.count_if("c").alias("confirmed_entities"),
        F.count_if(~F.col("c")).alias("inconclusive_entities"),
        *[F.coalesce(F.sum(s.lower()), F.lit(0)).alias(s.lower()) for s in rules.SEVERITIES],
    )


def severity_histogram(findings: DataFrame) -> DataFrame:
    """Four fixed rows, zeros included."""
    spark = findings.sparkSession
    scale = spark.createDataFrame([(s,) for s in rules.SEVERITIES], "severity string")
    counts = findings.where("verdict = 'CONFIRMED'").groupBy("severity").agg(
        F.count(F.lit(1)).alias("n")
    )
    return scale.join(counts, "severity", "left").select(
        "severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("findings")
    )


def mitre_map(findings: DataFrame) -> DataFrame:
    """Distinct (technique, entity) over CONFIRMED findings."""
    return findings.where("verdict = 'CONFIRMED'").select(
        F.explode("mitre").alias("technique"), "entity_type", "entity_value"
    ).distinct()


# Report category of each entity type.
IOC_CATEGORIES = {
    "File": ["file_path", "image_name", "hash_md5", "hash_sha1", "hash_sha256"],
    "Network": ["ip", "domain", "url"],
    "Registry": ["registry_key"],
    "Behavioural": ["pid", "mutex", "user_sid"],
}


def ioc_table(findings: DataFrame) -> DataFrame:
    """CONFIRMED entities by category; a category without any shows a dash."""
    spark = findings.sparkSession
    shelves = spark.createDataFrame([(c,) for c in IOC_CATEGORIES], "category string")
    category = None
    for name, types in IOC_CATEGORIES.items():
        hit = F.col("entity_type").isin(types)
        category = F.when(hit, name) if category is None else category.when(hit, name)
    found = findings.where("verdict = 'CONFIRMED'").select(
        category.alias("category"), F.col("entity_value").alias("indicator")
    ).distinct()
    return shelves.join(found, "category", "left").select(
        "category", F.coalesce("indicator", F.lit("—")).alias("indicator")
    )


def ti_summary(ti: DataFrame) -> DataFrame:
    """One row: indicators asked and those with a detection. ``ti``: type, value, malicious."""
    per = ti.groupBy("type", "value").agg(F.max("malicious").alias("m"))
    return per.agg(
        F.count(F.lit(1)).alias("queried"), F.count_if(F.col("m") >= 1).alias("detected")
    )


def network_clusters(ti: DataFrame) -> DataFrame:
    """Networks shared by several indicators. ``ti``: type, value, asn."""
    return ti.where(F.col("asn").isNotNull()).groupBy("asn").agg(
        F.count_distinct("type", "value").alias("indicators")
    ).where("indicators > 1")


def timeline(
    evidence: DataFrame, gap: int = 4 * 3600, ts: str = "ts", tie: str = "ord", group: str = "case_id"
) -> DataFrame:
    """CONFIRMED evidence in time order with the gap before each step, in seconds.

    ``note`` is set where the gap exceeds ``gap``.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    steps = lagged(
        evidence.where("verdict = 'CONFIRMED'"), [group], [F.col(ts), F.col(tie)],
        F.to_date(ts), seconds, "_before",
    )
    return steps.withColumn("gap_seconds", seconds - F.col("_before")).withColumn(
        "note",
        F.when(
            F.col("gap_seconds") > gap,
            F.concat(
                F.lit("Note: "),
                F.when(
                    F.col("gap_seconds") >= 86400,
                    F.concat(F.floor(F.col("gap_seconds") / 86400).cast("string"), F.lit("-day")),
                ).otherwise(
                    F.concat(F.floor(F.col("gap_seconds") / 3600).cast("string"), F.lit("-hour"))
                ),
                F.lit(" gap"),
            ),
        ),
    ).drop("_before")


def report_payload(findings: DataFrame, page: int = 500) -> DataFrame:
    """JSON documents of reportable entities: the entity and up to ``page`` findings each.

    Every finding keeps all its evidence.

    An entity with more findings continues on further pages, so no finding is lost
    and no document grows without bound. ``findings``: entity_type, entity_value,
    ord, module, verdict, severity, justification, mitre, evidence.
    """
    key = ["entity_type", "entity_value"]
    paged = ordinal(findings, key, [F.col("ord")], F.floor(F.col("ord") / 100_000), "_n").withColumn(
        "page", F.floor((F.col("_n") - 1) / page)
    )
    body = F.struct(
        F.col("_n"), F.col("module"), F.col("verdict"), F.col("severity"), F.col("justification"),
        F.col("mitre"), F.col("evidence"),
    )
    seen = findings.groupBy(*key).agg(
        F.min_by("module", "ord").alias("_first"),
        F.array_sort(F.collect_set("module")).alias("_modules"),
    )
    pages = paged.groupBy(*key, "page").agg(F.array_sort(F.collect_list(body)).alias("f"))
    return pages.join(seen, key).select(
        *key, "page",
        F.to_json(
            F.struct(
                F.col("entity_type").alias("type"), F.col("entity_value").alias("value"),
                F.col("_first").alias("first_seen_module"),
                F.col("_modules").alias("queried_modules"),
                F.transform("f", lambda x: x.dropFields("_n")).alias("findings"),
            )
        ).alias("document"),
    )


def report_header(findings: DataFrame, case: DataFrame) -> DataFrame:
    """The head of the payload of each case as JSON.

    ``case``: case_id, termination_reason, host_profile (any struct). Counts of entities
    and findings by verdict, and the scanned modules, come from ``findings`` with case_id.
    """
    summary = findings.groupBy("case_id").agg(
        F.array_sort(F.collect_set("module")).alias("modules_scanned"),
        F.struct(
            F.count_distinct("entity_type", "entity_value").alias("entities"),
            F.count_if(F.col("verdict") == "CONFIRMED").alias("confirmed"),
            F.count_if(F.col("verdict") == "INCONCLUSIVE").alias("inconclusive"),
            F.count_if(F.col("verdict") == "REJECTED").alias("rejected"),
        ).alias("summary"),
    )
    return case.join(summary, "case_id", "left").select(
        "case_id",
        F.to_json(
            F.struct(
                "case_id", "termination_reason", "modules_scanned", "host_profile", "summary"
            )
        ).alias("header"),
    )


# ---- lineage ---------------------------------------------------------------------

def call_sets(calls: DataFrame) -> DataFrame:
    """Analyst calls that share one output per case: ``(case_id, call_id, ord, agent_name)``."""
    wrote = F.exists("output_files", lambda o: o.endswith("analyst.txt"))
    return calls.where(wrote).select("case_id", "call_id", "ord", "agent_name")


def trace_index(
    findings: DataFrame, memory_calls: DataFrame, disk_calls: DataFrame, lookups: DataFrame
) -> DataFrame:
    """Every finding with the call or calls that produced it.

    Memory findings match the first call that wrote their chunk's file, disk
    findings the set of analyst calls of their case, enrichment its own lookup.
    ``call_ids`` lists all of them; :func:`trace_calls` gives one row per finding and
    call instead.

    ``findings``: case_id, module, finding_id, entity_type, entity_value, verdict,
    severity, evidence; calls: case_id, ord, call_id, agent_name, output_files;
    ``lookups``: case_id, call_id, query_id, agent_name, entity_type, entity_value, verdict.
    """
    head = [
        "case_id", "module", "finding_id", "entity_type", "entity_value", "verdict", "severity",
        "mitre",
    ]
    if "mitre" not in findings.columns:
        findings = findings.withColumn("mitre", F.array().cast("array<string>"))
    cells = F.transform(
        "evidence",
        lambda e: F.struct(
            e["source_file"].alias("source_file"), e["line"].alias("line"),
            clip(e["content"]).alias("content"),
        ),
    )
    base = findings.select(*head, cells.alias("evidence"))
    written = memory_calls.select(
        "case_id", "ord", "call_id", "agent_name", F.explode("output_files").alias("_o")
    ).withColumn("_chunk", F.regexp_extract("_o", r"(chunk_\d+)/analyst\.txt$", 1)).where("_chunk != ''")
    by_chunk = written.groupBy("case_id", "_chunk").agg(
        F.min_by(F.struct("call_id", "agent_name"), "ord").alias("_call")
    )
    memory = (
        base.where("module = 'ram'")
        .withColumn("_chunk", F.regexp_extract("finding_id", r"(chunk_\d+)", 1))
        .join(by_chunk, ["case_id", "_chunk"], "left")
        .select(
            *head, "evidence",
            F.coalesce("_call.agent_name", F.lit("ram/pivot_analyst")).alias("agent_name"),
            F.array_compact(F.array("_call.call_id")).alias("call_ids"),
            F.col("_call").isNotNull().cast("bigint").alias("n_calls"),
            F.concat(
                F.lit("ram/02_per_chunk_analysis/"),
                F.coalesce(F.nullif(F.col("_chunk"), F.lit("")), F.lit("<unknown>")),
                F.lit("/analyst.txt"),
            ).alias("artifact"),
            F.lit("ram/agent_calls.jsonl").alias("log_file"),
        )
    )
    sets = call_sets(disk_calls)
    sizes = sets.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.min_by("agent_name", "ord").alias("_agent"),
        F.array_sort(F.collect_list(F.struct("ord", "call_id")))["call_id"].alias("call_ids"),
    )
    disk = (
        base.where("module = 'disk'")
        .join(sizes, "case_id", "left")
        .select(
            *head, "evidence",
            F.coalesce("_agent", F.lit("disk/pivot_analyst")).alias("agent_name"),
            F.when(F.coalesce("n_calls", F.lit(0)) == 0, F.array().cast("array<string>"))
            .otherwise(F.col("call_ids")).alias("call_ids"),
            F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
            F.lit("disk/04_analyst/analyst.txt").alias("artifact"),
            F.lit("disk/agent_calls.jsonl").alias("log_file"),
        )
    )
    asked = lookups.select(
        "case_id", F.lit("ti").alias("module"), F.col("query_id").alias("finding_id"),
        "entity_type", "entity_value", "verdict", F.lit(None).cast("string").alias("severity"),
        F.array().cast("array<string>").alias("mitre"),
        F.array().cast(base.schema["evidence"].dataType).alias("evidence"),
        F.coalesce("agent_name", F.lit("threat_intel/vt_lookup")).alias("agent_name"),
        F.array_compact(F.array("call_id")).alias("call_ids"),
        F.col("call_id").isNotNull().cast("bigint").alias("n_calls"),
        F.lit(None).cast("string").alias("artifact"),
        F.lit("threat_intel/queries.jsonl").alias("log_file"),
    )
    return memory.unionByName(disk).unionByName(asked).withColumn(
        "entity_key", F.concat_ws(":", "entity_type", "entity_value")
    )


def trace_calls(index: DataFrame) -> DataFrame:
    """One row per finding and call, in the order of the calls."""
    return index.select(
        "case_id", "module", "finding_id", "entity_key",
        F.posexplode("call_ids").alias("call_pos", "call_id"),
    )


def trace_rows(
    findings: DataFrame, memory_calls: DataFrame, disk_calls: DataFrame, lookups: DataFrame
) -> DataFrame:
    """:func:`trace_calls` of :func:`trace_index`, without a row that holds all calls of a finding.

    The calls of a case are cut into blocks of CALL_BLOCK in their order, its findings into groups
    of FINDING_GROUP, and groups meet blocks; the pairs of findings and calls are made last and
    shuffled nowhere. Pairs outgrow all else, so their order counts: one finding after the other
    takes a whole block, and a task has few blocks. Each column then stays or soon returns, and files
    of the result are small.
    """
    key = ["case_id", "module", "finding_id", "entity_key"]
    calls = ordinal(
        call_sets(disk_calls), ["case_id"], [F.col("ord"), F.col("call_id")],
        F.struct("ord", F.substring("call_id", 1, CALL_PREFIX)), "_nth",
    ).withColumn("_block", F.floor((F.col("_nth") - 1) / CALL_BLOCK))
    cells = durable(calls.groupBy("case_id", "_block").agg(
        F.array_sort(F.collect_list(F.struct("_nth", "call_id")))["call_id"].alias("_calls")
    ))
    asking = findings.where("module = 'disk'").select(
        "case_id", "finding_id", F.concat_ws(":", "entity_type", "entity_value").alias("entity_key")
    )
    sizes = asking.groupBy("case_id").agg(F.ceil(F.count(F.lit(1)) / FINDING_GROUP).alias("_groups"))
    group = F.pmod(F.xxhash64("finding_id", "entity_key", F.rand(7)), F.col("_groups"))
    groups = asking.join(small_side(sizes), "case_id").withColumn("_group", group).groupBy("case_id", "_group").agg(
        F.collect_list(F.struct("finding_id", "entity_key")).alias("_asking")
    )
    # the shuffle also parts the two steps: generated code holds all that comes of one row
    pairs = groups.join(small_side(cells.select("case_id", "_block")), "case_id")
    tasks = max(
        CALL_WAYS * findings.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // TASK_BLOCKS)
    )
    if fits(cells):
        met = pairs.repartitionByRange(tasks, "case_id", "_block", "_group").join(F.broadcast(cells), ["case_id", "_block"])
    else:
        met = pairs.repartition(tasks, "case_id", "_block").join(
            cells.repartition(tasks, "case_id", "_block"), ["case_id", "_block"]
        )
    disk = met.select("case_id", "_block", "_calls", F.explode("_asking").alias("_f")).select(
        "case_id", F.lit("disk").alias("module"), "_f.finding_id", "_f.entity_key", "_block",
        F.posexplode("_calls").alias("_at", "call_id"),
    ).select(*key, (F.col("_block") * CALL_BLOCK + F.col("_at")).cast("int").alias("call_pos"), "call_id")
    # a memory finding and a lookup have one call at most
    none = disk_calls.limit(0)
    single = trace_calls(trace_index(findings.where("module = 'ram'"), memory_calls, none, lookups))
    return disk.unionByName(single)


def trace_markdown(index: DataFrame) -> DataFrame:
    """One Markdown table row per finding, to be written in ``entity_key`` order."""
    ids = F.transform("call_ids", lambda c: F.concat(F.lit("`"), c, F.lit("`")))
    calls = (
        F.when(F.col("n_calls") == 0, "(no call recorded)")
        .when(F.col("n_calls") == 1, ids[0])
        .otherwise(
            F.concat(
                F.col("n_calls").cast("string"), F.lit(" calls (see log)"),
                F.coalesce(F.concat(F.lit(": "), F.array_join(ids, ", ")), F.lit("")),
            )
        )
    )
    first = F.get("evidence", F.lit(0))
    more = F.size("evidence") - 1
    where = F.when(F.size("evidence") == 0, "—").otherwise(
        F.concat(
            F.lit("`"), first["source_file"], F.lit(":"), first["line"].cast("string"), F.lit("`"),
            F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""),
        )
    )

    def ticked(c: Column) -> Column:
        return F.concat(F.lit("`"), c, F.lit("`"))

    row = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ", ticked(F.col("entity_key")), ticked(F.coalesce("finding_id", F.lit("—"))),
            F.col("module"), F.coalesce("verdict", F.lit("None")),
            F.coalesce("severity", F.lit("—")), where,
            F.concat(F.coalesce("agent_name", F.lit("—")), F.lit(" → "), calls),
            ticked(F.coalesce("log_file", F.lit("—"))),
        ),
        F.lit(" |"),
    )
    return index.select("entity_key", "finding_id", row.alias("row"))


def execution_sequence(scans: DataFrame, rounds: DataFrame) -> DataFrame:
    """Phases of a run in order: scans, rounds, report. ``scans``: module, ord; ``rounds``: round."""
    spark: SparkSession = scans.sparkSession
    phases = (
        scans.select(F.lit(0).alias("stage"), F.col("ord").cast("bigint").alias("ord"),
                     F.lit("initial_scan").alias("phase"), "module")
        .unionByName(
            rounds.select(F.lit(1).alias("stage"), F.col("round").cast("bigint").alias("ord"),
                          F.lit("routing_round").alias("phase"),
                          F.lit(None).cast("string").alias("module"))
        )
        .unionByName(
            spark.range(1).select(F.lit(2).alias("stage"), F.col("id").alias("ord"),
                                  F.lit("report").alias("phase"),
                                  F.lit(None).cast("string").alias("module"))
        )
        .withColumn("_run", F.lit(0))
    )
    return ordinal(
        phases, ["_run"], [F.col("stage"), F.col("ord")],
        F.struct("stage", F.floor(F.col("ord") / 100_000)), "step",
    ).drop("_run", "stage", "ord")


