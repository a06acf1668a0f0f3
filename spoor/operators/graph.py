"""The case graph: nodes, edges, candidates, routes, rounds and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import rules
from spoor.functions import detection_verdict, epoch_iso, valid_mitre
from spoor.scale import first_per_key, small_side
from spoor.session import durable

FINDING = [
    "ord", "module", "finding_id", "entity_type", "entity_value", "verdict", "severity", "related",
]


def mentions(findings: DataFrame) -> DataFrame:
    """One row per time an entity is named: as a finding's subject or as related.

    ``findings``: ord, module, finding_id, entity_type, entity_value, verdict,
    severity, related ARRAY<STRUCT<type, value, relationship>>.
    """
    subject = findings.select(
        F.struct("ord", F.lit(-1).alias("i")).alias("seen"),
        F.col("entity_type").alias("type"), F.col("entity_value").alias("value"),
        "module", "finding_id", "verdict", "severity", F.lit(True).alias("subject"),
    )
    others = findings.select(
        "ord", "module", "finding_id", F.posexplode("related").alias("i", "r")
    ).select(
        F.struct("ord", "i").alias("seen"), F.col("r.type").alias("type"),
        F.col("r.value").alias("value"), "module", "finding_id",
        F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("severity"),
        F.lit(False).alias("subject"),
    )
    return subject.unionByName(others)


def build_nodes(findings: DataFrame) -> DataFrame:
    """One row per entity: first seen, modules asked, finding count, verdicts.

    ``verdicts_received`` holds each distinct (module, verdict, severity) with its
    count, so a node's row stays small however many findings it has. Counting is
    done in two steps, and the first one spreads a hot entity over its verdicts.
    """
    return nodes_of(node_parts(findings))


def node_parts(findings: DataFrame) -> DataFrame:
    """What nodes are made of: parts of several sets of findings may be united and summed."""
    return mentions(findings).groupBy("type", "value", "module", "verdict", "severity", "subject").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seen", "module", "finding_id")).alias("first")
    )


def nodes_of(parts: DataFrame) -> DataFrame:
    """The nodes of :func:`node_parts`, or of the union of several of them."""
    parts = parts.groupBy("type", "value", "module", "verdict", "severity", "subject").agg(
        F.sum("n").alias("n"), F.min("first").alias("first")
    )
    subject = F.col("subject")
    return parts.groupBy("type", "value").agg(
        F.min("first").alias("_first"),
        F.array_sort(F.collect_set(F.when(subject, F.col("module")))).alias("queried_modules"),
        F.coalesce(F.sum(F.when(subject, F.col("n"))), F.lit(0)).alias("finding_count"),
        F.array_sort(F.collect_set("verdict")).alias("verdicts"),
        F.array_sort(
            F.collect_list(
                F.when(
                    subject & F.col("verdict").isNotNull(),
                    F.struct("module", "verdict", "severity", "n"),
                )
            )
        ).alias("verdicts_received"),
    ).select(
        "type", "value",
        F.col("_first.module").alias("first_seen_module"),
        F.col("_first.finding_id").alias("first_seen_finding_id"),
        "queried_modules", "finding_count", "verdicts", "verdicts_received",
    )


def build_edges(findings: DataFrame, distinct: bool = False) -> DataFrame:
    """Primary to related entity with the relationship; repeats are kept unless ``distinct``."""
    edges = findings.select(
        F.col("entity_type").alias("from_type"), F.col("entity_value").alias("from_value"),
        F.explode("related").alias("r"),
    ).select(
        "from_type", "from_value", F.col("r.type").alias("to_type"),
        F.col("r.value").alias("to_value"), F.col("r.relationship").alias("relationship"),
    )
    return edges.distinct() if distinct else edges


def hot_entities(nodes: DataFrame, n: int = 30) -> DataFrame:
    return nodes.select(
        "type", "value", "verdicts", "queried_modules", "finding_count"
    ).orderBy(F.desc("finding_count"), "type", "value").limit(n)


def candidates(nodes: DataFrame) -> DataFrame:
    """Entities still open: INCONCLUSIVE or NOT_FOUND, never CONFIRMED or REJECTED."""
    v = F.col("verdicts")
    return nodes.where(
        (F.array_contains(v, "INCONCLUSIVE") | F.array_contains(v, "NOT_FOUND"))
        & ~F.array_contains(v, "CONFIRMED")
        & ~F.array_contains(v, "REJECTED")
    ).select("type", "value", "verdicts", "queried_modules")


def enrich_candidates(nodes: DataFrame, module: str = "ti",
                      types: Sequence[str] = rules.ENRICHABLE_TYPES) -> DataFrame:
    """CONFIRMED indicators the enrichment module has not answered yet."""
    return nodes.where(
        F.col("type").isin(list(types))
        & F.array_contains("verdicts", "CONFIRMED")
        & ~F.array_contains("queried_modules", module)
    ).select("type", "value")


def capabilities(spark: SparkSession, caps: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(module, type)``: the entity types each module answers."""
    return spark.createDataFrame(
        [(m, t) for m, ts in caps.items() for t in ts], "module string, type string"
    )


def route(cands: DataFrame, caps: DataFrame, max_queries: int | None = None) -> DataFrame:
    """Every open candidate to every capable module it has not visited."""
    out = (
        cands.join(small_side(caps), "type")
        .where(~F.array_contains("queried_modules", F.col("module")))
        .select("type", "value", "module")
    )
    return out.orderBy("type", "value", "module").limit(max_queries) if max_queries else out


def dispatchable(decisions: DataFrame, nodes: DataFrame, caps: DataFrame) -> DataFrame:
    """Decisions about known entities, for modules that answer their type.

    ``decisions``: action, type, value, module.
    """
    return (
        decisions.where("action = 'query'")
        .join(small_side(caps), ["module", "type"], "left_semi")
        .join(nodes.select("type", "value"), ["type", "value"], "left_semi")
    )


def investigate(
    findings: DataFrame,
    caps: DataFrame,
    answer: Callable[[DataFrame, int], DataFrame],
    max_rounds: int = 5,
) -> tuple[DataFrame, DataFrame, str]:
    """Route, answer and merge until nothing is open or ``max_rounds`` is reached.

    ``answer(queries, round)`` returns finding rows for ``(type, value, module)``.
    Returns the final findings, the round log and the reason for stopping.

    After the first round only the frontier is looked at: entities that were asked or named in
    the round before. Nothing else can have changed, so nothing else is aggregated or routed
    again. Parts of nodes are kept per round; those of the frontier are united. Every round is
    written durably, so plans stay flat and a lost executor costs one round.
    """
    spark = findings.sparkSession
    gathered = findings.select(*FINDING)
    parts = [durable(node_parts(gathered))]
    log, reason, frontier = [], "max_rounds_reached", None
    for number in range(1, max_rounds + 1):
        held = reduce(DataFrame.unionByName, parts)
        queries = durable(route(candidates(nodes_of(_only(held, frontier))), caps))
        sent = queries.count()
        if not sent:
            reason = "convergence"
            break
        answers = durable(answer(queries, number).select(*FINDING))
        added = durable(node_parts(answers))
        named = durable(added.select("type", "value").distinct())
        known = _only(held, named).select("type", "value").distinct()
        log.append((number, sent, named.count() - known.count()))
        frontier = durable(named.unionByName(queries.select("type", "value")).distinct())
        gathered = gathered.unionByName(answers)
        parts.append(added)
    rounds = spark.createDataFrame(
        log, "round int, queries_dispatched bigint, new_entities_added bigint"
    )
    return durable(gathered), rounds, reason


def _only(parts: DataFrame, entities: DataFrame | None) -> DataFrame:
    """Rows of the given entities; null types and values are entities like any other."""
    if entities is None:
        return parts
    chosen = small_side(entities.select(F.col("type").alias("_type"), F.col("value").alias("_value")))
    same = parts["type"].eqNullSafe(chosen["_type"]) & parts["value"].eqNullSafe(chosen["_value"])
    return parts.join(chosen, same, "left_semi")


# ---- enrichment ------------------------------------------------------------------


def lookups(queries: DataFrame) -> DataFrame:
    """Each entity once per case: what a reputation service has to be asked."""
    return queries.select("case_id", "type", "value").distinct()


def enrich(queries: DataFrame, reputation: DataFrame) -> DataFrame:
    """Verdict of every query from one reputation row per entity.

    ``reputation``: type, value, ord, malicious, total. Repeated entities read the
    same row; an entity without one is NOT_FOUND.
    """
    known = first_per_key(
        reputation.select("type", "value", "ord", "malicious", "total"),
        ["type", "value"], F.col("ord"),
    ).drop("ord")
    verdict = detection_verdict(
        F.coalesce("malicious", F.lit(0)), F.coalesce("total", F.lit(0))
    )
    supported = F.col("type").isin(rules.REPUTATION_TYPES)
    return queries.join(known, ["type", "value"], "left").select(
        *queries.columns,
        F.when(supported, verdict["verdict"]).otherwise("NOT_APPLICABLE").alias("verdict"),
        F.when(supported, verdict["severity"]).alias("severity"),
    )


def reputation_evidence(df: DataFrame) -> DataFrame:
    """Verdict, justification, technique ids and ordered evidence of reputation attributes.

    ``df``: stats MAP<STRING,INT>, analysed BIGINT, tags ARRAY, threat_label, name,
    country, as_owner, asn, registrar, created BIGINT, sandboxes
    MAP<STRING,STRUCT<category, families ARRAY>>, first_seen BIGINT, rule_ids ARRAY.
    """
    stats = F.coalesce("stats", F.create_map().cast("map<string,int>"))
    bad = F.coalesce(F.try_element_at(stats, F.lit("malicious")), F.lit(0))
    total = F.aggregate(F.map_values(stats), F.lit(0), lambda a, x: a + x)
    verdict = detection_verdict(bad, total)
    ratio = F.concat(bad.cast("string"), F.lit("/"), total.cast("string"))

    def line(content: Column, stamp: Column | None = None) -> Column:
        at = F.lit(None).cast("string") if stamp is None else stamp
        return F.when(
            content.isNotNull(), F.struct(content.alias("content"), at.alias("timestamp"))
        )

    def tagged(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))

    def part(label: str, c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(label), text))

    place = F.when(
        (F.coalesce("country", F.lit("")) != "") | (F.coalesce("as_owner", F.lit("")) != ""),
        F.concat(
            F.lit("Geolocation: "),
            F.concat_ws(", ", part("country=", "country"), part("AS=", "as_owner"),
                        part("ASN=", "asn")),
        ),
    )
    boxes = F.transform(
        F.slice(F.map_entries(F.coalesce("sandboxes", F.create_map().cast(df.schema["sandboxes"].dataType))), 1, 2),
        lambda e: F.struct(
            F.concat(
                F.lit("Sandbox ("), e["key"], F.lit("): "),
                F.coalesce(e["value"]["category"], F.lit("unknown")),
                F.when(
                    F.size(e["value"]["families"]) > 0,
                    F.concat(F.lit(" — "), F.array_join(F.slice(e["value"]["families"], 1, 3), ", ")),
                ).otherwise(""),
            ).alias("content"),
            F.lit(None).cast("string").alias("timestamp"),
        ),
    )
    first = F.when(F.col("first_seen") != 0, epoch_iso(F.col("first_seen")))
    head = F.array_compact(
        F.array(
            F.when(
                total > 0,
                F.struct(
                    F.concat(F.lit("VT detections: "), ratio, F.lit(" engines flagged as malicious"))
                    .alias("content"),
                    epoch_iso(F.col("analysed")).alias("timestamp"),
                ),
            ).otherwise(
                F.struct(F.lit("VT: no scan results available").alias("content"),
                         F.lit(None).cast("string").alias("timestamp"))
            ),
            line(F.when(F.size("tags") > 0, F.concat(F.lit("VT tags: "), F.array_join("tags", ", ")))),
            line(tagged("Threat label: ", F.col("threat_label"))),
            line(tagged("Common name: ", F.col("name"))),
            line(place),
            line(tagged("Registrar: ", F.col("registrar")), epoch_iso(F.col("created"))),
        )
    )
    tail = F.array_compact(F.array(line(F.concat(F.lit("First submitted: "), first), first)))
    used = ["stats", "analysed", "tags", "threat_label", "name", "country", "as_owner", "asn",
            "registrar", "created", "sandboxes", "first_seen", "rule_ids"]
    return df.select(
        *[c for c in df.columns if c not in used],
        verdict["verdict"].alias("verdict"),
        verdict["severity"].alias("severity"),
        F.coalesce(valid_mitre(F.col("rule_ids")), F.array().cast("array<string>")).alias("mitre"),
        F.when(
            verdict["verdict"] == "CONFIRMED",
            F.concat(F.lit("VirusTotal: "), ratio, F.lit(" engines flagged as malicious (severity="),
                     verdict["severity"], F.lit(")")),
        )
        .when(
            verdict["verdict"] == "INCONCLUSIVE",
            F.concat(F.lit("VirusTotal: "), ratio, F.lit(" engines flagged — low confidence")),
        )
        .otherwise("VirusTotal: no malicious detections or no record found")
        .alias("justification"),
        F.transform(
            F.concat(head, boxes, tail),
            lambda x, i: F.struct((i + 1).alias("line"), x["content"].alias("content"),
                                  x["timestamp"].alias("timestamp")),
        ).alias("evidence"),
    )
