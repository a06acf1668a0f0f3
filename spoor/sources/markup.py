"""XML event records and scheduled-task definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import rules
from spoor.functions import iso_z
from spoor.scale import spread

_EVENT_SCHEMA = (
    "System struct<EventID: struct<_VALUE: string, _Qualifiers: string>,"
    " TimeCreated: struct<_SystemTime: string>, Provider: struct<_Name: string>,"
    " Computer: string>,"
    " EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
)
_XML_OPTIONS = {"ignoreNamespace": "true", "rowTag": "Event", "mode": "PERMISSIVE"}


def flatten_event_xml(
    df: DataFrame,
    xml_col: str,
    sysmon: Column,
    source: Column,
    allow: Sequence[int] = rules.ALLOWED_EVENTS,
    always: Sequence[int] = rules.ALWAYS_EMIT_EVENTS,
) -> DataFrame:
    """One record MAP per event: system fields plus the fields of its event id.

    The XML is parsed once per row. Names are compared without case; of several
    names for a field the first non-empty one is used. ``sysmon`` and ``source``
    come from the log file's route.
    """
    keep = [c for c in df.columns if c != xml_col]
    doc = df.select(
        *keep,
        F.from_xml(F.col(xml_col), F.lit(_EVENT_SCHEMA), _XML_OPTIONS).alias("_e"),
        sysmon.alias("_sysmon"),
        source.alias("_source"),
    )
    system, data = F.col("_e.System"), F.col("_e.EventData.Data")
    event_id = F.trim(system["EventID"]["_VALUE"]).try_cast("int")
    named = F.transform(
        F.filter(F.coalesce(data, F.array()), lambda d: d["_Name"].isNotNull()),
        lambda d: F.struct(
            F.lower(d["_Name"]).alias("k"), F.trim(F.coalesce(d["_VALUE"], F.lit(""))).alias("v")
        ),
    )
    read = doc.select(*keep, "_sysmon", "_source", event_id.alias("_id"),
                      system.alias("_s"), named.alias("_d"))
    read = read.where(F.col("_id").isNotNull())
    if allow:
        read = read.where(F.col("_id").isin(*allow, *always))

    def first_value(name: str) -> Column:
        # the first entry of a name counts, even when it is empty
        hits = F.filter(F.col("_d"), lambda d: d["k"] == name.lower())
        return F.nullif(F.get(hits, F.lit(0))["v"], F.lit(""))

    def pick(names: Sequence[str]) -> Column:
        return F.coalesce(*[first_value(n) for n in names])

    by_field: dict[str, Column] = {}
    for (number, from_sysmon), fields in rules.EVENT_XML_FIELDS.items():
        is_one = (F.col("_id") == number) & (F.col("_sysmon") == from_sysmon)
        for name, names in fields.items():
            earlier = by_field.get(name)
            by_field[name] = (
                F.when(is_one, pick(names)) if earlier is None
                else F.when(is_one, pick(names)).otherwise(earlier)
            )
    cleared = F.col("_id").isin(*rules.ANTI_FORENSIC_EVENTS) & ~F.col("_sysmon")
    stamp = F.col("_s.TimeCreated._SystemTime")
    moment = F.when(
        stamp.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), stamp.try_cast("timestamp")
    )
    return read.select(
        *keep,
        F.col("_id").alias("id"),
        F.coalesce(iso_z(moment), stamp).alias("time"),
        F.coalesce(F.col("_s.Provider._Name"), F.lit("")).alias("provider"),
        F.coalesce(F.col("_s.Computer"), F.lit("")).alias("computer"),
        F.col("_source").alias("artifact_source"),
        *[c.alias(n) for n, c in by_field.items()],
        F.when(cleared, "true").alias("anti_forensics"),
    )


def flatten_task_xml(df: DataFrame, xml_col: str, path_col: str) -> DataFrame:
    """Scheduled-task records: triggers, actions, arguments, account, author, date.

    Each field parses the document again, so a small table is first dealt out to all cores.
    """
    df = spread(df)

    def step(*names: str) -> str:
        return "".join(f"/*[local-name()='{n}']" for n in names)

    def texts(*names: str) -> Column:
        return F.transform(
            F.xpath(F.col(xml_col), F.lit(step(*names) + "/text()")), lambda t: F.trim(t)
        )

    def text(*names: str) -> Column:
        return F.trim(F.xpath_string(F.col(xml_col), F.lit(step(*names))))

    triggers = "TimeTrigger|CalendarTrigger|BootTrigger|LogonTrigger|IdleTrigger|EventTrigger|" \
        "RegistrationTrigger|SessionStateChangeTrigger|WnfStateChangeTrigger"
    body = F.regexp_extract(F.col(xml_col), r"(?s)<(?:\w+:)?Triggers[^>]*>(.*?)</(?:\w+:)?Triggers>", 1)
    each = F.regexp_extract_all(
        body,
        F.lit(rf"(?s)(<(?:\w+:)?(?:{triggers})\b[^>]*?(?:/>|>.*?</(?:\w+:)?(?:{triggers})>))"),
        F.lit(1),
    )
    kinds = F.transform(each, lambda t: F.regexp_extract(t, r"^<(?:\w+:)?(\w+)", 1))
    info = F.transform(
        each,
        lambda t: F.concat_ws(
            "@",
            F.regexp_extract(t, r"^<(?:\w+:)?(\w+)", 1),
            F.nullif(
                F.trim(F.regexp_extract(t, r"<(?:\w+:)?StartBoundary[^>]*>([^<]*)<", 1)),
                F.lit(""),
            ),
        ),
    )
    keep = [c for c in df.columns if c not in (xml_col, path_col)]
    return df.select(
        *keep,
        F.lit("persistence").alias("type"),
        F.lit("scheduled_task").alias("mechanism"),
        F.substring_index(F.col(path_col), "/", -1).alias("name"),
        F.col(path_col).alias("task_path"),
        F.array_join(info, ";").alias("trigger"),
        F.array_join(kinds, ";").alias("trigger_types"),
        F.array_join(texts("Task", "Actions", "Exec", "Command"), ";").alias("action"),
        F.array_join(texts("Task", "Actions", "Exec", "Arguments"), ";").alias("action_args"),
        F.trim(
            F.xpath_string(
                F.col(xml_col),
                F.lit(step("Task", "Principals") + "/*[1]" + step("UserId")),
            )
        ).alias("run_as"),
        text("Task", "RegistrationInfo", "Author").alias("author"),
        text("Task", "RegistrationInfo", "Date").alias("registered"),
        F.lit("Task_Scheduler").alias("artifact_source"),
    )
