"""Exported tables: registry, event and execution CSVs, browser history, call logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import rules
from spoor.functions import base_name, iso_z, unix_us_ts, webkit_ts


def _named(df: DataFrame, *names: str) -> Column:
    """First non-empty of the named columns that exist; null when none has a value."""
    have = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def read_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """All-string CSV with a header.

    Files are split between tasks. ``multi_line`` allows line ends inside quoted cells; a
    file is then read by one task.
    """
    return spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multi_line, escape='"', quote='"'
    )


def registry_records(df: DataFrame) -> DataFrame:
    """Registry rows with the file they belong to (``autoruns`` or ``misc``)."""
    hive = _named(df, "HiveType", "hivetype")
    key = F.coalesce(_named(df, "KeyPath", "keypath"), F.lit(""))
    category = _named(df, "Category", "category")
    low = F.lower(F.coalesce(category, F.lit("")))
    source = _named(df, "HivePath", "hivepath")
    auto = F.lit(False)
    for c in rules.AUTORUN_CATEGORIES:
        auto = auto | low.contains(c)
    return df.select(
        F.lit("registry").alias("type"),
        F.when(hive.isNotNull(), F.concat(hive, F.lit("\\"), key)).otherwise(key).alias("key"),
        _named(df, "ValueName", "valuename").alias("value"),
        _named(df, "ValueData", "valuedata").alias("data"),
        _named(df, "LastWriteTimestamp", "lastwritetimestamp").alias("modified"),
        category.alias("category"),
        _named(df, "Description", "description").alias("description"),
        F.coalesce(F.substring_index(source, "/", -1), F.lit("registry")).alias(
            "artifact_source"
        ),
        F.when(auto, "autoruns").otherwise("misc").alias("bucket"),
    )


def event_records(
    df: DataFrame,
    allow: Sequence[int] = (),
    always: Sequence[int] = rules.ALWAYS_EMIT_EVENTS,
    columns: Mapping[str, str] = rules.EVENT_CSV_COLUMNS,
) -> DataFrame:
    """Event rows: allow-list or always-emit, dashes removed, logon type lifted out."""
    event_id = F.coalesce(F.trim(_named(df, "EventId")).try_cast("int"), F.lit(0))
    kept = df.where(event_id.isin(*allow, *always)) if allow else df

    def value(name: str) -> Column:
        return F.nullif(F.nullif(F.trim(_named(df, name)), F.lit("")), F.lit("-"))

    fields = {ours: value(theirs) for theirs, ours in columns.items() if ours != "id"}
    low = F.lower(F.coalesce(fields["channel"], F.lit("")))
    bucket = F.lit("eventlog_other.txt")
    for channel, target in reversed(rules.CHANNEL_FILES.items()):
        bucket = F.when(low.contains(channel), F.lit(target)).otherwise(bucket)
    logon = [
        F.when(
            F.lower(fields[d]).startswith("logon type:"),
            F.trim(F.regexp_extract(fields[d], r"(?s):(.*)$", 1)),
        )
        for d in ("detail3", "detail2", "detail1")
    ]
    return kept.select(
        F.lit("event").alias("type"),
        event_id.alias("id"),
        *[c.alias(n) for n, c in fields.items()],
        F.coalesce(*logon).alias("logon_type"),
        bucket.alias("bucket"),
    )


def execution_records(df: DataFrame, kind: str) -> DataFrame:
    """Execution rows of a ``shimcache`` or ``amcache`` export."""
    if kind == "shimcache":
        return df.select(
            F.lit("execution").alias("type"),
            _named(df, "Path", "path").alias("path"),
            _named(df, "LastModifiedTimeUTC", "lastmodifiedtimeutc", "DateTime").alias(
                "last_modified"
            ),
            _named(df, "Executed", "executed").alias("executed"),
            _named(df, "ControlSet", "controlset").alias("controlset"),
            F.lit("shimcache").alias("artifact_source"),
        ).where(F.col("path").isNotNull())
    digest = _named(df, "Sha256", "sha256", "FileID", "fileid")
    return df.select(
        F.lit("execution").alias("type"),
        _named(df, "FullPath", "Path", "path", "ApplicationName").alias("path"),
        _named(df, "FileKeyLastWriteTimestamp", "LastModifiedDateTimeUtc", "DateTime").alias(
            "last_modified"
        ),
        _named(df, "LinkDate", "linkdate").alias("link_date"),
        _named(df, "CompanyName", "companyname").alias("company"),
        F.when(digest.startswith("sha256:"), F.lower(digest))
        .otherwise(F.concat(F.lit("sha256:"), F.lower(digest)))
        .alias("hash"),
        F.lit("amcache").alias("artifact_source"),
    ).where(F.col("path").isNotNull() | F.col("hash").isNotNull())


def read_execution_csv(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Amcache exports are several files; only the file-entry ones are kept."""
    df = read_csv(spark, path)
    if kind == "amcache":
        name = F.lower(F.col("_metadata.file_name"))
        df = df.where(
            name.contains("applicationfile")
            | name.contains("unassociatedfile")
            | name.contains("fileentry")
        )
    return execution_records(df, kind)


# ---- browser history -------------------------------------------------------------

_BROWSER_COLUMNS = [
    "type", "browser", "event", "url", "title", "visit_count", "visit_time",
    "download_path", "download_start", "download_end", "received_bytes", "artifact_source",
]


def _have(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def browser_history(
    urls: DataFrame | None = None,
    downloads: DataFrame | None = None,
    places: DataFrame | None = None,
    annos: DataFrame | None = None,
    anno_attrs: DataFrame | None = None,
    legacy_downloads: DataFrame | None = None,
    browser: str = "chrome",
) -> DataFrame:
    """Visits and downloads of both browser families, with one clock and one schema."""
    parts: list[DataFrame] = []

    def add(df: DataFrame, name: str, event: str, source: str, **fields: Column) -> None:
        parts.append(
            df.select(
                F.lit("browser").alias("type"), F.lit(name).alias("browser"),
                F.lit(event).alias("event"), *[c.alias(n) for n, c in fields.items()],
                F.lit(source).alias("artifact_source"),
            )
        )

    if urls is not None:
        add(urls, browser, "visit", "chromium_history", url=_have(urls, "url"),
            title=_have(urls, "title"), visit_count=_have(urls, "visit_count", "bigint"),
            visit_time=iso_z(webkit_ts(_have(urls, "last_visit_time", "bigint"))))
    if downloads is not None:
        add(downloads, browser, "download", "chromium_history",
            download_path=_have(downloads, "target_path"), url=_have(downloads, "tab_url"),
            download_start=iso_z(webkit_ts(_have(downloads, "start_time", "bigint"))),
            download_end=iso_z(webkit_ts(_have(downloads, "end_time", "bigint"))),
            received_bytes=_have(downloads, "received_bytes", "bigint"))
    if places is not None:
        add(places, "firefox", "visit", "firefox_places", url=_have(places, "url"),
            title=_have(places, "title"), visit_count=_have(places, "visit_count", "bigint"),
            visit_time=iso_z(unix_us_ts(_have(places, "last_visit_date", "bigint"))))
    if legacy_downloads is not None:
        add(legacy_downloads, "firefox", "download", "firefox_places_legacy",
            download_path=F.col("target"), url=F.col("source"),
            download_start=iso_z(unix_us_ts(F.col("startTime"))))
    elif annos is not None and anno_attrs is not None and places is not None:
        targets = anno_attrs.where(F.col("name") == "downloads/destinationFileURI").select(
            F.col("id").alias("anno_attribute_id")
        )
        joined = annos.join(targets, "anno_attribute_id").join(
            places.select(F.col("id").alias("place_id"), "url"), "place_id"
        )
        add(joined, "firefox", "download", "firefox_places_annos",
            download_path=F.col("content"), url=F.col("url"),
            download_start=iso_z(unix_us_ts(F.col("dateAdded"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for name in _BROWSER_COLUMNS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out.select(*_BROWSER_COLUMNS)


# ---- call logs -------------------------------------------------------------------

CALL_LOG = T.StructType(
    [
        T.StructField("call_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("tokens_in", T.LongType()),
        T.StructField("tokens_out", T.LongType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("input_files", T.ArrayType(T.StringType())),
        T.StructField("output_files", T.ArrayType(T.StringType())),
        T.StructField("query_id", T.StringType()),
        T.StructField(
            "entity",
            T.StructType(
                [T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]
            ),
        ),
        T.StructField("verdict", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_call_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Call log rows; bad lines keep their text in ``_corrupt_record``; no file, no rows."""
    paths = [path] if isinstance(path, str) else list(path)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(p)
        if hadoop_path.getFileSystem(conf).globStatus(hadoop_path):
            found.append(p)
    if not found:
        return spark.createDataFrame([], CALL_LOG)
    return spark.read.schema(CALL_LOG).json(found)


def parse_call_log(c: Column) -> Column:
    return F.from_json(c, CALL_LOG, {"columnNameOfCorruptRecord": "_corrupt_record"})
