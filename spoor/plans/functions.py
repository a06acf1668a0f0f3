"""Scalar functions over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor import functions as fn
from spoor.functions.entities import extract_indicators
from spoor.operators import files as file_ops
from spoor.plans.bindings import load, oracle, run_sql, view

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return keep


@register("filetime_clock", """
WITH t AS (SELECT o_orderkey, epoch_us(o_orderdate) * 10 + 116444736000000000 + o_orderkey % 10 AS ft,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 1 THEN strftime(make_timestamp((ft - 116444736000000000) // 10),
  '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM t""")
def filetime_clock(spark, sf):
    o = load(spark, sf, "orders")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    ticks = us * 10 + F.lit(116444736000000000) + F.col("o_orderkey") % 10
    ticks = F.when(F.col("o_orderkey") % 3 != 0, ticks).otherwise(F.lit(0))
    return o.select("o_orderkey", fn.iso_z(fn.filetime_ts(ticks)).alias("iso"))


@register("browser_clocks", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS webkit, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS unix_us,
  CASE WHEN event_id % 2 = 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS epoch
FROM events""")
def browser_clocks(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.when(F.col("event_id") % 2 == 1, F.floor(us / 1_000_000)).otherwise(0)
    return load(spark, sf, "events").select(
        "event_id",
        fn.iso_z(fn.webkit_ts(us + F.lit(11644473600000000))).alias("webkit"),
        fn.iso_z(fn.unix_us_ts(us)).alias("unix_us"),
        fn.epoch_iso(seconds).alias("epoch"),
    )


@register("parse_iso_text", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL
  WHEN 2 THEN epoch_us(date_trunc('day', ts)) WHEN 1 THEN epoch_us(ts)
  ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events""")
def parse_iso_text(spark, sf):
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.lit("yesterday"))
    )
    return load(spark, sf, "events").select(
        "event_id", F.unix_micros(fn.parse_iso(text)).alias("us")
    )


@register("first_iso_in_line", """
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM events""")
def first_iso_in_line(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat_ws(
        " ", F.lit("type=event"), F.when(F.col("event_id") % 3 > 0, stamp), F.lit("x=2024-01-01")
    )
    return load(spark, sf, "events").select("event_id", fn.first_iso(line).alias("stamp"))


@register("path_parts", oracle("""
SELECT line_no, lower(trim(path)) AS norm, regexp_extract(path, '[^\\\\/]*$') AS base,
  regexp_extract(lower(path), '[^/.][^/]*(\\.[^./\\\\]*)$', 1) AS ext,
  replace(replace(lower(replace('%WINDIR%/x/' || path, '/', chr(92))), '%windir%', 'c:' || chr(92) || 'windows'),
    '%none%', '') AS expanded
FROM files""", "files"))
def path_parts(spark, sf):
    f = view(spark, sf, "files")
    return f.select(
        "line_no",
        fn.norm_path(F.col("path")).alias("norm"),
        fn.base_name(F.col("path")).alias("base"),
        fn.file_ext(F.col("path")).alias("ext"),
        fn.expand_env(fn.norm_path(F.concat(F.lit("%WINDIR%/x/"), "path"))).alias("expanded"),
    )


@register("path_tests", oracle("""
SELECT line_no,
  contains(lower(path), 'appdata\\roaming') OR contains(lower(path), '\\downloads\\') AS hot,
  starts_with(lower(path), 'windows\\system32') OR starts_with(lower(path), 'programdata\\microsoft') AS trusted,
  lower(path) LIKE 'users\\%\\f1%.exe' OR lower(path) LIKE 'windows\\%' AS globbed
FROM files""".replace("\\", "\\"), "files"))
def path_tests(spark, sf):
    p = F.col("path")
    return view(spark, sf, "files").select(
        "line_no",
        fn.contains_any(p, ["AppData\\Roaming", "\\Downloads\\"]).alias("hot"),
        fn.under_prefix(p, ["windows\\system32", "programdata\\microsoft"]).alias("trusted"),
        fn.glob_any(p, ["users\\*\\f1*.exe", "Windows\\*"]).alias("globbed"),
    )


@register("text_entropy", """
WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS s FROM documents),
c AS (SELECT doc_id, s, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY ALL)
SELECT doc_id, round(abs(-sum((n / total) * log2(n / total))), 3) AS entropy FROM c JOIN t USING (doc_id) GROUP BY ALL""")
def text_entropy(spark, sf):
    return file_ops.entropy(load(spark, sf, "documents"), ["doc_id"], "text")


@register("content_hash", """
SELECT doc_id, sha256(text) AS sha256, CASE doc_id % 3 WHEN 0 THEN 'hash_md5' WHEN 1 THEN 'hash_sha256' END AS kind FROM documents""")
def content_hash(spark, sf):
    d = load(spark, sf, "documents")
    h = F.sha2(F.encode("text", "UTF-8"), 256)
    value = F.when(F.col("doc_id") % 3 == 0, F.substring(h, 1, 32)).when(
        F.col("doc_id") % 3 == 1, h).otherwise(F.substring(h, 1, 33))
    return d.select("doc_id", h.alias("sha256"), fn.hash_kind(value).alias("kind"))


@register("magic_mismatch", oracle("""
SELECT line_no, CASE WHEN ext NOT IN ('', '.exe', '.dll') AND line_no % 2 = 1
  THEN 'mismatch:claimed_' || substr(ext, 2) || '_is_PE' END AS flag
FROM (SELECT *, regexp_extract(lower(path), '(\\.[a-z0-9]*)$', 1) AS ext FROM files)""", "files"))
def magic_mismatch(spark, sf):
    head = F.when(F.col("line_no") % 2 == 1, F.lit("MZ\x90")).otherwise("ZM")
    return view(spark, sf, "files").select(
        "line_no", fn.magic_mismatch(F.col("path"), head).alias("flag")
    )


_VALUES = """
SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'HKLM' || chr(92) || source
  WHEN 1 THEN 'https://' || source || '.example.com/a.exe' WHEN 2 THEN '10.1.2.' || CAST(doc_id % 256 AS STRING) || '/24 (net)'
  WHEN 3 THEN 'S-1-5-21-' || CAST(doc_id AS STRING) WHEN 4 THEN lang || '@example.org'
  WHEN 5 THEN sha256(text) WHEN 6 THEN 'CORP' || chr(92) || source
  WHEN 7 THEN 'Global' || chr(92) || source WHEN 8 THEN 'C:' || chr(92) || source || '.txt'
  WHEN 9 THEN source || '.EXE' WHEN 10 THEN source || '.example.com' ELSE source || ' thing' END AS value,
  CASE doc_id % 5 WHEN 0 THEN 'mutex' WHEN 1 THEN 'nonsense' WHEN 2 THEN NULL WHEN 3 THEN 'ip' ELSE 'pid' END AS declared
FROM {documents}"""


@register("entity_type_shape", f"""
WITH v AS ({_VALUES.replace('{documents}', 'documents')}),
i AS (SELECT *, CASE doc_id % 12 WHEN 0 THEN 'registry_key' WHEN 1 THEN 'url' WHEN 2 THEN 'ip'
  WHEN 3 THEN 'user_sid' WHEN 4 THEN 'user_sid' WHEN 5 THEN 'hash_sha256' WHEN 6 THEN 'user_sid'
  WHEN 8 THEN 'file_path' WHEN 9 THEN 'image_name' WHEN 10 THEN 'domain' END AS inferred FROM v)
SELECT doc_id, inferred, coalesce(inferred, CASE WHEN declared IN ('mutex', 'ip', 'pid') THEN declared END, 'image_name') AS type,
  coalesce(inferred <> declared, false) AS overridden FROM i""")
def entity_type_shape(spark, sf):
    v = run_sql(spark, sf, _VALUES.replace("sha256(text)", "sha2(text, 256)"))
    n = fn.normalize_type(F.col("value"), F.col("declared"))
    return v.select(
        "doc_id", fn.infer_type(F.col("value")).alias("inferred"), n["type"].alias("type"),
        n["overridden"].alias("overridden"),
    )


@register("technique_ids", """
SELECT doc_id, 'T' || CAST(1000 + doc_id % 50 AS STRING) || ',T1059.00' || CAST(doc_id % 4 AS STRING) AS ids,
  'T1059.00' || CAST(doc_id % 4 AS STRING) AS valid FROM documents""")
def technique_ids(spark, sf):
    d = load(spark, sf, "documents")
    sub = F.concat(F.lit("T1059.00"), (F.col("doc_id") % 4).cast("string"))
    top = F.concat(F.lit("T"), (F.col("doc_id") % 50 + 1000).cast("string"))
    text = F.concat(top, F.lit(" — x; "), sub, F.lit(" T12"))
    listed = F.array(sub, F.lit("T99"), sub, F.concat(top, F.lit("x")))
    return d.select(
        "doc_id",
        F.array_join(fn.mitre_ids(text), ",").alias("ids"),
        F.array_join(fn.valid_mitre(listed), ",").alias("valid"),
    )


@register("detection_verdict", """
SELECT event_id, CASE WHEN m = 0 OR t = 0 THEN 'NOT_FOUND' WHEN m <= 2 THEN 'INCONCLUSIVE' ELSE 'CONFIRMED' END AS verdict,
  CASE WHEN t = 0 OR m <= 2 THEN NULL WHEN m <= 4 THEN 'LOW' WHEN m <= 9 THEN 'MEDIUM' WHEN m <= 29 THEN 'HIGH' ELSE 'CRITICAL' END AS severity
FROM (SELECT event_id, event_id % 45 AS m, event_id % 7 * 20 AS t FROM events)""")
def detection_verdict(spark, sf):
    v = fn.detection_verdict(F.col("event_id") % 45, F.col("event_id") % 7 * 20)
    return load(spark, sf, "events").select(
        "event_id", v["verdict"].alias("verdict"), v["severity"].alias("severity")
    )


@register("indicators_in_text", """
WITH ips AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(\\d{1,3}(?:\\.\\d{1,3}){3})\\b', 1)) AS value FROM documents)
SELECT DISTINCT doc_id, 'ip' AS type, value, 'outbound_or_listening' AS relationship FROM ips
WHERE NOT (starts_with(value, '127.') OR starts_with(value, '10.') OR starts_with(value, '192.168.') OR value = '0.0.0.0')
UNION ALL SELECT doc_id, 'user_sid', 'S-1-5-21-' || CAST(doc_id AS STRING), 'process_owner' FROM documents
UNION ALL SELECT doc_id, 'file_path', 'C:' || chr(92) || 'Temp' || chr(92) || source || '.exe', 'referenced_path' FROM documents""")
def indicators_in_text(spark, sf):
    d = load(spark, sf, "documents")
    extra = F.concat(F.lit(" S-1-5-21-"), F.col("doc_id").cast("string"), F.lit(" C:\\Temp\\"),
                     "source", F.lit(".exe | "))
    found = extract_indicators(F.concat("text", extra))
    return d.select("doc_id", F.explode(found).alias("e")).select(
        "doc_id", "e.type", "e.value", "e.relationship"
    )


@register("privilege_lists", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'SeDebugPrivilege,SeShutdownPrivilege' ELSE 'SeShutdownPrivilege' END AS enabled,
  CASE WHEN o_orderkey % 2 = 0 THEN 'SeDebugPrivilege' ELSE '' END AS notable FROM orders""")
def privilege_lists(spark, sf):
    state = F.when(F.col("o_orderkey") % 2 == 0, "Present,Enabled").otherwise("Present")
    text = F.concat(
        F.lit("SeDebugPrivilege|"), state,
        F.lit("; SeShutdownPrivilege|Enabled,Default;SeTcbPrivilege|;bare;"),
    )
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.array_join(fn.enabled_privs(text), ",").alias("enabled"),
        F.array_join(fn.notable_privs(text), ",").alias("notable"),
    )


@register("key_classes", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'ip' WHEN 2 THEN 'hash' ELSE 'word' END AS kind FROM documents""")
def key_classes(spark, sf):
    n = F.col("doc_id") % 4
    value = (
        F.when(n == 0, F.concat(F.lit("run C:\\"), "source"))
        .when(n == 1, F.lit("1.2.3.4"))
        .when(n == 2, F.sha2("text", 256))
        .otherwise(F.col("source"))
    )
    return load(spark, sf, "documents").select("doc_id", fn.key_class(value).alias("kind"))


@register("reputation_paths", """
SELECT page_id, 'urls/' || rtrim(replace(replace(base64(encode(url)), '+', '-'), '/', '_'), '=') AS url_path,
  CASE page_id % 3 WHEN 0 THEN 'domains/' || url WHEN 1 THEN 'files/' || url END AS other_path FROM pages""")
def reputation_paths(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "domain").when(
        F.col("page_id") % 3 == 1, "hash_sha1").otherwise("pid")
    return load(spark, sf, "pages").select(
        "page_id",
        fn.lookup_path(F.lit("url"), F.col("url")).alias("url_path"),
        fn.lookup_path(kind, F.col("url")).alias("other_path"),
    )


@register("json_in_text", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_in_text(spark, sf):
    from pyspark.sql import types as T

    n = F.col("event_id") % 4
    text = (
        F.when(n == 0, F.col("props"))
        .when(n == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(n == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" done.")))
        .otherwise("no object {here")
    )
    schema = T.StructType([T.StructField("k", T.LongType())])
    return load(spark, sf, "events").select(
        "event_id", fn.json_from_text(text, schema)["k"].alias("k")
    )


@register("clip_and_tokens", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(translate(text, chr(10) || chr(13), '  '), 1, 100) || '…'
  ELSE translate(text, chr(10) || chr(13), '  ') END AS clipped, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents""")
def clip_and_tokens(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", fn.clip(F.col("text")).alias("clipped"),
        fn.token_estimate(F.col("text")).alias("tokens"),
    )


@register("short_image_names", oracle("""
SELECT pid, case_id, image IN ('fontdrvhost.ex', 'fontdrvhost.exe') AS font, lower(image) = 'system' AS kernel FROM proc""", "proc"))
def short_image_names(spark, sf):
    from spoor.functions.text import image_is

    return view(spark, sf, "proc").select(
        "pid", "case_id", image_is(F.col("image"), "FontDrvHost.exe").alias("font"),
        image_is(F.col("image"), "System").alias("kernel"),
    )


@register("safe_integers", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN -1 ELSE o_orderkey END AS n FROM orders""")
def safe_integers(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, k.cast("string")).when(
        k % 3 == 1, F.concat(F.lit("0x"), F.lower(F.hex(k)))).otherwise("n/a")
    return load(spark, sf, "orders").select("o_orderkey", fn.safe_int(text, -1).alias("n"))


@register("watched_imports", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'CreateRemoteThread;VirtualAllocEx' WHEN 1 THEN 'VirtualProtect' END AS found FROM orders""")
def watched_imports(spark, sf):
    k = F.col("o_orderkey") % 3
    names = (
        F.when(k == 0, F.split(F.lit("VirtualAllocEx,ReadFile,CreateRemoteThread,VirtualAllocEx"), ","))
        .when(k == 1, F.split(F.lit("VirtualProtect,ReadFile"), ","))
        .otherwise(F.split(F.lit("ReadFile"), ","))
    )
    return load(spark, sf, "orders").select("o_orderkey", fn.suspicious_imports(names).alias("found"))
