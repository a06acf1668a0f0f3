"""URL verdicts by rules and by a tree of path templates, with DataFrame operations only.

Rules decide first. The URLs they decide are the labels from which templates are judged:
per host, a path segment stays as it is if enough URLs have it at its place in the tree, and
becomes a wildcard otherwise, level by level down to the last segment; branches of a host whose block rates do not differ from
the host's in a two-proportion test are merged; a template's rate is smoothed towards that
of the same path on all hosts, and that towards the rate of the whole table. Templates whose
smoothed purity, the share of allowed URLs, is under one half are rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.llm.common import cut

SUPPORT = 3  # URLs at its place that keep a segment literal
FLAT = 4  # levels between two cuts of the lineage
WEIGHT = 5.0
PURITY = 0.5
Z = 1.96
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path``; both empty for a null url or one without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumns(
        {
            "host": F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER),
            "path": F.regexp_extract(url, PARTS, 2),
        }
    )


def by_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``rule`` and ``ruled``: the longest fitting rule and its verdict, or nulls."""
    rule = ruled = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = (
            ((F.col("host") == host) | F.endswith("host", F.lit("." + host)))
            & F.startswith("path", F.lit(path))
        )
        name, said = F.lit(host + path), F.lit(verdict)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        ruled = F.when(fits, said) if ruled is None else ruled.when(fits, said)
    none = F.lit(None).cast("string")
    return df.withColumns(
        {"rule": none if rule is None else rule, "ruled": none if ruled is None else ruled}
    )


def shared_depth(df: DataFrame) -> int:
    """The deepest level at which ``SUPPORT`` URLs of one host have a segment.

    Below it every segment is a wildcard. The driver sees one number.
    """
    depths = df.groupBy("host", (F.size("_p") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    deeper = Window.partitionBy("host").orderBy(F.col("d").desc())
    enough = depths.withColumn("m", F.sum("n").over(deeper)).where(F.col("m") >= SUPPORT)
    return enough.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]


def with_template(df: DataFrame) -> DataFrame:
    """``df`` with ``template``, its path with variable segments as ``*``.

    Per level, the literal children of a place are found by an aggregate with map-side combine
    and joined back to the rows. There are as many levels as URLs of a host share.
    """
    out = cut(df.withColumns({"_p": F.split("path", "/"), "template": F.lit("")}))
    last = shared_depth(out)
    for level in range(1, last + 1):
        out = out.withColumn("_s", F.expr(f"get(_p, {level})"))
        literal = (
            out.where(F.col("_s").isNotNull())
            .groupBy("host", "template", "_s")
            .agg(F.count(F.lit(1)).alias("c"))
            .where(F.col("c") >= SUPPORT)
            .select("host", "template", "_s", F.lit(True).alias("_keep"))
        )
        out = out.join(literal, ["host", "template", "_s"], "left").withColumn(
            "template",
            F.when(F.col("_s").isNull(), F.col("template")).otherwise(
                F.concat("template", F.lit("/"), F.when(F.col("_keep"), F.col("_s")).otherwise("*"))
            ),
        ).drop("_keep", "_s")
        if level % FLAT == 0:
            out = cut(out)
    rest = F.greatest(F.size("_p") - 1 - last, F.lit(0))
    return out.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), rest))).drop("_p")


def template_rates(marked: DataFrame) -> DataFrame:
    """``(host, template, rate)``: the smoothed block rate of each template of each host."""
    blocked = F.sum((F.col("ruled") == "block").cast("long"))
    counts = cut(
        marked.groupBy("host", "template").agg(
            F.count("ruled").alias("n"), F.coalesce(blocked, F.lit(0)).alias("b")
        )
    )
    whole = counts.agg(F.sum("n").alias("wn"), F.sum("b").alias("wb"))
    rate = lambda b, n, prior: (b + WEIGHT * prior) / (n + WEIGHT)
    paths = (
        counts.groupBy("template")
        .agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))
        .join(F.broadcast(whole))  # one row
        .select(
            "template",
            rate(F.col("tb"), F.col("tn"), (F.col("wb") + 1) / (F.col("wn") + 2)).alias("prior"),
        )
    )
    hosts = counts.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb"))
    branches = counts.join(hosts, "host")
    # a branch against the rest of its host
    rest_n, rest_b = F.col("hn") - F.col("n"), F.col("hb") - F.col("b")
    pooled = F.col("hb") / F.col("hn")
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / rest_n))
    differs = F.abs(F.col("b") / F.col("n") - rest_b / rest_n) > Z * spread
    alike = (F.col("n") > 0) & (rest_n > 0) & ~F.coalesce(differs, F.lit(False))
    branches = branches.withColumn("alike", F.when((F.col("n") > 0) & (rest_n > 0), alike).otherwise(False))
    merged = branches.where("alike").groupBy("host").agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"))
    return (
        branches.join(merged, "host", "left")
        .join(paths, "template")
        .select(
            "host",
            "template",
            rate(
                F.when(F.col("alike"), F.col("mb")).otherwise(F.col("b")),
                F.when(F.col("alike"), F.col("mn")).otherwise(F.col("n")),
                F.col("prior"),
            ).alias("rate"),
        )
    )


def judge(df: DataFrame, rules: Sequence[Rule], url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """``(id, host, path, rule, template, verdict)`` of every row.

    ``verdict`` is allow or block: the rule's, else the template's. Defined results: a null
    url or one without ``://`` has empty host and path and is judged as that template;
    repeated rows and null ids are kept; without labels everything not ruled is judged by a
    rate of one half and blocked only if over it; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = split_url(df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))).drop("url")
    marked = cut(with_template(by_rules(rows, rules)))
    judged = marked.join(template_rates(marked), ["host", "template"])
    method = F.when(1 - F.col("rate") < PURITY, "block").otherwise("allow")
    return judged.select(
        "id", "host", "path", "rule", "template", F.coalesce("ruled", method).alias("verdict")
    )


ORACLE = f"""
WITH RECURSIVE parts AS (
  SELECT page_id AS id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
fits AS (
  SELECT *, '.' || host AS dotted FROM parts),
ruled AS (
  SELECT id, host, path, CASE
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM fits),
l0 AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
  string_split(path, '/') AS p, '' AS t FROM ruled),
l AS (
  SELECT id, host, path, rule, ruled, p, 1 AS k, t FROM l0
  UNION ALL SELECT id, host, path, rule, ruled, p, k + 1,
    t || '/' || CASE WHEN count(*) OVER (PARTITION BY host, t, p[k + 1]) >= {SUPPORT} THEN p[k + 1] ELSE '*' END
  FROM l WHERE len(p) > k),
marked AS (SELECT *, t AS template FROM l WHERE k = len(p)),
counts AS (SELECT host, template, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS b FROM marked GROUP BY ALL),
whole AS (SELECT sum(n) AS wn, sum(b) AS wb FROM counts),
paths AS (SELECT template, (sum(b) + {WEIGHT} * ((SELECT wb FROM whole) + 1) / ((SELECT wn FROM whole) + 2)) / (sum(n) + {WEIGHT}) AS prior
  FROM counts GROUP BY template),
sums AS (SELECT *, sum(n) OVER (PARTITION BY host) AS hn, sum(b) OVER (PARTITION BY host) AS hb FROM counts),
tested AS (SELECT *, CASE WHEN n > 0 AND hn - n > 0 THEN NOT abs(b / n::DOUBLE - (hb - b) / (hn - n)::DOUBLE)
    > {Z} * sqrt((hb / hn::DOUBLE) * (1 - hb / hn::DOUBLE) * (1 / n::DOUBLE + 1 / (hn - n)::DOUBLE)) ELSE false END AS alike FROM sums),
merged AS (SELECT *, sum(n) FILTER (alike) OVER (PARTITION BY host) AS mn, sum(b) FILTER (alike) OVER (PARTITION BY host) AS mb FROM tested),
rates AS (SELECT host, template, (CASE WHEN alike THEN mb ELSE b END + {WEIGHT} * prior) / (CASE WHEN alike THEN mn ELSE n END + {WEIGHT}) AS rate
  FROM merged JOIN paths USING (template))
SELECT id AS page_id, host, path, rule, coalesce(ruled, CASE WHEN 1 - rate < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM marked JOIN rates USING (host, template)
"""
