"""``key=value`` artifact records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.sources.lines import read_lines

# a key up to '=', then a quoted value with escapes, or text up to the next blank
PAIR = r' *([^=]*)=("(?:\\.|[^"\\]|\\$)*"?|[^ ]*)'


def last_wins_map(pairs: Column) -> Column:
    """Map from an array of ``(k, v)``: first position of a key, last value."""

    def build(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: p["k"]))
        values = F.transform(
            keys, lambda k: F.element_at(F.filter(ps, lambda p: p["k"] == k), -1)["v"]
        )
        return F.map_from_arrays(keys, values)

    # bound as a lambda variable, the pairs are computed once per row
    return F.transform(F.array(pairs), build)[0]


def parse_kv(c: Column) -> Column:
    """MAP of one record line; null for lines that are not records."""
    line = F.trim(c)

    def pair(text: Column) -> Column:
        value = F.regexp_extract(text, PAIR, 2)
        body = F.regexp_extract(value, r'(?s)^"((?:\\.|[^"\\]|\\$)*)"?$', 1)
        unescaped = F.regexp_replace(body, r'(?s)\\(")|(\\).', "$1$2")
        return F.struct(
            F.regexp_extract(text, PAIR, 1).alias("k"),
            F.when(value.startswith('"'), unescaped).otherwise(value).alias("v"),
        )

    pairs = F.transform(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0)), pair)
    return F.when(line.startswith("type="), last_wins_map(pairs))


def parse_kv_lines(lines: DataFrame) -> DataFrame:
    """Record lines of numbered lines, with the parsed ``rec`` map."""
    return lines.where(F.ltrim(F.col("content")).startswith("type=")).withColumn(
        "rec", parse_kv(F.col("content"))
    )


def read_kv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_kv_lines(read_lines(spark, path)).select(
        "source_file", "line_no", F.col("content").alias("raw"), "rec"
    )


def to_kv_line(record: Column) -> Column:
    """Record line of a MAP: ``type`` first, empty values dropped, values quoted only when
    they must be."""
    given = F.filter(
        F.map_entries(record), lambda e: e["value"].isNotNull() & (e["value"] != "")
    )
    filled = F.concat(
        F.filter(given, lambda e: e["key"] == "type"), F.filter(given, lambda e: e["key"] != "type")
    )

    def render(e: Column) -> Column:
        v = e["value"]
        escaped = F.replace(
            F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')
        )
        quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
        return F.concat(e["key"], F.lit("="), F.when(v.rlike('[ \t="]'), quoted).otherwise(v))

    return F.array_join(F.transform(filled, render), " ")
