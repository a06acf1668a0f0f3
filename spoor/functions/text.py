"""Small text functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import rules
from spoor.functions.paths import file_ext

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def key_class(c: Column) -> Column:
    """How a search key is matched: ``path``, ``ip``, ``hash`` or ``word``."""
    return (
        F.when(c.rlike(r"[A-Za-z]:\\"), "path")
        .when(c.rlike(IPV4), "ip")
        .when(c.rlike(r"^[0-9a-fA-F]{32,}$"), "hash")
        .otherwise("word")
    )


def clip(c: Column, n: int = 100) -> Column:
    """One-line text of at most ``n`` characters, with an ellipsis when cut."""
    line = F.translate(F.coalesce(c, F.lit("")), "\n\r", "  ")
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def image_is(c: Column, full_name: str) -> Column:
    """Name equality that accepts the 14-character form memory tools report."""
    low = F.lower(c)
    return (low == full_name.lower()) | (low == full_name.lower()[: rules.NAME_LIMIT])


def safe_int(c: Column, default: int = 0) -> Column:
    """Integer from decimal or ``0x`` text; ``default`` when it is neither."""
    digits = F.regexp_extract(c, r"^0x([0-9a-fA-F]+)$", 1)
    return F.coalesce(
        F.when(digits != "", F.conv(digits, 16, 10).try_cast("bigint")),
        F.trim(c).try_cast("bigint"),
        F.lit(default).cast("bigint"),
    )


def suspicious_imports(c: Column, names: Sequence[str] = rules.SUSPICIOUS_IMPORTS) -> Column:
    """Sorted, ``;``-joined imports of the watched set; null when there is none."""
    found = F.array_sort(F.array_intersect(c, F.array(*[F.lit(n) for n in names])))
    return F.when(F.size(found) > 0, F.array_join(found, ";"))


def enabled_privs(c: Column) -> Column:
    """Names of the enabled entries of a ``name|attributes;...`` list."""
    entries = F.filter(
        F.split(c, ";"),
        lambda e: e.contains("|") & F.regexp_extract(e, r"\|(.*)$", 1).contains("Enabled"),
    )
    return F.transform(entries, lambda e: F.trim(F.split(e, r"\|")[0]))


def notable_privs(c: Column, names: Sequence[str] = rules.NOTABLE_PRIVILEGES) -> Column:
    return F.filter(enabled_privs(c), lambda p: p.isin(list(names)))


def magic_mismatch(path: Column, head: Column) -> Column:
    """Flag an executable body under an extension that does not announce one."""
    ext = file_ext(path)
    body = F.substring(head.cast("string"), 1, 2)
    return F.when(
        (body == "MZ") & (ext != "") & ~ext.isin(rules.IMAGE_EXTENSIONS),
        F.concat(F.lit("mismatch:claimed_"), F.ltrim(ext, F.lit(".")), F.lit("_is_PE")),
    )


def json_from_text(c: Column, schema: T.StructType) -> Column:
    """A JSON object from free text: as is, inside a fence, or between the outer braces."""
    fenced = F.regexp_extract(c, r"(?s)^\s*```(?:json|JSON)?\s*(.*?)\s*(?:```)?\s*$", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    options = {"columnNameOfCorruptRecord": "_bad"}
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])

    def attempt(text: Column) -> Column:
        parsed = F.from_json(text, wide, options)
        good = parsed.isNotNull() & parsed["_bad"].isNull() & text.rlike(r"(?s)^\s*\{.*\}\s*$")
        return F.when(good, parsed.dropFields("_bad"))

    return F.coalesce(attempt(c), attempt(fenced), attempt(braces))
