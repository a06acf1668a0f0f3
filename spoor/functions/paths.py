"""Path text: separators, environment names, base names, extensions, prefixes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoor import rules


def norm_path(c: Column) -> Column:
    return F.lower(F.replace(F.trim(c), F.lit("/"), F.lit("\\")))


def expand_env(c: Column, environment: Mapping[str, str] = rules.ENVIRONMENT) -> Column:
    """Replace the known environment names of a lower-case path."""
    return reduce(
        lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), environment.items(), c
    )


def base_name(c: Column) -> Column:
    """Text after the last slash or backslash; empty when the path ends with one."""
    return F.substring_index(F.replace(c, F.lit("/"), F.lit("\\")), "\\", -1)


def file_ext(c: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for leading-dot names."""
    name = F.substring_index(F.lower(c), "/", -1)
    tail = F.substring_index(name, ".", -1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(tail) - 1)
    named = name.contains(".") & (F.ltrim(stem, F.lit(".")) != "") & ~tail.contains("\\")
    return F.when(named, F.concat(F.lit("."), tail)).otherwise(F.when(c.isNotNull(), ""))


def _one_of(items: Sequence[str]) -> str:
    return "(" + "|".join(re.escape(i.lower()) for i in items) + ")"


def contains_any(c: Column, items: Sequence[str]) -> Column:
    """True when any item occurs in the text, ignoring case; false for null.

    One pattern, so the text expression is evaluated once however long the list is. The items
    are tried only where the first letter of one stands.
    """
    if not items:
        return F.lit(False)
    first = "".join(sorted({re.escape(i.lower()[:1]) for i in items})) if all(items) else ""
    ahead = f"(?=[{first}])" if first else ""
    return F.coalesce(F.lower(c).rlike(ahead + _one_of(items)), F.lit(False))


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    if not prefixes:
        return F.lit(False)
    return F.coalesce(c.rlike("^" + _one_of(prefixes)), F.lit(False))


def ext_in(c: Column, extensions: Sequence[str]) -> Column:
    """True when the file extension is listed; one pattern, so the path is read once."""
    listed = "|".join(re.escape(e.lower().lstrip(".")) for e in extensions)
    return F.coalesce(F.lower(c).rlike(rf"[^/.]\.+({listed})$"), F.lit(False))


def under_prefix(c: Column, prefixes: Sequence[str], compat: bool = False) -> Column:
    """True when the path, without its drive, starts with one of the prefixes.

    ``compat`` skips any leading run of the characters ``c``, ``:`` and ``\\``
    instead of a drive, so that ``catalog`` is compared as ``atalog``.
    """
    if not prefixes:
        return F.lit(False)
    skip = r"[c:\\/]*+" if compat else r"(?:[a-z]:)?+[\\/]*+"
    listed = "|".join(re.escape(p.lower()).replace(r"\\", r"[\\/]") for p in prefixes)
    return F.coalesce(F.lower(c).rlike(f"^{skip}({listed})"), F.lit(False))


def glob_regex(pattern: str) -> str:
    """Regular expression of a whole ``*``/``?`` pattern."""
    parts = {"*": ".*", "?": "."}
    return "".join(parts.get(ch, re.escape(ch)) for ch in pattern)


def glob_any(c: Column, patterns: Sequence[str]) -> Column:
    """True when the normalised path matches one of the patterns; false for empty."""
    if not patterns:
        return F.lit(False)
    whole = "|".join(glob_regex(p.lower()) for p in patterns)
    return F.coalesce(norm_path(c).rlike(f"(?s)^({whole})$"), F.lit(False))
