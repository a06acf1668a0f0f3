"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests accepts.

A token is a run of 20 or more letters, digits and marks that keys are written with. Its
encoding is the smallest alphabet that explains it; a run that none explains, such as a path
before a key, is read in parts. Under that alphabet three tests ask
whether it could be drawn at random: chi-squared uniformity of the symbols, the number of
runs above and below the middle symbol, and the correlation of neighbouring symbols. Their
joint p-value is uniform for random tokens and near zero for words, paths and counters.

How large a p-value a secret needs follows from the whole corpus, apart for every encoding
and length: the p-values above ``SURE`` tell how many tokens are random, and the lowest
threshold is taken at which the share of other tokens above it stays within the false
discovery rate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import cut

# fixed values of the base patterns
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

TOKEN_LENGTH = 20
# "=" is trailing padding only: before more of these characters it ends a name
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
PART, URL_SAFE = re.compile(r"[^/_-]+"), re.compile(r"[^_-]+")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# alphabets, the narrower first
ENCODINGS = (
    ("digits", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("hex_upper", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("base36_upper", DIGITS + UPPER),
    ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
SETS = [(name, {c: i for i, c in enumerate(letters)}) for name, letters in ENCODINGS]
RATE = 0.1
BINS = 20
# bins of p-values, from this one up, that only random tokens fill
SURE = 4
NEVER = 2.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= ASSIGN_VALUE:
                spans.append((m.start(), m.end(), 0))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LENGTH:
                spans.append((m.start(), m.end(), 1))
    spans.extend((m.start(), m.end(), 2) for m in HEX.finditer(text))
    return spans


def has_token(text: str) -> bool:
    """True if some run of key characters is long enough for a token."""
    good = TOKEN_BYTE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    stops = np.flatnonzero(~good)
    edges = np.concatenate([[-1], stops, [len(good)]])
    return bool((np.diff(edges) > TOKEN_LENGTH).any())


def encoding(token: str) -> tuple[str, list[int]] | None:
    """Name of the narrowest alphabet of a token, and its symbols as numbers.

    Trailing padding is not part of it, nor are dashes between groups of hex digits.
    A token of letters of one case, or without any digit, is read in the widest alphabet:
    words do not make an alphabet of their own.
    """
    body = token.rstrip("=")
    plain = body.replace("-", "")
    if plain and set(plain) <= SETS[1][1].keys():
        body = plain
    letters = set(body)
    if "=" in letters or len(body) < TOKEN_LENGTH:
        return None
    wordy = not any(c in DIGITS for c in letters)
    for name, places in SETS[6:] if wordy else SETS:
        if letters <= places.keys():
            return name, [places[c] for c in body]
    return None


def tail(chi: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by the Wilson-Hilferty cube root."""
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return math.erfc(z / math.sqrt(2)) / 2


def p_value(symbols: list[int], size: int) -> float:
    """Joint p-value of the three tests for symbols drawn evenly from ``size``."""
    x = np.asarray(symbols)
    n = len(x)
    counts = np.bincount(x, minlength=size)
    uniform = tail(float((counts**2).sum() * size / n - n), size - 1)
    above = x >= size // 2
    a = int(above.sum())
    b = n - a
    if not a or not b:
        return 0.0
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 2 * a * b / n + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    even = math.erfc(abs(runs - mean) / spread / math.sqrt(2))
    if x.std() == 0:
        return 0.0
    r = float(np.corrcoef(x[:-1], x[1:])[0, 1]) if x[:-1].std() and x[1:].std() else 1.0
    serial = math.erfc(abs(r) * math.sqrt(n - 1) / math.sqrt(2))
    return 1 - (1 - min(uniform, even, serial)) ** 3


def parts(run: str) -> list[tuple[int, int]]:
    """``(start, end)`` of what is tested in a run that no alphabet explains.

    Its parts between "/", "_" and "-" that are long enough; what lies between them is cut
    at "_" and "-" only, so that a key with a "/" inside stays whole.
    """
    long = [m.span() for m in PART.finditer(run) if len(m.group().rstrip("=")) >= TOKEN_LENGTH]
    out, at = list(long), 0
    for start, end in [*long, (len(run), len(run))]:
        out += [(at + m.start(), at + m.end()) for m in URL_SAFE.finditer(run[at:start])]
        at = end
    return sorted(out)


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, float]]:
    """Tokens outside the base spans: start, end, encoding, length class, p-value."""
    found = []
    if not has_token(text):
        return found
    taken = sorted(base)
    free = lambda start, end: not any(s < end and start < e for s, e, _ in taken)
    for m in TOKEN.finditer(text):
        spans = [m.span()]
        if not free(*m.span()) or not encoding(m.group()):
            spans = [(m.start() + a, m.start() + b) for a, b in parts(m.group())]
        for start, end in spans:
            read = encoding(text[start:end]) if free(start, end) else None
            if read:
                size = len(dict(SETS)[read[0]])
                n = len(read[1])
                found.append((start, end, read[0], n.bit_length() * 2 + (n >> (n.bit_length() - 2) & 1), p_value(read[1], size)))
    return found


CANDIDATES = (
    "base array<struct<start:int,end:int,kind:int>>,"
    " tokens array<struct<start:int,end:int,encoding:string,length:int,p:double>>"
)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``found``: base spans and tested tokens of each text."""

    @F.pandas_udf(CANDIDATES)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            base = [base_spans(t or "") for t in batch]
            more = [tokens(t or "", b) for t, b in zip(batch, base)]
            yield pd.DataFrame(
                {
                    "base": [[dict(zip(("start", "end", "kind"), s)) for s in b] for b in base],
                    "tokens": [
                        [dict(zip(("start", "end", "encoding", "length", "p"), s)) for s in m]
                        for m in more
                    ],
                }
            )

    return docs.withColumn("found", scanned(F.col(text_col)))


def thresholds(found: DataFrame, rate: float = RATE) -> dict[tuple[str, int], float]:
    """The least p-value of a secret, by encoding and length class.

    The driver gets a histogram of fixed size: encodings x length classes x bins.
    """
    seen = (
        found.select(F.explode("found.tokens").alias("k"))
        .groupBy(
            F.col("k.encoding").alias("encoding"),
            F.col("k.length").alias("length"),
            F.least(F.floor(F.col("k.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"),
        )
        .count()
        .collect()
    )
    bins: dict[tuple[str, int], np.ndarray] = {}
    for r in seen:
        bins.setdefault((r["encoding"], r["length"]), np.zeros(BINS))[r["bin"]] += r["count"]
    out = {}
    for key, counts in bins.items():
        random = counts[SURE:].sum() / (1 - SURE / BINS)
        out[key] = NEVER
        for low in range(SURE + 1):
            kept = counts[low:].sum()
            if kept and (kept - random * (1 - low / BINS)) / kept <= rate:
                out[key] = max(low / BINS, 0.001)
                break
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` per row: an array of ``start, end, kind``, in code points, by start.

    ``kind`` is assign, access, hex or random. Defined results: a null or empty text has an
    empty array; ids may be null or repeat, each row has its result; an empty table gives an
    empty result; other columns are ignored.
    """
    found = cut(candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "found"))
    least = thresholds(found)
    limit = F.lit(NEVER)
    names = F.create_map(
        *[F.lit(x) for k, v in sorted(least.items()) if v < NEVER for x in (f"{k[0]}:{k[1]}", v)]
    ) if any(v < NEVER for v in least.values()) else None
    at = lambda k: limit if names is None else F.coalesce(
        names[F.concat_ws(":", k["encoding"], k["length"].cast("string"))], limit
    )
    random = F.transform(
        F.filter("found.tokens", lambda k: k["p"] >= at(k)),
        lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), F.lit(3).alias("kind")),
    )
    base = F.transform(
        "found.base",
        lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), k["kind"].alias("kind")),
    )
    by_start = F.array_sort(
        F.transform(
            F.concat(base, random),
            lambda k: F.struct(k["start"].alias("start"), k["kind"].alias("kind"), k["end"].alias("end")),
        )
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return found.select(
        "id",
        F.transform(
            by_start,
            lambda k: F.struct(
                k["start"].alias("start"), k["end"].alias("end"), kinds[k["kind"]].alias("kind")
            ),
        ).alias("spans"),
    )


def span_list(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
