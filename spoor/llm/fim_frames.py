"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of bounded size, each with the units and
code points that end at or before its last byte. A cut at a unit is found in these counts, and
only the frame that holds it is decompressed for the place of the cut; everything else streams
frame by frame into digests and into the frames of the output. No step holds a decompressed
text besides the row that brings it.

A unit is a word with the white space before it; white space at the end of a text is a unit of
its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 1 << 16  # bytes of a frame before compression
SEED = "42"
FIM_PERCENT, SPM_PERCENT = 50, 80
# fixed values: the marks of prefix, suffix and middle
MARKS = (b"<P>", b"<S>", b"<M>")
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def unit_ends(data: bytes, after: bytes) -> np.ndarray:
    """Offsets in ``data`` where units end; ``after`` is the byte behind it, if there is one."""
    blank = SPACE[np.frombuffer(data + (after or b" "), np.uint8)]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not after and len(data) and blank[len(data) - 1]:
        ends = np.append(ends, len(data))
    return ends


def points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def cut_frames(text: bytes, size: int, pack: zstandard.ZstdCompressor) -> dict:
    """The frames of one text: cumulative ``units`` and ``chars``, compressed ``data``."""
    out: dict[str, list] = {"units": [], "chars": [], "data": []}
    units = chars = start = 0
    while start < len(text):
        stop = min(start + size, len(text))
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        part = text[start:stop]
        units += len(unit_ends(part, text[stop : stop + 1]))
        chars += points(part)
        out["units"].append(units)
        out["chars"].append(chars)
        out["data"].append(pack.compress(part))
        start = stop
    return out


def frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME) -> DataFrame:
    """``(id, units, chars, data)`` per row of ``docs``: its text as compressed frames.

    ``units`` and ``chars`` count up to the end of each frame. Defined results: a null or empty
    text has no frames; ids may be null or repeat, each row has its own frames; an empty table
    gives an empty one; other columns are ignored. A frame is cut between code points, wherever
    units lie, so a text of any length, also one without white space, has frames of one size.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [cut_frames((t.as_py() or "").encode(), size, pack) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([r["units"] for r in rows], pa.list_(pa.int64())),
                    pa.array([r["chars"] for r in rows], pa.list_(pa.int64())),
                    pa.array([r["data"] for r in rows], pa.list_(pa.binary())),
                ],
                ["id", "units", "chars", "data"],
            )

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(cut, f"id {kind}, units array<bigint>, chars array<bigint>, data array<binary>")


Place = tuple[int, int]  # frame and byte offset in it


def place_of(unit: int, row: dict, unpack: zstandard.ZstdDecompressor) -> tuple[Place, int]:
    """Where ``unit`` units have ended, and the code points before it; one frame is read."""
    if unit <= 0:
        return (0, 0), 0
    at = bisect_left(row["units"], unit)
    data = unpack.decompress(row["data"][at])
    before = row["units"][at - 1] if at else 0
    # a unit that ends with the frame is never mistaken: it is the last one counted in it
    end = int(unit_ends(data, b"")[unit - before - 1])
    return (at, end), (row["chars"][at - 1] if at else 0) + points(data[:end])


def between(data: list[bytes], start: Place, stop: Place | None, unpack) -> Iterator[bytes]:
    """The bytes from one place to another, or to the end, a frame at a time."""
    last = len(data) - 1 if stop is None else stop[0]
    for at in range(start[0], min(last, len(data) - 1) + 1):
        part = unpack.decompress(data[at])
        yield part[start[1] if at == start[0] else 0 : stop[1] if stop and at == last else None]


def marked(data: list[bytes], unpack) -> bool:
    """True when the text holds one of the marks; frames overlap by the length of a mark."""
    tail = b""
    for packed in data:
        part = tail + unpack.decompress(packed)
        if any(m in part for m in MARKS):
            return True
        tail = part[-2:]
    return False


def refold(pieces: Iterable[bytes], size: int, pack) -> Iterator[bytes]:
    """Compressed frames of ``size`` bytes over the joined ``pieces``."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) >= size:
            yield pack.compress(bytes(held[:size]))
            del held[:size]
    if held:
        yield pack.compress(bytes(held))


def arranged(row: dict, form: str, first: Place, second: Place, unpack) -> Iterator[bytes]:
    """The output text of a form, a frame at a time."""
    data = row["data"]
    if form == "plain":
        yield from between(data, (0, 0), None, unpack)
        return
    prefix = lambda: between(data, (0, 0), first, unpack)
    suffix = lambda: between(data, second, None, unpack)
    order = ((MARKS[0], prefix), (MARKS[1], suffix)) if form == "psm" else ((MARKS[1], suffix), (MARKS[0], prefix))
    for mark, part in order:
        yield mark
        yield from part()
    yield MARKS[2]
    yield from between(data, first, second, unpack)


def transform(
    store: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: str = SEED,
    size: int = FRAME,
) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output, output_sha256)`` per row of ``frames()``.

    ``n`` counts units. Cuts and form follow from the SHA-256 of ``seed:id``. ``output`` holds
    the transformed text as compressed frames; ``texts()`` reads them. Defined results: a text
    that is empty or holds a mark stays plain; a null id hashes as empty; plain rows have null
    character counts.
    """
    kind = store.schema["id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]
    n = F.coalesce(F.try_element_at("units", F.lit(-1)), F.lit(0).cast("bigint"))
    planned = store.select(
        "id", "units", "chars", "data", n.alias("n"),
        F.least(drawn[0] % (n + 1), drawn[1] % (n + 1)).alias("first"),
        F.greatest(drawn[0] % (n + 1), drawn[1] % (n + 1)).alias("second"),
        F.when((n == 0) | (drawn[2] % 100 >= fim_percent), "plain")
        .when(drawn[3] % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
    )
    schema = pa.schema(
        [
            ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
            ("output", pa.list_(pa.binary())), ("output_sha256", pa.string()),
        ]
    )

    def one(row: dict, pack, unpack) -> dict:
        form, first, second, counts = row["form"], (0, 0), (0, 0), (None, None)
        if form != "plain" and marked(row["data"], unpack):
            form = "plain"
        if form != "plain":
            first, before = place_of(row["first"], row, unpack)
            second, until = place_of(row["second"], row, unpack)
            counts = before, until - before
        digest = hashlib.sha256()

        def read() -> Iterator[bytes]:
            for piece in arranged(row, form, first, second, unpack):
                digest.update(piece)
                yield piece

        output = list(refold(read(), size, pack))
        return {
            "n": row["n"], "form": form, "prefix_chars": counts[0], "middle_chars": counts[1],
            "output": output, "output_sha256": digest.hexdigest(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = [one(r, pack, unpack) for r in batch.to_pylist()]
            made = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made.columns], ["id", *made.schema.names])

    return planned.mapInArrow(
        run,
        f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint,"
        " output array<binary>, output_sha256 string",
    )


def split_marks(pieces: Iterable[bytes]) -> Iterator[tuple[bytes | None, bytes]]:
    """``(mark, bytes)`` of a stream: each part under the mark before it, pieces as they come."""
    mark, held = None, b""
    for piece in pieces:
        held += piece
        while True:
            found = min(((held.find(m), m) for m in MARKS if m in held), default=None)
            if found is None:
                break
            yield mark, held[: found[0]]
            mark, held = found[1], held[found[0] + 3 :]
        if len(held) > 2:  # a mark may begin in the last two bytes
            yield mark, held[:-2]
            held = held[-2:]
    yield mark, held


def rebuilt(output: list[bytes], form: str, size: int, pack, unpack) -> Iterator[bytes]:
    """The original text of an output, a frame at a time.

    The parts of an output stand in another order than in the text, so each is packed into
    frames of its own while the output streams by.
    """
    stream = (unpack.decompress(x) for x in output)
    if form == "plain":
        yield from stream
        return
    parts: dict[bytes, list[bytes]] = {m: [] for m in MARKS}
    held = {m: bytearray() for m in MARKS}
    for mark, piece in split_marks(stream):
        if mark is None:
            continue
        held[mark] += piece
        if len(held[mark]) >= size:
            parts[mark].append(pack.compress(bytes(held[mark])))
            held[mark].clear()
    for mark in (MARKS[0], MARKS[2], MARKS[1]):
        for packed in parts[mark]:
            yield unpack.decompress(packed)
        yield bytes(held[mark])


def restore(transformed: DataFrame, size: int = FRAME) -> DataFrame:
    """``transformed`` with ``restored``, frames of the original text, and ``restored_sha256``.

    Both come from ``output`` and ``form`` alone. Every other column is kept, except ``output``.
    """
    rest = [c for c in transformed.columns if c not in ("output", "restored", "restored_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            texts, digests = [], []
            for output, form in zip(batch.column("output"), batch.column("form")):
                digest, read = hashlib.sha256(), []

                def pieces(digest=digest, output=output.as_py() or [], form=form.as_py()):
                    for piece in rebuilt(output, form, size, pack, unpack):
                        digest.update(piece)
                        yield piece

                texts.append(list(refold(pieces(), size, pack)))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(texts, pa.list_(pa.binary())), pa.array(digests, pa.string())],
                [*rest, "restored", "restored_sha256"],
            )

    types = ", ".join(f"`{c}` {transformed.schema[c].dataType.simpleString()}" for c in rest)
    return transformed.mapInArrow(run, f"{types}, restored array<binary>, restored_sha256 string")


def texts(df: DataFrame, frames_col: str, name: str = "text") -> DataFrame:
    """``df`` with the whole text that the frames of a column hold; null frames give null."""

    @F.pandas_udf("string")
    def joined(rows):
        unpack = zstandard.ZstdDecompressor()
        return rows.map(lambda r: None if r is None else b"".join(unpack.decompress(x) for x in r).decode())

    return df.withColumn(name, joined(F.col(frames_col)))


# the same rows in SQL, texts rebuilt by cutting the output at its marks
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k
  FROM documents),
c AS (
  SELECT doc_id, t, k, len(k)::BIGINT AS n,
    ('0x' || h[1:8])::UBIGINT % (len(k) + 1)::UBIGINT AS a, ('0x' || h[9:16])::UBIGINT % (len(k) + 1)::UBIGINT AS b,
    ('0x' || h[17:24])::UBIGINT % 100 AS f, ('0x' || h[25:32])::UBIGINT % 100 AS o FROM d),
p AS (
  SELECT doc_id, t, n, array_to_string(k[1:least(a, b)::BIGINT], '') AS pre,
    array_to_string(k[least(a, b)::BIGINT + 1:greatest(a, b)::BIGINT], '') AS mid,
    array_to_string(k[greatest(a, b)::BIGINT + 1:], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR f >= 50 THEN 'plain'
      WHEN o < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
x AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(split_part(output, '<P>', 2), '<S>', 1) || split_part(output, '<M>', 2)
      || split_part(split_part(output, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2)
      || split_part(split_part(output, '<S>', 2), '<P>', 1) END) AS restored_sha256
FROM x
"""
