"""Archives written and read back, hostile payloads, segments and foreign files."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spoor.llm import warc

SCHEMA = "page_id long, url string, html string, type string, data string, record_id string, n int, key string, keeper long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, "x", 1) for r in rows], SCHEMA)


def expected(rows):
    """One row a page, by brute force."""
    keepers = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 1000 and i is not None:
            keepers[html] = max(keepers.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keep = keepers.get(html)
        again = keep is not None and i != keep
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=repr)


def got(spark, path, **options):
    rows = warc.payloads(warc.read(spark, path, **options)).collect()
    number = lambda x: None if x is None else int(x)
    return sorted(
        ((number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["type"], number(r["refers_to"])) for r in rows),
        key=repr,
    )


def hostile():
    rng = random.Random(3)
    big = "<p>ein langer Absatz é中🙂</p>\r\n\r\n" * 60
    found = [
        None, "", "\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "\r\r\n\r\n\n", "a\r\n\r", "\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n", "x\r",
        "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", big, big, big, "y" * 999, "y" * 999, "z" * 1000, "z" * 1000,
        "\0" * 5000, "é" * 40_000,
    ]
    found += ["".join(rng.choice(["\r", "\n", "\r\n", "a", "WARC/1.0"]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    rows = [(k, f"https://example.org/{k}\r\nX-Page-ID: 0" if k % 3 else None, t) for k, t in enumerate(found)]
    return [*rows, (None, "u", big), (None, "u", big), (2, "again", "\r\n"), (2, "again", "\r\n"), (90_000, "u", "w" * 2000), (90_000, "u", "w" * 2000)]


@pytest.mark.parametrize("size, chunk", [(warc.SEGMENT, warc.CHUNK), (300, 64), (97, 1000)])
def test_round_trip(spark, tmp_path, size, chunk):
    rows = hostile()
    path = warc.write(pages_of(spark, rows).repartition(3), str(tmp_path / "a"), size=size)
    assert got(spark, path, chunk=chunk) == expected(rows)
    chunks = warc.read(spark, path, chunk=chunk)
    assert chunks.where("last and not complete").count() == 0
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= chunk
    # the chunks of a record, in order, are its payload, with a digest of each beginning
    texts = {}
    for r in sorted(chunks.where("type = 'response'").collect(), key=lambda r: r["chunk_no"]):
        done = texts.setdefault(r["record_id"], {})
        done.setdefault(r["chunk_no"], bytes(r["data"]))
        whole = b"".join(done[k] for k in range(r["chunk_no"] + 1))
        assert (len(whole), hashlib.sha1(whole).hexdigest()) == (r["bytes"], r["digest"])
    assert {b"".join(x.values()) for x in texts.values()} == {(r[2] or "").encode() for r in rows}


def test_file_is_a_plain_archive(spark, tmp_path):
    """A reader of another make: heads, lengths and blank lines as the format has them."""
    path = warc.write(pages_of(spark, hostile()).coalesce(1), str(tmp_path / "a"), size=500)
    files = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part") and p.name.endswith(".gz")]
    data, n, continued = gzip.decompress(files[0].read_bytes()), 0, 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and len(lines) == len(fields) + 1 and fields["WARC-Date"]
        length = int(fields["Content-Length"])
        assert length <= 500 and rest[length : length + 4] == b"\r\n\r\n"
        data, n, continued = rest[length + 4 :], n + 1, continued + (fields["WARC-Type"] == "continuation")
    assert continued > 100 and n - continued == len(hostile())


def archive(tmp_path, data):
    (tmp_path / "f.gz").write_bytes(gzip.compress(data))
    return str(tmp_path / "f.gz")


def record(kind, block, length=None, more=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:a>\r\n{more}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_and_broken_archives(spark, tmp_path):
    # a record that is no HTTP message, a truncated one behind it
    path = archive(tmp_path, record("resource", b"abc\r\n\r\ndef") + record("resource", b"cut", 900))
    rows = warc.read(spark, path).orderBy("bytes").collect()
    assert [(bytes(r["data"])[:3], r["bytes"], r["complete"]) for r in rows] == [(b"cut", 3, False), (b"abc", 10, True)]
    # a segment whose first one is missing, and one whose last one is
    path = archive(
        tmp_path,
        record("continuation", b"tail", more="WARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <urn:b>\r\nWARC-Segment-Total-Length: 9\r\n")
        + record("resource", b"head", more="WARC-Segment-Number: 1\r\n")
        + record("resource", b"last"),
    )
    rows = {bytes(r["data"]): (r["record_id"], r["complete"]) for r in warc.read(spark, path).collect()}
    assert rows == {b"tail": ("<urn:b>", False), b"head": ("<urn:a>", False), b"last": ("<urn:a>", True)}


def test_empty_table(spark, tmp_path):
    path = warc.write(pages_of(spark, []), str(tmp_path / "a"))
    assert got(spark, path) == []
