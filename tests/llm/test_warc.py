"""op6: digests and roles by hashlib, archives read back, payloads of several chunks."""

import base64
import hashlib
import uuid
from collections import defaultdict
from pathlib import Path

import pytest

from lodestone.llm import queries, warc
from lodestone.llm.common import scratch_path
from tests.conftest import DATA
from tests.oracle import assert_same

KIND = "page_id long, url string, html string, digest string, data int"


def plain(rows, least):
    groups = defaultdict(list)
    for i, _, html, *_ in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        known = [x for x in groups[data] if x is not None]
        top = max(known, default=None)
        again = len(data) >= least and top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/", "<p>x</p>", "", 1), (2, "http://b/\r\nX: y", "<p>x</p>", "", 1), (3, None, None, "", 1), (4, "u", "", "", 1), (None, "n", "<p>x</p>", "", 1), (None, "n", "lonely", "", 1),
    (5, "u", "é汉😀\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "", 1), (6, "u", "line\nline\r\n", "", 1), (7, "u", "big " * 700 + "é" * 801, "", 1), (8, "u", "big " * 700 + "é" * 801, "", 1), (9, "same", "twice", "", 1), (9, "same", "twice", "", 1),
    (10, "u", "\x00\x0b ﻿", "", 1),
]


@pytest.mark.parametrize("least,chunk", [(0, 1 << 20), (0, 100), (6, 7)])
def test_round_trip(spark, least, chunk):
    got = warc.warc_round_trip(spark.createDataFrame(ROWS, KIND).repartition(3), least, chunk).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain(ROWS, least)


def test_payloads_come_back(spark):
    df = spark.createDataFrame([r for r in ROWS if r[0] is not None and r[0] not in (2, 8)], KIND)
    path, key = scratch_path(spark, "test"), uuid.uuid4().hex
    warc.write_warc(df, path, key, chunk=64)
    parts = defaultdict(dict)
    for s in warc.read_segments(spark, path, key).where("warc_type <> 'revisit'").collect():
        parts[s.page_id][s.number or 1] = bytes(s.data)
    for i, _, html, *_ in ROWS:
        if i in parts:
            assert b"".join(parts[i][n] for n in sorted(parts[i])) == (html or "").encode(), i


def test_chunk_table_covers_the_payload(spark):
    df = spark.createDataFrame([("a", b"0123456789"), ("b", b"")], "record_id string, payload binary")
    rows = warc.chunk_table(df, 4).orderBy("record_id", "chunk_no").collect()
    assert [(r.record_id, r.chunk_no, bytes(r.data)) for r in rows] == [("a", 0, b"0123"), ("a", 1, b"4567"), ("a", 2, b"89"), ("b", 0, b"")]
    done = {r.record_id: (r.payload_bytes, r.payload_digest) for r in warc.digest_chunks(warc.chunk_table(df, 4)).collect()}
    assert done["a"] == (10, base64.b32encode(hashlib.sha1(b"0123456789").digest()).decode())


def test_a_cut_record_is_an_error(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.txt").write_bytes(b"WARC/1.1\r\nWARC-Archive-Key: k\r\nWARC-Type: response\r\nContent-Length: 999\r\n\r\nshort")
    with pytest.raises(Exception, match="cut short"):
        warc.read_segments(spark, f"file://{tmp_path}/w", "k").collect()


def test_empty_table_and_whole_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], KIND)).count() == 0
    assert_same(spark, "op6", queries.op6_warc, queries.oracle_sql()["op6_warc"], DATA)


def test_archives_follow_the_format(spark):
    """A plain reader: header, block of the stated length, two line ends, next record."""
    path, key = scratch_path(spark, "test"), uuid.uuid4().hex
    warc.write_warc(spark.createDataFrame(ROWS, KIND).repartition(2), path, key, chunk=100)
    seen = 0
    for file in sorted(Path(path.removeprefix("file://")).glob("part-*")):
        raw = file.read_bytes()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert lines[0] == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n" and {"WARC-Type", "WARC-Record-ID", "WARC-Date"} <= fields.keys()
            raw = rest[n + 4 :]
            seen += fields["WARC-Type"] != "continuation"
    assert seen == len(ROWS)
