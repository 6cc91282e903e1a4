import hashlib
import re

import pytest

from xsdframe.llm import warc
from xsdframe.llm.common import fresh_path
from xsdframe.llm.queries import ORACLE_SQL


def raw(n, body=b"payload " * 20):
    return warc.record(n, f"http://x/{n} a", body, hashlib.sha256(body).hexdigest(), None, False, "2020-01-01T00:00:00Z")


@pytest.mark.parametrize("gz", [False, True])
def test_salvage_skips_damage_only(gz):
    parts = [warc.member(raw(k)) if gz else raw(k) for k in range(6)]
    whole = b"".join(parts)
    ok = list(warc.salvage(whole))
    assert [warc.page_of(f.headers["warc-record-id"]) for f in ok] == list(range(6)) and not any(f.reason for f in ok)
    assert ok[2].payload_length() == 160 and ok[2].payload() == b"payload " * 20
    bad = bytearray(whole)
    at = len(parts[0]) + len(parts[1])
    bad[at + 20 : at + 60] = b"\x00" * 40
    found = list(warc.salvage(bytes(bad)))
    good = [warc.page_of(f.headers["warc-record-id"]) for f in found if not f.reason]
    assert good == [0, 1, 3, 4, 5]
    (gap,) = [f for f in found if f.reason]
    assert (gap.begin, gap.end) == (at, at + len(parts[2]))
    cut = list(warc.salvage(whole[: -len(parts[5]) // 2]))
    assert len([f for f in cut if not f.reason]) == 5 and cut[-1].reason
    odd = b"\x1f\x8b\x08 junk WARC/1.0 junk"
    junk = list(warc.salvage(odd + whole + b"tail"))
    assert len([f for f in junk if not f.reason]) == 6 and [f.end - f.begin for f in junk if f.reason] == [len(odd), 4]
    assert list(warc.salvage(b"")) == []


def pages_of(found):
    return [warc.page_of(f.headers["warc-record-id"]) for f in found if not f.reason]


def test_records_longer_than_one_step_are_read(monkeypatch):
    whole = b"".join(warc.member(raw(k, bytes([65 + k]) * 5000)) for k in range(3))
    monkeypatch.setattr(warc, "STEP", 1000)
    found = list(warc.salvage(whole))
    assert [(len(f.payload()), f.reason) for f in found] == [(5000, "")] * 3
    assert [f.reason for f in warc.salvage(whole[:-9])][2:] == ["", "gzip member does not end"]  # its digest is right
    bare = warc.member(b"".join(re.sub(rb"WARC-Payload-Digest: \S+\r\n", b"", raw(k)) for k in range(3)))
    assert [f.reason for f in warc.salvage(bare)] == [""] * 3
    assert [f.reason for f in warc.salvage(bare[:-5])] == ["member's check failed, no digest"] * 3 + ["gzip member does not end"]


@pytest.mark.parametrize("step", [1 << 20, 64])
def test_damage_inside_one_member(monkeypatch, step):
    """Archives of a single gzip member: only the damaged record is lost."""
    monkeypatch.setattr(warc, "STEP", step)
    parts = [raw(k, b"payload %d " % k * 40) for k in range(6)]
    for damage in (lambda r: r.replace(b"WARC-Type", b"WARC\x00Type"), lambda r: r[:-4] + b"xxxx", lambda r: b"\x00" * 30 + r[30:], lambda r: r[40:], lambda r: r.replace(b"Content-Length: 4", b"Content-Length: 9")):
        bad = b"".join([*parts[:2], damage(parts[2]), *parts[3:]])
        found = list(warc.salvage(warc.member(bad)))
        assert pages_of(found) == [0, 1, 3, 4, 5]
        (gap,) = [f for f in found if f.reason]
        assert (gap.inner_begin, gap.inner_end) == (len(parts[0] + parts[1]), len(bad) - sum(map(len, parts[3:])))
        assert pages_of(warc.salvage(bad)) == [0, 1, 3, 4, 5]
        two = b"".join([parts[0], damage(parts[1]), parts[2], damage(parts[3]), parts[4], parts[5]])
        assert pages_of(warc.salvage(warc.member(two))) == [0, 2, 4, 5] == pages_of(warc.salvage(two))


def test_member_that_breaks_off_gives_what_stood_before():
    import os

    parts = [raw(k, os.urandom(300)) for k in range(50)]
    one = warc.member(b"".join(parts))
    found = list(warc.salvage(one[:-30]))
    assert pages_of(found) in (list(range(49)), list(range(50))) and found[-1].reason and found[-1].end == len(one) - 30
    bad = bytearray(one + warc.member(raw(77)))
    bad[len(one) // 2 : len(one) // 2 + 40] = b"\xff" * 40
    found = list(warc.salvage(bytes(bad)))
    good = pages_of(found)
    assert good[-1] == 77 and good[:-1] == list(range(len(good) - 1)) and len(good) > 20
    (gap,) = [f for f in found if f.reason]
    assert gap.begin <= len(one) // 2 and gap.end == len(one)


def test_record_inside_a_damaged_payload_is_not_the_archives_own():
    inner = raw(77)
    for inside in (inner, b"before " + inner + b" after", b"\r\n\r\n" + inner + b"x"):
        outer = raw(1, inside)
        for bad in (outer.replace(b"WARC/1.1", b"WARC/x.1", 1), outer.replace(b"Content-Length: ", b"Content-Xength: ", 1)):
            for data in (raw(0) + bad + raw(2), warc.member(raw(0) + bad + raw(2))):
                assert pages_of(warc.salvage(data)) == [0, 2]


def test_digests_of_other_writers():
    import base64

    body = b"text of a page"
    sha1 = hashlib.sha1(body).digest()
    for told, good in ((b"sha1:" + base64.b32encode(sha1), True), (b"sha1:" + sha1.hex().encode(), True), (b"sha1:" + b"A" * 32, False), (b"md5:" + b"0" * 32, False), (b"blake9:00", True)):
        one = raw(3, body).replace(b"sha256:" + hashlib.sha256(body).hexdigest().encode(), told)
        assert [bool(f.reason) for f in warc.salvage(one)] == [not good]


def test_changed_payload_is_quarantined_but_the_next_record_is_read():
    a, b = raw(1), raw(2)
    found = list(warc.salvage(a.replace(b"payload payload", b"payLoad payload", 1) + b))
    assert [f.reason for f in found] == ["payload digest differs", ""]


def plain(rows):
    out, first = [], {}
    for i, _, h in rows:
        h = (h or "").encode()
        if i is not None and len(h) >= 100:
            first[h] = min(first.get(h, i), i)
    for i, _, h in rows:
        h = (h or "").encode()
        ref = first.get(h)
        ref = None if ref == i else ref
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def test_round_trip(spark):
    big = "<p>é</p>" * 40
    rows = [(k, "http://a/\r\nb c", big) for k in (9, 4, 7)] + [
        (1, None, None), (2, "u", ""), (3, "u", "short"), (5, "u", "short"), (6, "u", "y" * 99), (8, "u", "y" * 99),
        (10, "u", "z" * 100), (11, "u", "z" * 100), (11, "u", "z" * 100), (10, "u", "z" * 100), (None, "u", "z" * 100),
        (12, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (13, "u", "q" * 3_000_000), (None, "u", "w" * 200),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, HTML int")
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == plain(rows)
    assert warc.round_trip(df.limit(0)).count() == 0
    path = fresh_path(spark, "warc-test")
    manifest = warc.write(df, path, archive_bytes=500)
    full = warc.read_written(manifest, path, payloads=True).where("warc_type = 'response' AND page_id = 4")
    assert [bytes(r.payload).decode() for r in full.collect()] == [big]
    assert warc.read(spark, f"{path}/data").count() == len(rows) == warc.read(spark, [f"{path}/{r.file}" for r in manifest.collect()]).count()


def test_quarantine_is_logged(spark):
    """The reader logs what it could not read beside the archives."""
    import json
    import os

    path = fresh_path(spark, "warc-test")
    manifest = warc.write(spark.createDataFrame([(k, "u", "h" * 300) for k in range(9)], "page_id long, url string, html string").coalesce(1), path)
    assert warc.read_written(manifest, path).count() == 9 and not os.path.exists(f"{path}/quarantine")
    (name,) = [r.file for r in manifest.collect()]
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(200)
        f.write(b"\x00" * 50)
    found = warc.read_written(manifest, path)
    assert found.where("reason IS NULL").count() in (7, 8) and found.where("reason IS NOT NULL AND end > begin").count() == 1
    (log,) = os.listdir(f"{path}/quarantine")
    (line,) = open(f"{path}/quarantine/{log}").readlines()
    said = json.loads(line)
    assert said["file"] == name and said["begin"] < 250 <= said["end"] and said["reason"]


def test_same_as_sql(spark):
    import duckdb

    got = sorted(map(tuple, warc.round_trip(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()))
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL["op7_warc_salvage"]).fetchall())
