import hashlib
import zlib

from xsdframe.llm import media_mkv as m


def block(kind, body, track=1, moved=0):
    return m.element(m.SIMPLE_BLOCK, bytes([0x80 | track]) + moved.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + body)


def test_all_lacings_and_unknown_sizes():
    xiph = block(1, bytes([2, 255, 45, 5]) + b"a" * 300 + b"b" * 5 + b"c" * 7)
    fixed = block(2, bytes([1]) + b"d" * 8)
    ebml = block(3, bytes([2]) + (0x4000 | 500).to_bytes(2, "big") + (0x4000 | (100 - 500 + 8191)).to_bytes(2, "big") + b"e" * 500 + b"f" * 100 + b"g" * 9, moved=-3)
    plain = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x82\x00\x01\x00" + b"h" * 4))
    unknown = lambda id, body: id.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    data = m._HEAD + unknown(m.SEGMENT, m._TRACKS + unknown(m.CLUSTER, m.number(m.TIMESTAMP, 10) + xiph + fixed) + unknown(m.CLUSTER, m.number(m.TIMESTAMP, 40) + ebml + plain))
    media = m.parse(data)
    assert media.error == "" and media.tracks[1].codec == "A_PCM/INT/LIT" and media.tracks[1].rate == 8000
    got = [(t, ns // 1_000_000, data[a:b].decode()) for t, ns, a, b, _, _ in media.packets]
    assert got == [
        (1, 10, "a" * 300), (1, 34, "b" * 5), (1, 58, "c" * 7), (1, 10, "d" * 4), (1, 34, "d" * 4),
        (1, 37, "e" * 500), (1, 61, "f" * 100), (1, 85, "g" * 9), (2, 41, "h" * 4),
    ]
    assert len({p[4] for p in media.packets}) == 2


def test_key_frames_and_encodings():
    """Blocks that refer to others are no key frames; stripped headers and zlib are undone."""
    group = lambda *more: m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81\x00\x01\x00hh") + b"".join(more))
    cluster = m.element(m.CLUSTER, m.number(m.TIMESTAMP, 0) + group() + group(m.element(m.REFERENCE_BLOCK, b"\xff")) + group() + block(0, b"s"))
    media = m.parse(m._HEAD + m.element(m.SEGMENT, m._TRACKS + cluster))
    assert [p[5] for p in media.packets] == [True, False, True, True]

    def with_encodings(*encodings):
        entry = m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1) + m.element(m.ENCODINGS, b"".join(m.element(m.ENCODING, e) for e in encodings)))
        return lambda *frames: m._HEAD + m.element(m.SEGMENT, m.element(m.TRACKS, entry) + m.element(m.CLUSTER, m.number(m.TIMESTAMP, 0) + b"".join(block(0, f) for f in frames)))

    strip = m.element(m.COMPRESSION, m.number(m.ALGORITHM, m.STRIPPED) + m.element(m.SETTINGS, b"\x01\x02"))
    pack = m.number(m.SCOPE, 1) + m.element(m.COMPRESSION, m.number(m.ALGORITHM, m.ZLIB))
    data = with_encodings(strip)(b"abc", b"", b"d")
    assert m.samples(data, m.parse(data)) == b"\x01\x02abc\x01\x02\x01\x02d"
    data = with_encodings(strip, pack)(zlib.compress(b"abc"), zlib.compress(b"d"))
    assert m.samples(data, m.parse(data)) == b"\x01\x02abc\x01\x02d"
    data = with_encodings(m.number(m.ENCODING_TYPE, 1))(b"x")
    with __import__("pytest").raises(ValueError, match="encrypted"):
        m.samples(data, m.parse(data))


def test_cue_and_track_tables(spark):
    stored = m.store(spark.createDataFrame([(1, "z" * 192 * 150), (2, None)], "doc_id long, text string"))
    cue = {(r.doc_id, r.cluster): r.time_ns for r in m.cues(stored).collect()}
    first = {}
    for r in m.packets(stored).collect():
        first[r.doc_id, r.cluster] = min(first.get((r.doc_id, r.cluster), 1 << 62), r.timestamp_ns)
    assert cue == first and len(cue) == 4  # 150 frames are three clusters
    assert {(r.doc_id, r.track, r.codec, r.rate, r.stripped, r.compressed) for r in m.tracks(stored).collect()} == {(k, 1, "A_PCM/INT/LIT", 8000.0, b"", False) for k in (1, 2)}
    assert m.cues(stored.limit(0)).count() == 0 == m.tracks(stored.limit(0)).count()


def test_damage_gives_an_error_never_a_crash():
    data = m.mux(m.padded(b"some text " * 500))
    whole = len(m.parse(data).packets)
    for cut in range(0, len(data), 37):
        got = m.parse(data[:cut])
        assert len(got.packets) <= whole and (got.error or cut < 60 or not got.packets or len(got.packets) < whole)
    for at in range(0, len(data), 101):
        m.parse(data[:at] + b"\x00\xff\x00" + data[at + 3 :])


def test_round_trip(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "é" * 96, 0), (4, "x" * 192, 0), (5, "y" * 200_001, 0), (5, "y" * 200_001, 0), (None, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Media long").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "1L AS Media")
    )
    stored = m.store(docs)
    want = {}
    for r in docs.collect():
        raw = (r.text or "").encode()
        pay = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        want.setdefault(r.doc_id, []).append((len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    got = {}
    for r in m.digest(stored).collect():
        assert r.error is None
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
    assert got == want
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    table = m.packets(stored).where("doc_id = 3").orderBy("timestamp_ns").collect()
    assert b"".join(files[3][r.begin : r.end] for r in table) == ("é" * 96).encode()
    assert m.packets(stored).where("doc_id = 5").count() == 2 * -(-200_001 // 192)
    assert m.digest(m.store(docs.limit(0))).count() == 0
