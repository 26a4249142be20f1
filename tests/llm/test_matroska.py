"""Matroska: exact round trips, all lacings, cues that point at clusters, broken files."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import matroska as m


def payload_of(data):
    return b"".join(data[p[2] : p[2] + p[3]] for p in m.parse(data).packets)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 99))
def test_round_trip(units, seed):
    raw = random.Random(seed).randbytes(64 * max(1, units))
    data = m.mux_pcm(raw, 5)
    found = m.parse(data)
    assert payload_of(data) == raw
    assert found.doc_type == "matroska" and found.tracks[0]["bits"] == 8
    assert [p[1] for p in found.packets] == [i * m.FRAME * 1_000_000_000 // m.RATE for i in range(len(found.packets))]
    assert [c[2] for c in found.cues] == found.clusters
    assert found.discard_ns * m.RATE == 5 * 1_000_000_000


@given(st.lists(st.integers(0, 40_000), min_size=2, max_size=20), st.sampled_from([m.XIPH, m.EBML_LACE]))
@settings(max_examples=60, deadline=None)
def test_lacing_sizes(sizes, how):
    frames = [bytes([i]) * s for i, s in enumerate(sizes)]
    body = m.lace(frames, how)
    assert [body[a : a + s] for a, s in m._frames(body, 0, len(body), how)] == frames


def test_unknown_sizes_two_tracks_and_void():
    cluster = (m.CLUSTER).to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    body = m.uint(m.TIMESTAMP, 100) + m.element(0xEC, b"void") + m.element(m.SIMPLE_BLOCK, m.block(2, -3, [b"ab"], m.NONE, key=False))
    data = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + (m.SEGMENT).to_bytes(4, "big") + b"\xff" + (cluster + body) * 2 + m.element(m.CUES, b"")
    found = m.parse(data)
    assert [(p[0], p[1], p[4], p[6]) for p in found.packets] == [(2, 97_000_000, 0, False), (2, 97_000_000, 1, False)]
    assert payload_of(data) == b"abab"


def test_broken_files_keep_whole_packets():
    data = m.mux_pcm(bytes(range(256)) * 400)
    whole = m.parse(data).packets
    for cut in range(0, len(data), 1777):
        assert m.parse(data[:cut]).packets == [p for p in whole if p[2] + p[3] <= cut][: len(m.parse(data[:cut]).packets)]
    assert m.parse(None).packets == m.parse(b"").packets == m.parse(b"not media at all").packets == m.parse(b"\0" * 50).packets == []


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "short ä€"), (3, "short ä€"), (4, "x" * 64), (5, "word " * 60_000), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, media string")
    files = m.store_texts(docs)
    got = sorted(m.digests(files).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] or 0, len(x[1] or ""))), strict=True):
        pay, n = m.padded(t)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, n, len(pay))
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest() and r.tail_crc32 == zlib.crc32(pay[-64:])
        assert r.media_bytes == len(m.mux_pcm(pay, len(pay) - n)) and r.n_clusters == r.n_cues
    per = {(r.doc_id): r.n_packets for r in got}
    assert {k: v for k, v in per.items() if k == 5} == {5: m.packets(files).where("doc_id = 5").count()}
    assert m.digests(m.store_texts(docs.limit(0))).count() == 0


def plain_frames(data):
    """Another reader: walks the element tree with the specification's numbers and yields each frame's bytes."""

    def size_at(at):
        width = next(w for w in range(1, 9) if data[at] >> (8 - w))
        return int.from_bytes(data[at : at + width], "big") - (1 << 7 * width), at + width

    def walk(at, end):
        while at < end:
            width = next(w for w in range(1, 5) if data[at] >> (8 - w))
            ident = data[at : at + width].hex()
            size, at = size_at(at + width)
            if ident in ("18538067", "1f43b675", "a0"):
                yield from walk(at, at + size)
            elif ident in ("a3", "a1"):
                yield from block(at, at + size)
            at += size

    def block(at, end):
        flags, at = data[at + 3], at + 4
        lacing = flags >> 1 & 3
        if lacing == 0:
            yield data[at:end]
            return
        count, at = data[at] + 1, at + 1
        if lacing == 2:
            sizes = [(end - at) // count] * count
        else:
            assert lacing == 3
            sizes = []
            for i in range(count - 1):
                width = next(w for w in range(1, 9) if data[at] >> (8 - w))
                value, at = size_at(at)
                sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
            sizes.append(end - at - sum(sizes))
        for s in sizes:
            yield data[at : at + s]
            at += s

    return list(walk(0, len(data)))


def test_whole_result_equals_a_plain_version(spark):
    rnd = random.Random(6)
    texts = [None, "", "a", "ä€" * 40, *("".join(rnd.choice("ab \n\u00e9\u4e2d") for _ in range(rnd.choice([64, 1000, 1024, 9000, 70_000, 200_000]))) for _ in range(25))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = {r.doc_id: bytes(r.media) for r in m.store_texts(docs).collect()}
    got = {r.doc_id: r for r in m.digests(m.store_texts(docs)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        frames = plain_frames(files[i])
        assert b"".join(frames) == pay and got[i].n_packets == len(frames)
        middle = [b - 128 for b in pay]
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(pay, pay[1:], strict=False))
        feature = f"{len(pay) // 8}ms mean={sum(middle) * 1000 // len(pay)} rms={int((sum(x * x for x in middle) * 1_000_000 // len(pay)) ** 0.5)} crossings={crossings}"
        want = (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(files[i]), hashlib.sha256(files[i]).hexdigest(), feature)
        assert tuple(got[i])[1:8] == want
