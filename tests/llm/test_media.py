"""Containers: round trips, tables of all kinds, damaged bytes."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import media
from tagloom.llm.media import _box, _full


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_payloads_come_back(data):
    payload = media.pad(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data) and not payload[len(data) :].strip(b"\0")
    stored = media.store(payload)
    assert media.read_payload(stored) == payload
    (t,) = media.tracks(stored)
    n = len(payload) // 64
    assert (t["codec"], t["n_samples"], t["n_bytes"], t["duration"]) == ("raw ", n, len(payload), len(payload) / 8000)
    keys = [payload[k * 64 : k * 64 + 64] for k in range(0, n, 16)]
    assert [stored[k["start"] : k["stop"]] for k in t["keyframes"]] == keys


def container(sizes, per_chunk, keys=None, compact=0, wide=False, version=0, shuffle=False):
    """A container with samples of ``sizes`` in chunks of ``per_chunk``, and what its tables should say."""
    rng = np.random.default_rng(0)
    samples = [rng.bytes(s) for s in sizes]
    chunks = [samples[a : a + per_chunk] for a in range(0, len(samples), per_chunk)]
    ftyp = _box(b"ftyp", b"isom", bytes(4))
    order = list(range(len(chunks)))[:: -1 if shuffle else 1]
    at, starts, body = len(ftyp) + 8, {}, b""
    for k in order:
        starts[k] = at + len(body)
        body += b"".join(chunks[k]) + b"gap"
    if compact == 16:
        stsz = _full(b"stz2", 0, 0, struct.pack(">II", 16, len(sizes)), np.array(sizes, ">u2").tobytes())
    elif compact == 8:
        stsz = _full(b"stz2", 0, 0, struct.pack(">II", 8, len(sizes)), np.array(sizes, "u1").tobytes())
    elif compact == 4:
        even = [*sizes, 0][: len(sizes) + len(sizes) % 2]
        stsz = _full(b"stz2", 0, 0, struct.pack(">II", 4, len(sizes)), bytes(a << 4 | b for a, b in zip(even[::2], even[1::2])))
    else:
        stsz = _full(b"stsz", 0, 0, struct.pack(">II", 0, len(sizes)), np.array(sizes, ">u4").tobytes())
    full, rest = divmod(len(sizes), per_chunk)
    runs = [(1, per_chunk)] * bool(full) + [(full + 1, rest)] * bool(rest)
    boxes = [
        _full(b"stsd", 0, 0, struct.pack(">I", 1), _box(b"avc1", bytes(78))),
        _full(b"stts", 0, 0, struct.pack(">III", 1, len(sizes), 20)),
        _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs]),
        stsz,
        _full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", len(chunks)), np.array([starts[k] for k in range(len(chunks))], ">u8" if wide else ">u4").tobytes()),
    ]
    if keys is not None:
        boxes.append(_full(b"stss", 0, 0, struct.pack(">I", len(keys)), np.array(keys, ">u4").tobytes()))
    mdhd = _full(b"mdhd", version, 0, struct.pack(">QQIQ" if version else ">IIII", 0, 0, 1000, 20 * len(sizes)), bytes(4))
    tkhd = _full(b"tkhd", version, 0, struct.pack(">QQIIQ" if version else ">IIIII", 0, 0, 7, 0, 0), bytes(60))
    trak = _box(b"trak", tkhd, _box(b"mdia", mdhd, _full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(13)), _box(b"minf", _box(b"stbl", *boxes))))
    return ftyp + _box(b"mdat", body) + _box(b"uuid", bytes(16), b"x") + _box(b"moov", trak), samples


@pytest.mark.parametrize("how", [{}, {"compact": 16}, {"compact": 8}, {"compact": 4}, {"wide": True}, {"version": 1}, {"shuffle": True}])
def test_tables_of_all_kinds(how):
    sizes = [5, 3, 9, 1, 0, 7, 2, 15, 4]
    raw, samples = container(sizes, 2, [1, 4, 5], **how)
    (t,) = media.tracks(raw)
    assert (t["track_id"], t["handler"], t["codec"], t["timescale"], t["duration"]) == (7, "vide", "avc1", 1000, 0.18)
    assert media.read_payload(raw) == b"".join(samples)
    got = b"".join(raw[k["start"] : k["stop"]] for k in t["keyframes"])
    assert got == samples[0] + samples[3] + samples[4]


def test_without_a_sync_table_every_sample_is_one():
    raw, samples = container([4] * 10, 10)
    (t,) = media.tracks(raw)
    assert len(t["keyframes"]) == 1 and raw[t["keyframes"][0]["start"] : t["keyframes"][0]["stop"]] == b"".join(samples)


def test_damaged_containers_raise_malformed():
    raw, _ = container([5, 3, 9], 2, [1])
    for cut in range(1, len(raw)):
        try:
            media.tracks(raw[:cut])
        except media.Malformed:
            pass
    rng = np.random.default_rng(1)
    for _ in range(500):
        b = bytearray(raw)
        b[rng.integers(0, len(b))] = rng.integers(0, 256)
        try:
            media.tracks(bytes(b))
        except media.Malformed:
            pass
    nested = b""
    for _ in range(100):
        nested = _box(b"moov", nested)
    with pytest.raises(media.Malformed):
        media.tracks(nested)


def fragmented(per_sample=True, base_is_moof=True, head=False):
    """A movie without samples of its own and two fragments of a track; the samples and which of them are sync."""
    rng = np.random.default_rng(3)
    trex = _full(b"trex", 0, 0, struct.pack(">IIIII", 7, 1, 20, 4, 0x10000 if head else 0))
    empty = [
        _full(b"stsd", 0, 0, struct.pack(">I", 1), _box(b"avc1", bytes(78))), _full(b"stts", 0, 0, bytes(4)), _full(b"stsc", 0, 0, bytes(4)),
        _full(b"stsz", 0, 0, bytes(8)), _full(b"stco", 0, 0, bytes(4)),
    ]
    mdhd = _full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 1000, 0), bytes(4))
    tkhd = _full(b"tkhd", 0, 0, struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60))
    out = _box(b"ftyp", b"isom", bytes(4)) + _box(b"moov", _box(b"trak", tkhd, _box(b"mdia", mdhd, _box(b"minf", _box(b"stbl", *empty)))), _box(b"mvex", trex))
    samples, sync = [], []
    for k in range(2):
        sizes = [5, 0, 9] if per_sample else [4, 4, 4]
        own = [rng.bytes(n) for n in sizes]
        flags = [0, 0x10000, 0]
        rows = b"".join(struct.pack(">III", 30, n, f) for n, f in zip(sizes, flags)) if per_sample else b""
        bits = 1 | (0x700 if per_sample else 0) | (4 if head else 0)

        def moof(at):
            run = _full(b"trun", 0, bits, struct.pack(">Ii", 3, at), struct.pack(">I", 0) if head else b"", rows)
            return _box(b"moof", _full(b"mfhd", 0, 0, bytes(4)), _box(b"traf", _full(b"tfhd", 0, 0x20000 if base_is_moof else 0, struct.pack(">I", 7)), run))

        out += moof(len(moof(0)) + 8) + _box(b"mdat", b"".join(own))
        samples += own
        sync += [s for s, f in zip(own, flags) if not f] if per_sample else own[:1] if head else own
    return out, samples, sync


@pytest.mark.parametrize("how", [{}, {"base_is_moof": False}, {"per_sample": False}, {"per_sample": False, "head": True}, {"head": True}])
def test_fragments(how):
    raw, samples, sync = fragmented(**how)
    (t,) = media.tracks(raw)
    assert (t["n_samples"], t["n_bytes"], t["duration"]) == (6, sum(map(len, samples)), 0.18 if how.get("per_sample", True) else 0.12)
    assert media.read_payload(raw) == b"".join(samples)
    assert b"".join(raw[k["start"] : k["stop"]] for k in t["keyframes"]) == b"".join(sync)


def damaged():
    whole = [container([5, 3, 9, 0, 2], 2, [1, 3])[0], container([5, 3, 9], 2, [1], compact=4)[0], container([7] * 5, 2, [2], wide=True, version=1)[0]]
    return [*whole, fragmented()[0], fragmented(per_sample=False, head=True)[0], media.store(media.pad(b"x" * 5000))]


@pytest.mark.parametrize("which", range(6))
def test_every_field_can_be_wrong(which):
    """Each place of a container takes extreme values in turn: it is read or Malformed, and no count allocates beyond the file."""
    import tracemalloc

    raw = damaged()[which]
    tracemalloc.start()
    for at in range(len(raw) if len(raw) < 1500 else 0) or [*range(60), *range(len(raw) - 700, len(raw))]:
        for value in (b"\0\0\0\0", b"\xff\xff\xff\xff", b"\xff\xff\xff\xf0", b"\0\0\0\1", b"\x7f\xff\xff\xff", b"\x80"):
            b = raw[:at] + value + raw[at + len(value) :]
            for read in (media.tracks, media.read_payload):
                try:
                    read(b)
                except media.Malformed:
                    pass
        for read in (media.tracks, media.read_payload):
            try:
                read(raw[:at])
            except media.Malformed:
                pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20


def test_a_count_alone_allocates_nothing():
    """Samples of one byte each: their number is a field, not a table."""
    n = 300_000
    ftyp = _box(b"ftyp", b"isom", bytes(4))
    at = len(ftyp) + 8
    boxes = [
        _full(b"stsd", 0, 0, bytes(4)), _full(b"stts", 0, 0, struct.pack(">III", 1, n, 1)), _full(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, n, 1)),
        _full(b"stsz", 0, 0, struct.pack(">II", 1, n)), _full(b"stco", 0, 0, struct.pack(">II", 1, at)),
    ]
    trak = _box(b"trak", _box(b"mdia", _full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 0, 0), bytes(4)), _box(b"minf", _box(b"stbl", *boxes))))
    raw = ftyp + _box(b"mdat", bytes(n)) + _box(b"moov", trak)
    (t,) = media.tracks(raw)
    assert (t["n_samples"], t["codec"], t["duration"], t["keyframes"]) == (n, None, None, [{"start": at, "stop": at + n}])
    assert media.read_payload(raw) == bytes(n)


def test_damaged_containers_have_a_reason(spark):
    good = media.store(media.pad(b"text"))
    df = spark.createDataFrame([(1, 4, good), (2, 4, b"no box at all, surely"), (3, 4, None), (4, 4, good[:-9])], "doc_id int, n_bytes bigint, media binary")
    out = media.media_digest(df)
    assert out.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].error is None and rows[1].feature and all(rows[k].error and rows[k].feature is None for k in (2, 3, 4))


def test_probe_media(spark):
    good, _ = container([5, 3, 9], 2, [1])
    df = spark.createDataFrame([(1, good, "a"), (2, b"nonsense that is no box", "b"), (3, None, "c"), (4, b"", "d")], "id int, media binary, error string")
    rows = {r[0]: (r[2], r[3]) for r in media.probe_media(df, keep=["id", "error"]).orderBy("id").collect()}
    assert rows[1][0][0].codec == "avc1" and rows[1][1] is None
    assert rows[2][0] is None and rows[2][1] and rows[3] == (None, None) and rows[4] == ([], None)


def test_documents(spark, sf):
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "é" * 100_000, 9), (3, "é" * 100_000, 9), (None, "x" * 64, 9)], "doc_id bigint, text string, media int")
    corpus = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (odd, corpus, odd.limit(0)):
        want = []
        for r in df.select("doc_id", "text").collect():
            raw = (r.text or "").encode()
            p = media.pad(raw)
            want.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        got = media.media_digest(media.text_media(df))
        assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(want, key=str)
        assert got.where("error is not null or feature is null or length(media_sha256) <> 64 or media_bytes <= payload_bytes").count() == 0
        assert got.select("payload_sha256").distinct().count() == got.select("payload_sha256", "feature", "media_sha256").distinct().count()
