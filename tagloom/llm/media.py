"""Media columns: ISO media containers are walked box by box; sample tables are decoded, payloads are not."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import text_batches

UNIT = 64  # bytes of an access unit of stored payloads
KEY_EVERY = 16  # every so many units is a sync sample
UNITS_A_CHUNK = 64
TIMESCALE = 8000
# Boxes that hold boxes (ISO/IEC 14496-12)
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"mvex", b"moof", b"traf"}
MAX_DEPTH = 32

TRACK = (
    "array<struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:double,n_samples:bigint,"
    "n_bytes:bigint,keyframes:array<struct<start:bigint,stop:bigint>>>>"
)


class Malformed(ValueError):
    """The bytes are not a container, or its tables contradict each other."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def store(payload: bytes) -> bytes:
    """A container with one track of raw 8-bit samples, in units of 64 bytes, that holds ``payload`` as it is."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of the unit")
    n = len(payload) // UNIT
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    wide = len(payload) + 16 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    at = len(ftyp) + len(head)
    starts = np.arange(0, n, UNITS_A_CHUNK, dtype=np.uint64) * UNIT + at
    full, rest = divmod(n, UNITS_A_CHUNK)
    runs = [(1, UNITS_A_CHUNK)] * bool(full) + [(full + 1, rest)] * bool(rest)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    unity = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    table = _box(
        b"stbl",
        _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        _full(b"stts", 0, 0, struct.pack(">III", 1, n, UNIT)),
        _full(b"stss", 0, 0, struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs]),
        _full(b"stsz", 0, 0, struct.pack(">II", UNIT, n)),
        _full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", len(starts)), starts.astype(">u8" if wide else ">u4").tobytes()),
    )
    ticks = struct.pack(">QQIQ", 0, 0, TIMESCALE, len(payload))
    url = _full(b"url ", 0, 1)
    media = _box(
        b"mdia",
        _full(b"mdhd", 1, 0, ticks, struct.pack(">HH", 0x55C4, 0)),
        _full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"raw\0"),
        _box(b"minf", _full(b"smhd", 0, 0, bytes(4)), _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), url)), table),
    )
    header = _full(b"tkhd", 1, 3, struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">hhhH", 0, 0, 256, 0), unity, bytes(8))
    movie = _full(b"mvhd", 1, 0, ticks, struct.pack(">Ihh", 1 << 16, 256, 0), bytes(8), unity, bytes(24), struct.pack(">I", 2))
    return b"".join([ftyp, head, payload, _box(b"moov", movie, _box(b"trak", header, media))])


def _unpack(form: str, data: memoryview, at: int, stop: int) -> tuple:
    """Fields at ``at``, which a box that stops at ``stop`` must hold."""
    if at + struct.calcsize(form) > stop:
        raise Malformed("cut in a box")
    return struct.unpack_from(form, data, at)


def walk(data: memoryview, start: int = 0, stop: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int, int]]:
    """(path of kinds, start, body, stop) of every box, parents first; containers are descended into."""
    stop = len(data) if stop is None else stop
    while start < stop:
        if stop - start < 8:
            if any(data[start:stop]):
                raise Malformed("bytes left over after a box")
            return
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = _unpack(">Q", data, body, stop)[0], body + 8
        elif size == 0:
            size = stop - start
        if kind == b"uuid":
            body += 16
        if size < body - start or start + size > stop:
            raise Malformed(f"box {kind!r} goes beyond its parent")
        yield (*path, kind), start, body, start + size
        if kind in CONTAINERS:
            if len(path) >= MAX_DEPTH:
                raise Malformed("boxes are nested too deeply")
            yield from walk(data, body, start + size, (*path, kind))
        start += size


def _table(data: memoryview, at: int, stop: int, kind: str, columns: int) -> np.ndarray:
    """The rows behind a 32-bit count; what is allocated is bounded by the box."""
    n = _unpack(">I", data, at, stop)[0]
    width = np.dtype(kind).itemsize * columns
    if at + 4 + n * width > stop:
        raise Malformed("a table is longer than its box")
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


@dataclass
class _Samples:
    """What a track's tables say: byte ranges of its chunks or runs in order, and of its sync samples."""

    n: int = 0
    ticks: float = 0.0
    chunks: list[np.ndarray] = field(default_factory=list)  # (k, 2) each: start, stop
    keys: list[np.ndarray] = field(default_factory=list)

    def add(self, chunks: np.ndarray, keys: np.ndarray, end: int) -> None:
        if len(chunks) and (chunks.min() < 0 or chunks.max() > end):
            raise Malformed("samples beyond the end")
        self.chunks.append(chunks)
        self.keys.append(keys)


def _touching(parts: list[np.ndarray]) -> np.ndarray:
    """Ranges in order, those that touch the one before joined with it."""
    r = np.concatenate([np.zeros((0, 2), np.int64), *parts])
    if not len(r):
        return r
    new = np.append(True, r[1:, 0] != r[:-1, 1])
    return np.stack([r[new, 0], r[np.append(new[1:], True), 1]], axis=1)


def _sizes(own: dict[bytes, tuple[int, int]], data: memoryview) -> tuple[int, int, np.ndarray | None]:
    """(number of samples, the size that all have, or 0 and each one's size)."""
    if b"stsz" in own:
        at, stop = own[b"stsz"]
        size, n = _unpack(">II", data, at + 4, stop)
        return (n, size, None) if size else (n, 0, _table(data, at + 8, stop, ">u4", 1)[:, 0])
    if b"stz2" not in own:
        raise Malformed("no sample sizes")
    at, stop = own[b"stz2"]
    bits, n = _unpack(">xxxBI", data, at + 4, stop)
    if bits not in (4, 8, 16) or at + 12 + (n * bits + 7) // 8 > stop:
        raise Malformed("compact sizes don't fit their box")
    raw = np.frombuffer(data, ">u2" if bits == 16 else "u1", (n * bits + 7) // 8 // (1 + (bits == 16)), at + 12).astype(np.int64)
    return n, 0, np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n] if bits == 4 else raw


def _from_tables(own: dict[bytes, tuple[int, int]], data: memoryview, out: _Samples) -> None:
    """Adds what the sample tables say. Samples of one size need no row each, so a count alone allocates nothing."""
    n, size, sizes = _sizes(own, data)
    if not n:
        return
    offsets_box = b"co64" if b"co64" in own else b"stco"
    if offsets_box not in own or b"stsc" not in own:
        raise Malformed("no chunk table")
    at, stop = own[offsets_box]
    chunks = _table(data, at + 4, stop, ">u8" if offsets_box == b"co64" else ">u4", 1)[:, 0]
    at, stop = own[b"stsc"]
    runs = _table(data, at + 4, stop, ">u4", 3)
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
        raise Malformed("chunk runs don't follow each other")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if per_chunk.sum() != n:
        raise Malformed("chunks and sizes hold different numbers of samples")
    chunks, per_chunk = chunks[per_chunk > 0], per_chunk[per_chunk > 0]
    first = np.cumsum(per_chunk) - per_chunk
    sums = None if sizes is None else np.append(0, np.cumsum(sizes))

    def before(i: np.ndarray) -> np.ndarray:
        return i * size if sums is None else sums[i]

    if size and int(n) * size > len(data):
        raise Malformed("samples beyond the end")
    ranges = np.stack([chunks, chunks + before(first + per_chunk) - before(first)], axis=1)
    keys = ranges
    if b"stss" in own:
        at, stop = own[b"stss"]
        i = np.unique(_table(data, at + 4, stop, ">u4", 1)[:, 0]) - 1
        if len(i) and (i[0] < 0 or i[-1] >= n):
            raise Malformed("a sync sample that isn't there")
        c = np.searchsorted(first, i, side="right") - 1
        start = chunks[c] + before(i) - before(first[c])
        keys = np.stack([start, start + before(i + 1) - before(i)], axis=1)
    out.add(ranges, keys, len(data))
    out.n += int(n)
    if b"stts" in own:
        at, stop = own[b"stts"]
        out.ticks += float(np.prod(_table(data, at + 4, stop, ">u4", 2).astype(np.float64), axis=1).sum())


class _Fragments:
    """Runs of samples in movie fragments, with what their headers leave to defaults."""

    NOT_SYNC = 0x10000

    def __init__(self, data: memoryview):
        self.data = data
        self.defaults: dict[int, tuple[int, int, int]] = {}  # duration, size, flags by track
        self.samples: dict[int, _Samples] = {}
        self.moof = self.data_end = 0
        self.first = True
        self.track: tuple | None = None

    def box(self, path: tuple, start: int, at: int, stop: int) -> None:
        if path == (b"moov", b"mvex", b"trex"):
            track, _, *rest = _unpack(">IIIII", self.data, at + 4, stop)
            self.defaults[track] = tuple(rest)
        elif path == (b"moof",):
            self.moof, self.first = start, True
        elif path == (b"moof", b"traf"):
            self.track = None
        elif path == (b"moof", b"traf", b"tfhd"):
            self._header(at, stop)
        elif path == (b"moof", b"traf", b"trun"):
            self._run(at, stop)

    def _header(self, at: int, stop: int) -> None:
        flags, track = _unpack(">II", self.data, at, stop)
        at += 8
        base = self.moof if flags & 0x20000 or self.first else self.data_end
        if flags & 1:
            base, at = _unpack(">Q", self.data, at, stop)[0], at + 8
        at += 4 * bool(flags & 2)
        own = list(self.defaults.get(track, (0, 0, 0)))
        for k, bit in enumerate((8, 0x10, 0x20)):
            if flags & bit:
                own[k], at = _unpack(">I", self.data, at, stop)[0], at + 4
        self.first, self.track, self.data_end = False, (track, base, *own), base

    def _run(self, at: int, stop: int) -> None:
        if self.track is None:
            raise Malformed("a run of samples without a header")
        track, base, duration, size, sample_flags = self.track
        flags, n = _unpack(">II", self.data, at, stop)
        flags &= 0xFFFFFF
        at += 8
        start = self.data_end
        if flags & 1:
            start, at = base + _unpack(">i", self.data, at, stop)[0], at + 4
        head = None
        if flags & 4:
            head, at = _unpack(">I", self.data, at, stop)[0], at + 4
        fields = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
        if at + 4 * len(fields) * n > stop:
            raise Malformed("a run is longer than its box")
        out = self.samples.setdefault(track, _Samples())
        if n * size > len(self.data) and 0x200 not in fields:
            raise Malformed("samples beyond the end")
        rows = np.frombuffer(self.data, ">u4", n * len(fields), at).astype(np.int64).reshape(n, len(fields))
        column = {b: rows[:, k] for k, b in enumerate(fields)}
        end = start + (int(column[0x200].sum()) if 0x200 in column else n * size)
        sync = 0x400 in column or (head is not None and (head ^ sample_flags) & self.NOT_SYNC)
        if not n:
            keys = np.zeros((0, 2), np.int64)
        elif sync and 0x400 not in column and 0x200 not in column:  # the first sample differs from all others
            keys = np.array([[start, start + size]] if not head & self.NOT_SYNC else [[start + size, end]], np.int64)
        elif 0x400 not in column and not sync:
            keys = np.array([[start, end]], np.int64) if not sample_flags & self.NOT_SYNC else np.zeros((0, 2), np.int64)
        else:
            each = column[0x200] if 0x200 in column else np.full(n, size, np.int64)
            own = column[0x400].copy() if 0x400 in column else np.full(n, sample_flags, np.int64)
            if head is not None:
                own[0] = head
            at_ = start + np.cumsum(each) - each
            keys = np.stack([at_, at_ + each], axis=1)[own & self.NOT_SYNC == 0]
        out.add(np.array([[start, end]], np.int64) if n else np.zeros((0, 2), np.int64), keys, len(self.data))
        out.n += n
        out.ticks += float(column[0x100].sum()) if 0x100 in column else float(n * duration)
        self.data_end = end


def _read(media: bytes) -> list[tuple[dict[bytes, tuple[int, int]], int | None, _Samples]]:
    """(boxes, number, samples) of each track, from sample tables and movie fragments."""
    data, found = memoryview(media), []
    own: dict[bytes, tuple[int, int]] = {}
    fragments = _Fragments(data)
    for path, start, body, stop in walk(data):
        if path == (b"moov", b"trak"):
            own = {}
            found.append(own)
        elif path[:2] == (b"moov", b"trak"):
            own.setdefault(path[-1], (body, stop))
        else:
            fragments.box(path, start, body, stop)
    out = []
    for own in found:
        track = None
        if b"tkhd" in own:
            at, stop = own[b"tkhd"]
            track = _unpack(">I", data, at + (20 if _unpack(">B", data, at, stop)[0] == 1 else 12), stop)[0]
        samples = _Samples()
        _from_tables(own, data, samples)
        more = fragments.samples.get(track)
        if more:
            samples = _Samples(samples.n + more.n, samples.ticks + more.ticks, samples.chunks + more.chunks, samples.keys + more.keys)
        out.append((own, track, samples))
    return out


def tracks(media: bytes) -> list[dict]:
    """Tracks with codec, duration and the byte ranges of sync samples; runs of touching sync samples are one range."""
    data = memoryview(media)
    return [_track(own, track, samples, data) for own, track, samples in _read(media)]


def _track(own: dict[bytes, tuple[int, int]], track: int | None, samples: _Samples, data: memoryview) -> dict:
    if b"mdhd" not in own or b"stsd" not in own:
        raise Malformed("a track without header or codec")
    at, stop = own[b"mdhd"]
    wide = _unpack(">B", data, at, stop)[0] == 1
    scale, length = _unpack(">IQ" if wide else ">II", data, at + (20 if wide else 12), stop)
    at, stop = own[b"stsd"]
    codec = bytes(data[at + 12 : at + 16]).decode("latin-1") if at + 16 <= stop else None
    handler = bytes(data[own[b"hdlr"][0] + 8 : own[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in own and own[b"hdlr"][0] + 12 <= own[b"hdlr"][1] else None
    return {
        "track_id": track, "handler": handler, "codec": codec, "timescale": scale,
        "duration": (samples.ticks or length) / scale if scale else None, "n_samples": samples.n,
        "n_bytes": int(sum((c[:, 1] - c[:, 0]).sum() for c in samples.chunks)),
        "keyframes": [{"start": a, "stop": b} for a, b in _touching(samples.keys).tolist()],
    }


def read_payload(media: bytes) -> bytes:
    """The samples of the first track, in order, from where its tables say they are."""
    found = _read(media)
    if not found:
        raise Malformed("no track")
    data = memoryview(media)
    return b"".join(data[a:b] for a, b in _touching(found[0][2].chunks).tolist())


def probe_media(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` with ``tracks`` and ``error`` read from the container in ``media``.

    A null container has null tracks and no error; a malformed one null tracks and the reason; one without a movie box
    no tracks. Payload bytes are never touched.
    """
    keep = [c for c in df.columns if c != media] if keep is None else keep
    slim = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{media}`").alias("media"))
    from pyspark.sql import types as T

    parsed = T._parse_datatype_string(TRACK)
    schema = T.StructType([T.StructField("row", slim.schema["row"].dataType), T.StructField("tracks", parsed), T.StructField("error", T.StringType())])
    arrow = pa.list_(pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("n_bytes", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, errors = [], []
            for m in b.column("media"):
                try:
                    found.append(None if not m.is_valid else tracks(m.as_py()))
                    errors.append(None)
                except Malformed as e:
                    found.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, arrow), pa.array(errors, pa.string())], ["row", "tracks", "error"])

    return slim.mapInArrow(run, schema).select("row.*", "tracks", "error")


def text_media(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n_bytes, media``: every whole text's UTF-8 bytes (null: none) padded and stored as a container.

    Equal texts have equal containers, repeated rows one each; an empty table has an empty result.
    """
    text_batches(df.sparkSession)
    slim = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text").cast(pa.large_binary())]
            made = [pa.array([len(x) for x in raw], pa.int64()), pa.array([store(pad(x)) for x in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *made], ["doc", "n_bytes", "media"])

    return slim.mapInArrow(run, f"doc {kind}, n_bytes bigint, media binary").withColumnRenamed("doc", doc)


def media_digest(df: DataFrame, doc: str = "doc_id", media: str = "media") -> DataFrame:
    """``doc, n_bytes`` and what the stored bytes say when read back: payload, digests and the ``feature`` string.

    A null or malformed container has null figures and the reason in ``error``; equal containers have equal figures, repeated
    rows one each; an empty table has an empty result. Columns besides ``doc``, ``n_bytes`` and ``media`` are not looked at.
    """
    slim = df.select(F.col(f"`{doc}`").alias("doc"), "n_bytes", F.col(f"`{media}`").alias("media"))
    kind = slim.schema["doc"].dataType.simpleString()
    out = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "n_keyframes", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string()]

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (*(None,) * 9, "no container")
        try:
            payload, t = read_payload(raw), tracks(raw)[0]
        except Malformed as e:
            return (*(None,) * 9, str(e))
        ranges = ",".join(f"{k['start']}-{k['stop']}" for k in t["keyframes"])
        seconds = "" if t["duration"] is None else f"{t['duration']:.6f}"
        feature = f"codec={(t['codec'] or '').strip()};seconds={seconds};samples={t['n_samples']};keyframes={ranges}"
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(),
            feature, t["codec"], t["duration"], len(t["keyframes"]), None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column("media")]
            cols = list(zip(*rows)) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("n_bytes"), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], ["doc", "n_bytes", *out])

    names = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration double, n_keyframes bigint, error string"
    return slim.mapInArrow(run, f"doc {kind}, n_bytes bigint, {names}").withColumnRenamed("doc", doc)
