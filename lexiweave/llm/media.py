"""ISO media containers: boxes, sample tables, keyframe byte ranges, without decoding payloads.

`probe` walks the nested boxes of an ISO base media file (plain or fragmented) and
resolves the sample tables (stts, ctts, stsc, stsz/stz2, stco/co64, stss; for
fragments tfhd, tfdt, trun) to byte ranges. `mux` writes such a file from raw 8-bit
samples. `media_columns` applies `probe` to a binary column; `text_media` stores the
texts of a table as media and reads them back.

Null, empty or damaged media give ok=false and no tracks: boxes that leave their parent or
nest deeper than NESTED, tables that leave the file, more samples than the file has bytes.
A null text is an empty one; repeated rows each give their row, and tied times keep the file's
order. A text of any length is one value of its column. Other columns of the input are not
read; `media_columns` replaces a column of the name it makes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, text_slices, texts

#: Boxes that hold only boxes (ISO/IEC 14496-12): fixed values.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"mfra", b"udta"}
#: Files with boxes nested deeper are taken as damaged.
NESTED = 64
SIDE, FRAME = 24, 24 * 24
TIMESCALE, KEY_EVERY = 25, 12
UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

INFO = "struct<ok:boolean,brand:string,duration_s:double,tracks:array<struct<track_id:long,handler:string,codec:string,timescale:long,duration:long,n_samples:long,n_keyframes:long,width:int,height:int,keyframes:array<struct<time:long,offset:long,size:long>>>>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, key_every: int = KEY_EVERY) -> bytes:
    """One uncompressed grey video track, a frame of 576 bytes a sample; the payload must fill whole frames."""
    n = len(payload) // FRAME
    if n * FRAME != len(payload) or n == 0:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    keys = range(1, n + 1, key_every)

    def moov(first: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, n, 1)),
            full(b"stsz", 0, 0, struct.pack(">II", FRAME, n)),
            full(b"co64", 0, 0, struct.pack(">IQ", 1, first)),
        )
        dinf = box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1)))
        minf = box(b"minf", full(b"vmhd", 0, 1, bytes(8)), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12), b"text frames\0"), minf)
        tkhd = full(b"tkhd", 0, 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), UNITY, struct.pack(">II", SIDE << 16, SIDE << 16))
        mvhd = full(b"mvhd", 0, 0, struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = ftyp + moov(0)
    wide = len(payload) + 8 > 0xFFFFFFFF
    lead = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return ftyp + moov(len(head) + len(lead)) + lead + payload


def walk(data: memoryview, at: int, end: int):
    """(path, start, body start, body end) of every box, in file order; a box beyond its parent is an error."""
    inside: list[tuple[tuple, int]] = [((), end)]  # the containers open here, and where each ends
    while True:
        path, end = inside[-1]
        if at + 8 > end:
            inside.pop()
            if not inside:
                return
            at = end
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"box {kind!r} at {at} leaves its parent")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        if len(inside) > NESTED:
            raise ValueError("boxes are nested too deep")
        here = (*path, kind)
        yield here, at, at + head, at + size
        if kind in CONTAINERS:
            inside.append((here, at + size))
            at += head
        else:
            at += size


def _words(data, at: int, n: int, kind: str = "I") -> tuple:
    if at + n * struct.calcsize(f">{kind}") > len(data):
        raise ValueError("a table leaves the file")
    return struct.unpack_from(f">{n}{kind}", data, at)


def _same(size: int, n: int, data) -> list[int]:
    """n samples of one size; samples of a byte or more cannot be more than the file has bytes."""
    if n > len(data):
        raise ValueError("more samples than the file has bytes")
    return [size] * n


class _Track:
    def __init__(self) -> None:
        self.id, self.handler, self.codec, self.scale, self.duration, self.width, self.height = 0, "", "", 0, 0, 0, 0
        self.stts, self.stsc, self.sizes, self.chunks, self.keys = [], [], [], [], None
        self.samples: list[tuple[int, int, int, bool]] = []

    def resolve(self) -> None:
        """(time, offset, size, key) of each sample that the tables name."""
        times, t = [], 0
        for n, d in self.stts:
            named = min(n, len(self.sizes) - len(times))
            times.extend(range(t, t + named * d, d) if d else [t] * named)
            t += n * d
        keys = None if self.keys is None else set(self.keys)
        k = 0
        runs = [*self.stsc, (len(self.chunks) + 1, 0)]
        for (first, per), (nxt, _) in zip(runs, runs[1:], strict=False):
            for chunk in self.chunks[first - 1 : nxt - 1]:
                at = chunk
                for _ in range(per):
                    if k >= len(self.sizes):
                        return
                    self.samples.append((times[k] if k < len(times) else t, at, self.sizes[k], keys is None or k + 1 in keys))
                    at += self.sizes[k]
                    k += 1


def probe(media: bytes | None) -> dict:
    """What the boxes say; sample payloads are neither read nor decoded."""
    none = {"ok": False, "brand": None, "duration_s": None, "tracks": []}
    if not media:
        return none
    data = memoryview(media)
    tracks: list[_Track] = []
    extends: dict[int, tuple] = {}
    brand, scale, duration = None, 0, 0
    current: _Track | None = None
    moof = base = now = 0
    defaults: tuple = (0, 0, 0)
    try:
        for path, start, at, end in walk(data, 0, len(data)):
            kind = path[-1]
            ver = data[at] if at < end else 0
            if kind == b"ftyp":
                brand = bytes(data[at : at + 4]).decode("latin-1")
            elif kind == b"mvhd":
                scale, duration = struct.unpack_from(">IQ", data, at + 20) if ver else _words(data, at + 12, 2)
            elif kind == b"trak":
                tracks.append(current := _Track())
            elif kind == b"tkhd":
                current.id = _words(data, at + (20 if ver else 12), 1)[0]
                current.width, current.height = (x >> 16 for x in _words(data, end - 8, 2))
            elif kind == b"mdhd":
                current.scale, current.duration = struct.unpack_from(">IQ", data, at + 20) if ver else _words(data, at + 12, 2)
            elif kind == b"hdlr" and path[:-1] == (b"moov", b"trak", b"mdia"):
                current.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
            elif kind == b"stsd":
                current.codec = bytes(data[at + 12 : at + 16]).decode("latin-1").strip()
            elif kind == b"stts":
                w = _words(data, at + 8, 2 * _words(data, at + 4, 1)[0])
                current.stts = list(zip(w[::2], w[1::2], strict=True))
            elif kind == b"stsc":
                w = _words(data, at + 8, 3 * _words(data, at + 4, 1)[0])
                current.stsc = list(zip(w[::3], w[1::3], strict=True))
            elif kind == b"stsz":
                same, n = _words(data, at + 4, 2)
                current.sizes = _same(same, n, data) if same else list(_words(data, at + 12, n))
            elif kind == b"stz2":
                bits, n = data[at + 7], _words(data, at + 8, 1)[0]
                if bits == 4:
                    raw = bytes(data[at + 12 : at + 12 + (n + 1) // 2])
                    current.sizes = [x for b in raw for x in (b >> 4, b & 15)][:n]
                else:
                    current.sizes = list(_words(data, at + 12, n, "B" if bits == 8 else "H"))
            elif kind == b"stco":
                current.chunks = list(_words(data, at + 8, _words(data, at + 4, 1)[0]))
            elif kind == b"co64":
                current.chunks = list(_words(data, at + 8, _words(data, at + 4, 1)[0], "Q"))
            elif kind == b"stss":
                current.keys = list(_words(data, at + 8, _words(data, at + 4, 1)[0]))
            elif kind == b"trex":
                i, _, d, s, f = _words(data, at + 4, 5)
                extends[i] = (d, s, f)
            elif kind == b"moof":
                moof = start
            elif kind == b"tfhd":
                flags = _words(data, at, 1)[0] & 0xFFFFFF
                i = _words(data, at + 4, 1)[0]
                current = next(x for x in tracks if x.id == i)
                p, base = at + 8, moof
                if flags & 1:
                    base, p = _words(data, p, 1, "Q")[0], p + 8
                p += 4 * bool(flags & 2)
                d, s, f = extends.get(i, (0, 0, 0))
                if flags & 8:
                    d, p = _words(data, p, 1)[0], p + 4
                if flags & 16:
                    s, p = _words(data, p, 1)[0], p + 4
                if flags & 32:
                    f = _words(data, p, 1)[0]
                defaults = (d, s, f)
                now = sum(x * y for x, y in current.stts)
                if current.samples:
                    now = current.samples[-1][0] + d
            elif kind == b"tfdt":
                now = _words(data, at + 4, 1, "Q" if ver else "I")[0]
            elif kind == b"trun":
                flags, n = _words(data, at, 1)[0] & 0xFFFFFF, _words(data, at + 4, 1)[0]
                p, pos, first = at + 8, base, None
                if flags & 1:
                    pos, p = base + _words(data, p, 1, "i")[0], p + 4
                if flags & 4:
                    first, p = _words(data, p, 1)[0], p + 4
                if n > len(data):
                    raise ValueError("more samples than the file has bytes")
                for j in range(n):
                    d, s, f = defaults
                    if flags & 0x100:
                        d, p = _words(data, p, 1)[0], p + 4
                    if flags & 0x200:
                        s, p = _words(data, p, 1)[0], p + 4
                    if flags & 0x400:
                        f, p = _words(data, p, 1)[0], p + 4
                    elif j == 0 and first is not None:
                        f = first
                    p += 4 * bool(flags & 0x800)
                    current.samples.append((now, pos, s, not f >> 16 & 1))
                    now, pos = now + d, pos + s
                base = pos
                current.duration = max(current.duration, now)
        for t in tracks:
            fragments, t.samples = t.samples, []
            t.resolve()
            t.samples += fragments
            if any(o + s > len(data) for _, o, s, _ in t.samples):
                raise ValueError("a sample lies beyond the file")
    except (ValueError, struct.error, StopIteration, AttributeError, IndexError, OverflowError):
        return none
    if brand is None and not tracks:
        return none
    seconds = max([duration / scale if scale else 0.0, *(t.duration / t.scale for t in tracks if t.scale)])
    return {
        "ok": True,
        "brand": brand,
        "duration_s": seconds,
        "tracks": [
            {
                "track_id": t.id, "handler": t.handler, "codec": t.codec, "timescale": t.scale, "duration": t.duration, "n_samples": len(t.samples), "n_keyframes": sum(k for *_, k in t.samples), "width": t.width, "height": t.height,
                "keyframes": [{"time": a, "offset": o, "size": s} for a, o, s, k in t.samples if k],
            }
            for t in tracks
        ],
    }


def samples(media: bytes) -> list[tuple[int, int]]:
    """Byte ranges (offset, size) of the first track's samples that `mux` wrote, in order."""
    info = probe_track(media)
    return [(o, s) for _, o, s, _ in info.samples]


def probe_track(media: bytes) -> _Track:
    """The first track with its resolved samples, keyframes or not."""
    data, t = memoryview(media), _Track()
    for path, _, at, _ in walk(data, 0, len(data)):
        n = lambda: _words(data, at + 4, 1)[0]  # noqa: E731, B023
        if path[-1] == b"stts":
            w = _words(data, at + 8, 2 * n())
            t.stts = list(zip(w[::2], w[1::2], strict=True))
        elif path[-1] == b"stsc":
            w = _words(data, at + 8, 3 * n())
            t.stsc = [(a, b) for a, b, _ in zip(w[::3], w[1::3], w[2::3], strict=True)]
        elif path[-1] == b"stsz":
            same, k = _words(data, at + 4, 2)
            t.sizes = _same(same, k, data) if same else list(_words(data, at + 12, k))
        elif path[-1] == b"co64":
            t.chunks = list(_words(data, at + 8, n(), "Q"))
    t.resolve()
    return t


def media_columns(df: DataFrame, media: str = "media", into: str = "info") -> DataFrame:
    """df with a struct column of codec, duration and keyframe byte ranges of each binary value."""
    kind = INFO

    @F.pandas_udf(kind)
    def info(col):
        import pandas as pd

        return pd.DataFrame([probe(x) for x in col], columns=["ok", "brand", "duration_s", "tracks"])

    return df.withColumn(into, info(F.col(media)))


def store(text: str) -> tuple[int, bytes]:
    """The text's UTF-8 length, and it as a media file."""
    raw = text.encode()
    n = max(1, -(-len(raw) // FRAME)) * FRAME
    return len(raw), mux(raw.ljust(n, b"\xff"))


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("time", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])))]
)


def digest(text: str) -> tuple:
    """Store, read back by the sample tables, describe; the columns of OUT after doc_id."""
    n, media = store(text)
    info = probe(media)
    track = info["tracks"][0]
    sha, size, tail = hashlib.sha256(), 0, b""
    view = memoryview(media)
    run_at = run_end = None
    for o, s in [*samples(media), (None, 0)]:  # neighbouring samples are read as one range
        if o is not None and run_end == o:
            run_end += s
            continue
        if run_at is not None:
            part = view[run_at:run_end]
            sha.update(part)
            size += len(part)
            tail = (tail + bytes(part[-32:]))[-32:]
        run_at, run_end = o, (o or 0) + s
    first, last = track["keyframes"][0], track["keyframes"][-1]
    feature = f"{info['brand']}/{track['handler']}/{track['codec']}/{track['width']}x{track['height']} duration={track['duration']}/{track['timescale']} samples={track['n_samples']} keyframes={track['n_keyframes']} first={first['offset']}+{first['size']} last={last['offset']}+{last['size']}"
    return (n, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, track["codec"], info["duration_s"], track["n_samples"], track["n_keyframes"], track["keyframes"])


def _rows(batch: pa.RecordBatch):
    """OUT's columns of a batch (doc_id, text), some texts at a time: a batch has as many rows whatever their length."""
    for first, end, _, _ in text_slices(batch.column(1)):
        rows = zip(*map(digest, texts(batch.column(1).slice(first, end - first))), strict=True)
        yield dict(zip(OUT.names, [batch.column(0).slice(first, end - first), *rows], strict=True))


def text_media(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): the stored payload and the media's features."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches(_rows, OUT), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_samples long, n_keyframes long, keyframes array<struct<time:long,offset:long,size:long>>")
