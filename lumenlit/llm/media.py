"""Media columns: ISO media containers built, walked and indexed inside Spark.

``store`` wraps bytes losslessly in an ISO base media file (one track of 8-bit
samples); ``describe_tracks`` walks the nested boxes of any such file, decodes the sample
tables of every track, in the movie's own boxes and in its fragments (``moof``), and
returns codec, duration and the byte ranges of keyframes; the payload itself is never
decoded. ``describe`` is the same for the first track, and ``read_back`` fetches the
bytes which those ranges name.

Every function works on one row at a time inside an Arrow batch, so memory is bounded
by Spark's batch and the largest single file; a file of any length is walked whole.

Defined results: a null or empty payload is stored as one block of zero bytes by
``pad``; ``describe`` of null gives null; of bytes that are no ISO media file or break
off, a row with ``valid`` false and nothing else (``describe_tracks``: null); a track
that has neither sample tables nor fragments has no samples; repeated rows give equal rows. Columns are named by
the caller, so other columns of the table never clash with the operator's own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: Bytes in one sample of the stored track.
BLOCK = 64
#: Samples in one chunk of the stored track; a keyframe begins every chunk.
CHUNK = 256
RATE = 8000

DESCRIPTION = (
    "valid boolean, codec string, timescale long, duration long, samples long, chunks long, keyframes long,"
    " keyframe_ranges array<struct<first_sample: long, samples: long, offset: long, length: long>>,"
    " media_ranges array<struct<offset: long, length: long>>"
)
TRACKS = (
    "array<struct<track: long, handler: string, codec: string, timescale: long, duration: long, samples: long, chunks: long, fragments: long, keyframes: long,"
    " keyframe_ranges: array<struct<first_sample: long, samples: long, offset: long, length: long>>, media_ranges: array<struct<offset: long, length: long>>>>"
)
#: Boxes that hold other boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def pad(payload: Column) -> Column:
    """Zero bytes appended up to a positive multiple of the block."""
    data = F.coalesce(payload.cast("binary"), F.lit(b""))
    size = F.octet_length(data)
    whole = F.greatest(F.ceil(size / BLOCK) * BLOCK, F.lit(BLOCK)).cast("int")
    return F.concat(data, F.repeat(F.lit("\0"), whole - size).cast("binary"))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def container(payload: bytes) -> bytes:
    """An ISO media file with the payload as 8-bit samples; equal payloads give equal files."""
    n, rest = divmod(len(payload), BLOCK)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of the block")
    chunks = -(-n // CHUNK)
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ticks = n * BLOCK
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    tail = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if tail == CHUNK else [(1, tail, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, tail, 1)]
    stbl_head = (
        _full(b"stsd", struct.pack(">I", 1), entry)
        + _full(b"stts", struct.pack(">III", 1, n, BLOCK))
        + _full(b"stss", struct.pack(f">{chunks + 1}I", chunks, *range(1, n + 1, CHUNK)))
        + _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs))
        + _full(b"stsz", struct.pack(">II", BLOCK, n))
    )

    def moov(first: int) -> bytes:
        places = struct.pack(f">I{chunks}Q", chunks, *range(first, first + n * BLOCK, CHUNK * BLOCK))
        stbl = _box(b"stbl", stbl_head, _full(b"co64", places))
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), unity, bytes(8), version=1, flags=3)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = len(brand) + len(moov(0)) + 16
    return brand + moov(head) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, start and end of the body of each box of a level."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError("a box is cut off")
        yield kind, body, stop
        start = stop


def _tables(data: memoryview, start: int, end: int, found: dict) -> dict:
    for kind, a, b in walk(data, start, end):
        if kind in NESTED:
            _tables(data, a, b, found)
        else:
            found.setdefault(kind, (a, b))
    return found


def _numbers(data: memoryview, at: tuple[int, int], width: str = "I", each: int = 1) -> list:
    """The entries of a table box: a count, then that many numbers or groups of them."""
    count = struct.unpack_from(">I", data, at[0] + 4)[0]
    if at[0] + 8 + count * each * struct.calcsize(width) > at[1]:
        raise ValueError("a table is cut off")
    flat = struct.unpack_from(f">{count * each}{width}", data, at[0] + 8)
    return list(flat) if each == 1 else [flat[i : i + each] for i in range(0, len(flat), each)]


class _Track:
    """What is known of a track: its samples fall into runs of the file."""

    def __init__(self, box: dict[bytes, tuple[int, int]], data: memoryview) -> None:
        at = box[b"tkhd"][0] if b"tkhd" in box else None
        self.number = 0 if at is None else struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        self.handler = bytes(data[box[b"hdlr"][0] + 8 : box[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in box else ""
        self.codec = bytes(data[box[b"stsd"][0] + 12 : box[b"stsd"][0] + 16]).decode("latin-1")
        at = box[b"mdhd"][0]
        self.timescale, self.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        self.samples = self.chunks = self.fragments = 0
        self.keyframes: list[list[int]] = []
        self.media: list[list[int]] = []

    def take(self, place: int, lengths: Iterator[tuple[int, bool]]) -> int:
        """Samples one after another from a place on: length and whether it is a keyframe."""
        begin = place
        for length, key in lengths:
            self.samples += 1
            if key:
                last = self.keyframes[-1] if self.keyframes else None
                if last and last[2] + last[3] == place and last[0] + last[1] == self.samples:
                    last[1], last[3] = last[1] + 1, last[3] + length
                else:
                    self.keyframes.append([self.samples, 1, place, length])
            place += length
        self.chunks += 1
        if self.media and self.media[-1][0] + self.media[-1][1] == begin:
            self.media[-1][1] += place - begin
        elif place > begin:
            self.media.append([begin, place - begin])
        return place

    def told(self) -> dict:
        return {
            "track": self.number, "handler": self.handler, "codec": self.codec, "timescale": self.timescale, "duration": self.duration, "samples": self.samples, "chunks": self.chunks,
            "fragments": self.fragments, "keyframes": sum(k[1] for k in self.keyframes),
            "keyframe_ranges": [dict(zip(("first_sample", "samples", "offset", "length"), r, strict=True)) for r in self.keyframes],
            "media_ranges": [dict(zip(("offset", "length"), r, strict=True)) for r in self.media],
        }


def _tabled(data: memoryview, start: int, end: int) -> _Track:
    """A track with the samples of its own tables."""
    box = _tables(data, start, end, {})
    track = _Track(box, data)
    if b"stsz" not in box:
        return track
    same, n = struct.unpack_from(">II", data, box[b"stsz"][0] + 4)
    if not same and box[b"stsz"][0] + 12 + 4 * n > box[b"stsz"][1]:
        raise ValueError("a table is cut off")
    sizes = None if same else struct.unpack_from(f">{n}I", data, box[b"stsz"][0] + 12)
    places = _numbers(data, box[b"co64"], "Q") if b"co64" in box else _numbers(data, box[b"stco"]) if b"stco" in box else []
    runs = _numbers(data, box[b"stsc"], each=3) if places else []
    keys = set(_numbers(data, box[b"stss"])) if b"stss" in box else None
    run = -1
    for chunk, place in enumerate(places, 1):
        if run + 1 < len(runs) and runs[run + 1][0] == chunk:
            run += 1
        if run < 0:
            raise ValueError("a chunk has no count")
        own = range(track.samples, min(n, track.samples + runs[run][1]))
        if track.take(place, ((same or sizes[i], keys is None or i + 1 in keys) for i in own)) > len(data):
            raise ValueError("a chunk lies outside the file")
    if track.samples != n:
        raise ValueError("samples have no chunk")
    return track


def _fragment(data: memoryview, head: int, start: int, end: int, tracks: dict[int, _Track], defaults: dict[int, tuple]) -> None:
    """The runs of a movie fragment, which begins at ``head``; places count from there unless it says otherwise."""
    place = head
    for kind, a, b in walk(data, start, end):
        if kind != b"traf":
            continue
        inner = list(walk(data, a, b))
        at = next(x for k, x, _ in inner if k == b"tfhd")
        flags, number = struct.unpack_from(">II", data, at)
        flags &= 0xFFFFFF
        at += 8
        _, duration, size, kinds = defaults.get(number, (1, 0, 0, 0))
        base = place if not flags & 0x20000 else head
        if flags & 1:
            base, at = struct.unpack_from(">Q", data, at)[0], at + 8
        at += 4 * bool(flags & 2)
        if flags & 8:
            duration, at = struct.unpack_from(">I", data, at)[0], at + 4
        if flags & 16:
            size, at = struct.unpack_from(">I", data, at)[0], at + 4
        if flags & 32:
            kinds, at = struct.unpack_from(">I", data, at)[0], at + 4
        place, track = base, tracks[number]
        track.fragments += 1
        for x in (x for k, x, _ in inner if k == b"trun"):
            flags, count = struct.unpack_from(">II", data, x)
            x += 8
            if flags & 1:
                place, x = base + struct.unpack_from(">i", data, x)[0], x + 4
            first = None
            if flags & 4:
                first, x = struct.unpack_from(">I", data, x)[0], x + 4
            fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
            if x + 4 * count * len(fields) > b:
                raise ValueError("a run is cut off")
            rows = struct.iter_unpack(f">{len(fields)}I", data[x : x + 4 * count * len(fields)]) if fields else [()] * count
            lengths = []
            for i, row in enumerate(rows):
                told = dict(zip(fields, row, strict=True))
                track.duration += told.get(0x100, duration)
                own = first if i == 0 and first is not None else told.get(0x400, kinds)
                lengths.append((told.get(0x200, size), not own & 0x10000))
            place = track.take(place, iter(lengths))
            if place > len(data):
                raise ValueError("a run lies outside the file")


def all_tracks(media: bytes | None) -> list[dict] | None:
    """Every track of a file, or None if it is no whole ISO media file."""
    if media is None:
        return None
    try:
        data = memoryview(media)
        boxes, heads, at = list(walk(data, 0, len(data))), [], 0
        for _, _, stop in boxes:
            heads.append(at)
            at = stop
        moov = next((a, b) for kind, a, b in boxes if kind == b"moov")
        inner = list(walk(data, *moov))
        tracks = [_tabled(data, a, b) for kind, a, b in inner if kind == b"trak"]
        extends = [x for kind, a, b in inner if kind == b"mvex" for x in walk(data, a, b) if x[0] == b"trex"]
        defaults = {n: tuple(rest) for n, *rest in (struct.unpack_from(">5I", data, a + 4) for _, a, _ in extends)}
        numbered = {t.number: t for t in tracks}
        for (kind, a, b), head in zip(boxes, heads, strict=True):
            if kind == b"moof":
                _fragment(data, head, a, b, numbered, defaults)
        return [t.told() for t in tracks] or None
    except (ValueError, KeyError, IndexError, StopIteration, struct.error):
        return None


def description(media: bytes | None) -> dict | None:
    """The first track."""
    if media is None:
        return None
    tracks = all_tracks(media)
    names = ("codec", "timescale", "duration", "samples", "chunks", "keyframes", "keyframe_ranges", "media_ranges")
    return {"valid": bool(tracks)} | (dict.fromkeys(names) if not tracks else {c: tracks[0][c] for c in names})


def _stored(payload: pd.Series) -> pd.Series:
    return payload.map(container, na_action="ignore")


def _described(media: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(("valid", "codec", "timescale", "duration", "samples", "chunks", "keyframes", "keyframe_ranges", "media_ranges"))
    frame = pd.DataFrame([description(m) or empty for m in media], columns=list(empty))
    return frame.astype({k: "Int64" for k in ("timescale", "duration", "samples", "chunks", "keyframes")})


def store(payload: Column) -> Column:
    """The payload (a positive multiple of the block long) as an ISO media file."""
    return F.pandas_udf(_stored, "binary")(payload)


def describe(media: Column) -> Column:
    """Codec, duration and byte ranges of the first track; payloads aren't decoded."""
    return F.pandas_udf(_described, DESCRIPTION)(media)


def describe_tracks(media: Column) -> Column:
    """An array with codec, duration and byte ranges of every track, fragments included."""
    return F.pandas_udf(lambda m: m.map(all_tracks, na_action="ignore"), TRACKS)(media)


def read_back(media: Column, ranges: Column) -> Column:
    """The bytes of a file in the given ranges, joined."""
    return F.aggregate(ranges, F.lit(b""), lambda acc, r: F.concat(acc, F.substring(media, (r["offset"] + 1).cast("int"), r["length"].cast("int"))))
