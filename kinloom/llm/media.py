"""Media columns from ISO base media containers.

A container is a tree of boxes. The walker reads box headers and the sample
tables below ``moov``; the payload in ``mdat`` is never decoded. From the
tables (stts, stsc, stsz or stz2, stco or co64, stss) it derives codec, duration
and the byte range of every keyframe. Fragments (moof) add their runs' samples to
the track's. An edit list, where there is one, gives the duration.

Null bytes give null columns, damaged containers give ``codec`` null and an
``error``. Null and empty texts store one frame of zero bytes; equal texts have
equal files; rows with equal ids are rows of their own, and ids may be null;
texts of any length are stored whole; further columns, whatever their names, are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import map_arrow, texts_of

#: Bytes of a frame: 8 by 8 samples of 8 bits.
FRAME = 64
SIDE = 8
FRAMES_PER_CHUNK = 256
KEYFRAME_EVERY = 16
TIMESCALE = 25
PARENTS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of a frame."""
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def write_container(payload: bytes) -> bytes:
    """A file of one video track whose frames are the payload's blocks of 64 bytes, stored as 8-bit grey samples without loss."""
    if not payload or len(payload) % FRAME:
        raise ValueError("payload must be a positive multiple of 64 bytes")
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_PER_CHUNK)
    keys = np.arange(1, n + 1, KEYFRAME_EVERY, dtype=">u4")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, min(n, FRAMES_PER_CHUNK), 1)]
    if chunks > 1 and n % FRAMES_PER_CHUNK:
        runs.append((chunks, n % FRAMES_PER_CHUNK, 1))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    wide = len(payload) + (1 << 20) >= 1 << 32

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (FRAMES_PER_CHUNK * FRAME)
        place = full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes())
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, 1)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", FRAME, n)),
            place,
        )
        minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full_box(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return ftyp + moov(head) + box(b"mdat", payload)


#: Kinds of a path that walk gives.
PATH = 8


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Each box's path (its last kinds, PATH at most), and where its body begins and ends. Follows 64-bit sizes and boxes that run to the end, to any depth."""
    todo = [[start, len(data) if end is None else end, path]]
    while todo:
        start, end, path = todo[-1]
        if start + 8 > end:
            if start != end:
                raise ValueError("bytes after the last box")
            todo.pop()
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("box cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} exceeds its parent")
        own = (*path[1 - PATH :], kind)
        yield own, body, start + size
        todo[-1][0] = start + size
        if kind in PARENTS:
            todo.append([body, start + size, own])


def _numbers(data: bytes, at: int, end: int, dtype: str, count: int) -> np.ndarray:
    if at + count * np.dtype(dtype).itemsize > end:
        raise ValueError("sample table cut off")
    return np.frombuffer(data, dtype, count, at).astype(np.int64)


def _sample_table(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict:
    def head(kind: bytes) -> tuple[int, int, int]:
        at, end = boxes[kind]
        return struct.unpack_from(">I", data, at + 4)[0], at + 8, end

    count, at, end = head(b"stsd")
    codec = data[at + 4 : at + 8].decode("latin-1") if count else ""
    runs, at, end = head(b"stts")
    stts = _numbers(data, at, end, ">u4", 2 * runs).reshape(-1, 2)
    timed = int(stts[:, 0].sum())
    if b"stz2" in boxes:
        at, end = boxes[b"stz2"]
        bits, n = struct.unpack_from(">II", data, at + 4)
        bits &= 0xFF
        if bits == 4:
            both = _numbers(data, at + 12, end, ">u1", -(-n // 2))
            sizes = np.stack([both >> 4, both & 15], 1).ravel()[:n]
        elif bits in (8, 16):
            sizes = _numbers(data, at + 12, end, f">u{bits // 8}", n)
        else:
            raise ValueError(f"samples' sizes of {bits} bits")
    else:
        at, end = boxes[b"stsz"]
        same, n = struct.unpack_from(">II", data, at + 4)
        if same * n > len(data):
            raise ValueError("samples are larger than the file")
        sizes = np.full(n, same, np.int64) if same else _numbers(data, at + 12, end, ">u4", n)
    runs, at, end = head(b"stsc")
    stsc = _numbers(data, at, end, ">u4", 3 * runs).reshape(-1, 3)
    wide = b"co64" in boxes
    chunks, at, end = head(b"co64" if wide else b"stco")
    places = _numbers(data, at, end, ">u8" if wide else ">u4", chunks)
    if timed > n:
        raise ValueError("stts has more samples than stsz")
    per_chunk = np.repeat(stsc[:, 1], np.diff(np.append(stsc[:, 0] - 1, chunks))) if runs else np.zeros(0, np.int64)
    upto = np.cumsum(per_chunk)  # may be far more than n: only n are looked up
    if n and (not len(upto) or upto[-1] < n):
        raise ValueError("chunks hold fewer samples than stsz")
    chunk_of = np.searchsorted(upto, np.arange(n), side="right")
    before = np.cumsum(sizes) - sizes
    first = upto - per_chunk
    offsets = places[chunk_of] + before - before[np.minimum(first[chunk_of], max(n - 1, 0))] if n else np.zeros(0, np.int64)
    if b"stss" in boxes:
        count, at, end = head(b"stss")
        keys = _numbers(data, at, end, ">u4", count) - 1
        keys = keys[(keys >= 0) & (keys < n)]
    else:
        keys = np.arange(n)
    return {"codec": codec, "units": int((stts[:, 0] * stts[:, 1]).sum()), "samples": n, "offsets": offsets, "sizes": sizes, "key_offsets": offsets[keys], "key_sizes": sizes[keys]}


def _edited(data: bytes, at: int, end: int) -> int:
    """Units of the movie that an edit list plays."""
    wide = data[at] == 1
    (count,) = struct.unpack_from(">I", data, at + 4)
    size = 20 if wide else 12
    if at + 8 + count * size > end:
        raise ValueError("edit list cut off")
    return sum(struct.unpack_from(">Q" if wide else ">I", data, at + 8 + i * size)[0] for i in range(count))


_DIFFERENCE = 0x10000  # the flag of a sample that is no keyframe


class _Fragment:
    """Runs of one track's samples in one fragment."""

    def __init__(self, base: int, defaults: tuple[int, int, int]):
        self.base, self.next = base, base
        self.duration, self.size, self.flags = defaults

    def head(self, data: bytes, at: int) -> None:
        (flags,) = struct.unpack_from(">I", data, at)
        at += 8
        if flags & 1:
            (self.base,) = struct.unpack_from(">Q", data, at)
            at += 8
        at += 4 if flags & 2 else 0
        for bit, name in ((8, "duration"), (16, "size"), (32, "flags")):
            if flags & bit:
                setattr(self, name, struct.unpack_from(">I", data, at)[0])
                at += 4
        self.next = self.base

    def run(self, data: bytes, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, sizes, durations and whether each sample is a keyframe."""
        flags, n = struct.unpack_from(">II", data, at)
        flags &= 0xFFFFFF
        at += 8
        if n > len(data):
            raise ValueError("a run has more samples than the file has bytes")
        if flags & 1:
            self.next = self.base + struct.unpack_from(">i", data, at)[0]
            at += 4
        first = None
        if flags & 4:
            (first,) = struct.unpack_from(">I", data, at)
            at += 4
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        table = _numbers(data, at, end, ">u4", n * len(fields)).reshape(n, len(fields))
        column = lambda bit, default: table[:, fields.index(bit)] if bit in fields else np.full(n, default, np.int64)
        sizes, of = column(0x200, self.size), column(0x400, self.flags)
        if first is not None and n:
            of = of.copy()
            of[0] = first
        offsets = self.next + np.cumsum(sizes) - sizes
        self.next += int(sizes.sum())
        return offsets, sizes, column(0x100, self.duration), (of & _DIFFERENCE) == 0


def read_container(data: bytes) -> dict:
    """The first track that has samples: codec, timescale, duration in units and seconds, samples and keyframe byte ranges."""
    tracks: list[dict] = []
    by_id: dict[int, dict] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    movie = moof = in_runs = 0
    fragment = None
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"boxes": {}, "scale": 0, "edited": 0, "runs": []})
        elif kind == b"tkhd" and tracks:
            by_id[struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]] = tracks[-1]
        elif kind == b"mvhd":
            (movie,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
        elif kind == b"mdhd" and tracks:
            (tracks[-1]["scale"],) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
        elif kind == b"elst" and tracks:
            tracks[-1]["edited"] = _edited(data, at, end)
        elif kind == b"trex":
            track, _, *own = struct.unpack_from(">5I", data, at + 4)
            defaults[track] = tuple(own)
        elif kind == b"moof":
            moof = at - (16 if struct.unpack_from(">I", data, at - 16)[0] == 1 and data[at - 12 : at - 8] == b"moof" else 8)
        elif kind == b"tfhd":
            (track,) = struct.unpack_from(">I", data, at + 4)
            fragment = _Fragment(moof, defaults.get(track, (0, 0, 0))), by_id.get(track)
            fragment[0].head(data, at)
        elif kind == b"trun" and fragment and fragment[1]:
            fragment[1]["runs"].append(fragment[0].run(data, at, end))
            in_runs += len(fragment[1]["runs"][-1][0])
            if in_runs > len(data):
                raise ValueError("runs have more samples than the file has bytes")
        elif len(path) > 1 and path[-2] == b"stbl" and tracks:
            tracks[-1]["boxes"][kind] = (at, end)
    found = None
    for track in tracks:
        boxes = track["boxes"]
        if {b"stsd", b"stts", b"stsc"} <= boxes.keys() and boxes.keys() & {b"stco", b"co64"} and boxes.keys() & {b"stsz", b"stz2"}:
            found = _sample_table(data, boxes) | {"timescale": track["scale"], "edited": track["edited"]}
            if track["runs"]:
                offsets, sizes, durations, keys = (np.concatenate(x) for x in zip(*track["runs"]))
                found["offsets"], found["sizes"] = np.append(found["offsets"], offsets), np.append(found["sizes"], sizes)
                found["key_offsets"], found["key_sizes"] = np.append(found["key_offsets"], offsets[keys]), np.append(found["key_sizes"], sizes[keys])
                found["samples"] += len(sizes)
                found["units"] += int(durations.sum())
            if found["samples"]:
                break
    if found is None:
        raise ValueError("no track with sample tables")
    if len(found["offsets"]) and ((found["offsets"] + found["sizes"]).max() > len(data) or found["offsets"].min() < 0):
        raise ValueError("a sample lies outside the file")
    seconds = found["units"] / found["timescale"] if found["timescale"] else None
    return found | {"duration": found["edited"] / movie if found["edited"] and movie else seconds}


def payload_of(data: bytes, track: dict) -> bytes:
    """The track's stored bytes in sample order, joined where samples touch."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    first = offsets[np.append(0, breaks)]
    last = (offsets + sizes)[np.append(breaks - 1, len(offsets) - 1)]
    return b"".join(data[a:b] for a, b in zip(first.tolist(), last.tolist()))


def feature(track: dict) -> str:
    keys = np.stack([track["key_offsets"], track["key_sizes"]], 1)
    ranges = hashlib.sha1(keys.astype(">u8").tobytes()).hexdigest()[:16]
    first = "+".join(map(str, keys[0])) if len(keys) else "-"
    last = "+".join(map(str, keys[-1])) if len(keys) else "-"
    return f"codec={track['codec'].strip()};timescale={track['timescale']};duration={track['units']};samples={track['samples']};keyframes={len(keys)};first={first};last={last};ranges={ranges}"


def media_columns(df: DataFrame, media_col: str = "media", keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns codec, duration (s), samples and keyframes (array of offset and length) of a binary column, beside the key columns, and error. Null media has nulls; what is no readable file has an error and nulls. Counts that a file states are held against its tables and its size before anything is made of them, so memory follows the file's size."""
    names = [f"k{i}" for i in range(len(keys))]
    source = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(media_col).alias("media"))
    kinds = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in names)

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for data in batch.column("media").to_pylist():
                if data is None:
                    row = (None, None, None, None, None)
                else:
                    try:
                        t = read_container(data)
                        row = (t["codec"].strip(), t["duration"], t["samples"], [{"offset": int(o), "length": int(s)} for o, s in zip(t["key_offsets"], t["key_sizes"])], None)
                    except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
                        row = (None, None, None, None, str(e))
                for column, value in zip(rows, row):
                    column.append(value)
            ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
            out = [pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.float64(), pa.int64(), ranges, pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *out], [*names, "codec", "duration", "samples", "keyframes", "error"])

    out = map_arrow(source, run, f"{kinds}codec string, duration double, samples long, keyframes array<struct<offset: long, length: long>>, error string")
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), "codec", "duration", "samples", "keyframes", "error")


def media_digest(docs: DataFrame) -> DataFrame:
    """Every text stored in a container, read back, with its digests and feature. A null text is empty."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in texts_of(batch):
                raw = text.encode("utf-8", "surrogatepass")
                media = write_container(padded(raw))
                track = read_container(media)
                back = payload_of(media, track)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(track))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
