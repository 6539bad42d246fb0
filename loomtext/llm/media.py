"""Operator 2, media columns: Matroska files to packet tables.

A file is a tree of EBML elements: an identifier and a size, both of variable length, and content. The parser walks Segment,
Tracks, Clusters and Cues, takes blocks apart (no, Xiph, fixed-size and EBML lacing) and gives each frame's track, time and byte
range; no payload is copied. One file is parsed by one task, in one pass, and needs memory for its packet columns only; nothing
is shuffled.

The test tables hold no media, so the query muxes each document's text into a Matroska file first (mux), and parses that.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

EBML, SEGMENT, INFO, TRACKS, ENTRY, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
SCALE, NUMBER, KIND, CODEC, EACH = 0x2AD7B1, 0xD7, 0x83, 0x86, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, LASTS, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
POINT, CUE_TIME, PLACES, CUE_TRACK, CUE_CLUSTER, CUE_INSIDE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
#: What may stand directly in a Segment, and so ends a Cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACINGS = ("none", "xiph", "fixed", "ebml")
PACKETS = {
    "packet": pa.int64(), "track": pa.int64(), "codec": pa.string(), "cluster": pa.int64(), "timestamp_ns": pa.int64(), "duration_ns": pa.int64(),
    "keyframe": pa.bool_(), "lacing": pa.string(), "lace_index": pa.int64(), "cued": pa.bool_(), "byte_offset": pa.int64(), "byte_length": pa.int64(),
}
SCHEMA = "packet long, track long, codec string, cluster long, timestamp_ns long, duration_ns long, keyframe boolean, lacing string, lace_index long, cued boolean, byte_offset long, byte_length long"


class Damaged(ValueError):
    """The bytes aren't what the format asks for."""


def vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, bool]:
    """The variable-length integer at a place, the place after it, and whether all its bits are ones (an unknown size)."""
    if at >= len(data) or data[at] == 0:
        raise Damaged("no variable-length integer")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Damaged("cut off")
    value, mask = int.from_bytes(data[at : at + n], "big"), (1 << 7 * n) - 1
    return value if marker else value & mask, at + n, value & mask == mask


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, str]]:
    """(id, begin of content, its end, how the end is known) of the elements from at to end. Content that is "cut" off ends at
    `end`; content of "unknown" size too, and its reader tells where to go on by skipping."""
    while at < end:
        name, body, _ = vint(data, at, True)
        size, body, unknown = vint(data, body)
        stop = end if unknown else min(end, body + size)
        skip = yield name, body, stop, "unknown" if unknown else "cut" if body + size > end else "known"
        at = stop if skip is None else skip


def number(data: bytes, a: int, b: int) -> int:
    """An unsigned integer of up to 8 bytes."""
    if b - a > 8:
        raise Damaged("number longer than 8 bytes")
    return int.from_bytes(data[a:b], "big")


def fits(n: int | None) -> int | None:
    """n, or null if it is beyond 64 bits with a sign."""
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def laces(data: bytes, at: int, end: int, lacing: int) -> tuple[int, list[int]]:
    """Where the first frame of a block begins, and the sizes of its frames."""
    if lacing == 0:
        return at, [end - at]
    if at >= end:
        raise Damaged("lace without a head")
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise Damaged("uneven lace")
        return at, [(end - at) // n] * n
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damaged("lace cut off")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            size, after, _ = vint(data, at)
            if i:
                size += sizes[-1] - ((1 << 7 * (after - at) - 1) - 1)
            sizes.append(size)
            at = after
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise Damaged("lace longer than its block")
    return at, [*sizes, rest]


class File:
    """The tracks, packets and cues of a Matroska file. `error` tells where parsing ended early; what was read before stays."""

    def __init__(self, data: bytes | None):
        self.data, self.error = data or b"", None
        self.scale, self.tracks = 1_000_000, {}  # number -> (type, codec, default duration in ns or None)
        self.packets: list[tuple] = []  # as PACKETS without codec and cued, with the block's relative place in its cluster
        self.cues: list[tuple[int, int | None, int | None, int | None, int]] = []  # time, track, place of the cluster in the segment, place in it, segment
        self.clusters: list[int] = []  # places in their segments
        self.starts: list[int] = []  # where the content of each segment begins
        self.homes: list[int] = []  # of each cluster, the number of its segment
        if not self.data:
            return
        try:
            self.read()
        except Damaged as e:
            self.error = str(e)

    def read(self) -> None:
        d = self.data
        seen = False
        for name, a, b, _ in elements(d, 0, len(d)):
            if name == EBML:
                seen = True
            elif not seen:
                raise Damaged("no EBML head")
            elif name == SEGMENT:
                self.segment(a, b)
        if not seen:
            raise Damaged("no EBML head")

    def segment(self, begin: int, end: int) -> None:
        d, walk, skip = self.data, elements(self.data, begin, end), None
        self.starts.append(begin)
        while True:
            try:
                name, a, b, ends = walk.send(skip)
            except StopIteration:
                return
            skip = None
            if name == INFO:
                for n, x, y, _ in elements(d, a, b):
                    if n == SCALE:
                        self.scale = number(d, x, y)
            elif name == TRACKS:
                for n, x, y, _ in elements(d, a, b):
                    if n == ENTRY:
                        own = {k: (p, q) for k, p, q, _ in elements(d, x, y)}
                        get = lambda k, own=own: number(d, *own[k]) if k in own else None
                        if get(NUMBER) is None:
                            continue
                        codec = d[slice(*own[CODEC])].decode("ascii", "replace").rstrip("\0") if CODEC in own else None
                        self.tracks[get(NUMBER)] = (get(KIND), codec, get(EACH))
            elif name == CLUSTER:
                self.clusters.append(self.head_of(a) - begin)
                self.homes.append(len(self.starts) - 1)
                skip = self.cluster(a, b, ends == "unknown")
            elif name == CUES:
                for n, x, y, _ in elements(d, a, b):
                    if n == POINT:
                        self.cue(x, y)

    def head_of(self, body: int) -> int:
        """Where the Cluster begins whose content begins at body."""
        return next(body - n - 4 for n in range(1, 9) if self.data[body - n - 4 : body - n] == b"\x1f\x43\xb6\x75" and 9 - self.data[body - n].bit_length() == n)

    def cue(self, a: int, b: int) -> None:
        d, time, places = self.data, 0, []
        for n, x, y, _ in elements(d, a, b):
            if n == CUE_TIME:
                time = number(d, x, y)
            elif n == PLACES:
                own = {k: number(d, p, q) for k, p, q, _ in elements(d, x, y) if k in (CUE_TRACK, CUE_CLUSTER, CUE_INSIDE)}
                places.append((own.get(CUE_TRACK), own.get(CUE_CLUSTER), own.get(CUE_INSIDE)))
        self.cues += [(time, *p, len(self.starts) - 1) for p in places]

    def cluster(self, a: int, b: int, unknown: bool) -> int | None:
        d, walk, time, at = self.data, elements(self.data, a, b), 0, a
        for name, x, y, ends in walk:
            if unknown and name in TOP:
                return at
            if ends == "cut" and name in (SIMPLE, GROUP):
                raise Damaged("block cut off")
            if name == SIMPLE:
                self.block(x, y, time, None, bool(d[x + 3] & 0x80) if x + 3 < y else False, at - a)
            elif name == GROUP:
                found, lasts, key = None, None, True
                for n, p, q, _ in elements(d, x, y):
                    if n == BLOCK:
                        found = (p, q)
                    elif n == LASTS:
                        lasts = number(d, p, q)
                    elif n == REFERENCE:
                        key = False
                if found:
                    self.block(*found, time, lasts, key, at - a)
            elif name == TIME:
                time = number(d, x, y)
            at = y
        return None

    def block(self, a: int, b: int, time: int, lasts: int | None, key: bool, inside: int) -> None:
        d = self.data
        track, at, _ = vint(d, a)
        if at + 3 > b:
            raise Damaged("block cut off")
        relative = struct.unpack_from(">h", d, at)[0]
        lacing = d[at + 2] >> 1 & 3
        at, sizes = laces(d, at + 3, b, lacing)
        each = self.tracks.get(track, (None, None, None))[2]
        base = (time + relative) * self.scale
        if lasts is not None and len(sizes) == 1:
            each_lasts = lasts * self.scale
        else:
            each_lasts = each if each is not None else lasts * self.scale // len(sizes) if lasts is not None else None
        step = each if each is not None else each_lasts
        for i, size in enumerate(sizes):
            self.packets.append((track, len(self.clusters) - 1, fits(base if i == 0 else base + i * step if step is not None else None), fits(each_lasts), key, lacing, i, at, size, time + relative, inside))
            at += size

    def table(self) -> dict[str, list]:
        cued = {(t, k, c, s) for t, k, c, _, s in self.cues}
        out: dict[str, list] = {k: [] for k in PACKETS}
        if not self.packets:
            return out
        track, cluster, ts, lasts, key, lacing, lace, at, size, time, _ = map(list, zip(*self.packets, strict=True))
        codec = {k: v[1] for k, v in self.tracks.items()}
        hit, done = [], set()
        for t, k, c, i in zip(time, track, cluster, lace, strict=True):
            mark = (t, k, self.clusters[c], self.homes[c])
            hit.append(i == 0 and mark in cued and mark not in done)
            if hit[-1]:
                done.add(mark)
        columns = (list(range(len(track))), track, [codec.get(k) for k in track], cluster, ts, lasts, key, [LACINGS[x] for x in lacing], lace, hit, at, size)
        return dict(zip(PACKETS, columns, strict=True))


    def cue_table(self) -> dict[str, list]:
        """The index entries: time, track, the cluster (its number; null if no cluster begins there) and its place in the file, the
        block's place in the cluster if told, and the packet that the entry means (null if there is none)."""
        at = {(s, c): i for i, (s, c) in enumerate(zip(self.homes, self.clusters, strict=True))}
        first: dict[tuple, int] = {}
        for i, p in enumerate(self.packets):
            if p[6] == 0:
                first.setdefault((p[0], p[1], p[9]), i)
        out: dict[str, list] = {k: [] for k in CUES_OUT}
        for i, (time, track, place, inside, s) in enumerate(self.cues):
            c = at.get((s, place))
            row = (i, fits(track), fits(time * self.scale), c, fits(self.starts[s] + place) if place is not None else None, fits(inside), first.get((track, c, time)))
            for k, x in zip(CUES_OUT, row, strict=True):
                out[k].append(x)
        return out


CUES_OUT = {"cue": pa.int64(), "track": pa.int64(), "timestamp_ns": pa.int64(), "cluster": pa.int64(), "cluster_offset": pa.int64(), "block_place": pa.int64(), "packet": pa.int64()}
CUE_SCHEMA = "cue long, track long, timestamp_ns long, cluster long, cluster_offset long, block_place long, packet long"


def read_files(spark, path: str) -> DataFrame:
    """(path, media): the files of a folder or pattern, one a row; a file must be below 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("media"))


def _per_file(media: DataFrame, key: str, data: str, table_of, kinds: dict, schema: str) -> DataFrame:
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, x in zip(b.column(0), b.column(1), strict=True):
                t = table_of(File(x.as_py()))
                if n := len(next(iter(t.values()))):
                    yield pa.RecordBatch.from_arrays([pa.repeat(k, n), *(pa.array(t[c], kind) for c, kind in kinds.items())], ["key", *kinds])

    return media.select(F.col(key).alias("key"), F.col(data).alias("media")).mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def cues(media: DataFrame, key: str = "doc_id", data: str = "media") -> DataFrame:
    """A row for each index entry of each file: the key, cue (from 0), track, timestamp_ns, cluster, cluster_offset (of the cluster's
    content's element in the file), block_place and packet, the packet of that track and time in that cluster, as packets numbers it.
    Nulls, damage, repeated rows and empty tables as in packets."""
    return _per_file(media, key, data, File.cue_table, CUES_OUT, CUE_SCHEMA)


def packets(media: DataFrame, key: str = "doc_id", data: str = "media") -> DataFrame:
    """A row for each frame of each file, by byte position: the key, packet (from 0), track, codec, cluster (from 0),
    timestamp_ns, duration_ns, keyframe, lacing, lace_index (place in its lace), cued (an index entry points at it), byte_offset
    and byte_length.

    Null and empty files have no packets, and neither have bytes that don't begin with an EBML head. A damaged file gives the
    packets before the damage; a number of more than 8 bytes is damage. A time or duration that the file doesn't tell is null
    (frames after the first of a lace without a default duration), and so is one beyond 64 bits. Tracks without a number are left out. Each row is parsed alone: repeated rows repeat, an empty table gives no rows, other columns are ignored.
    """
    return _per_file(media, key, data, File.table, PACKETS, SCHEMA)


# --- a small writer, for tests and for the query ---


def coded(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, of the given width if any."""
    width = width or max(1, -(-(n + 1).bit_length() // 7))
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + coded(len(content)) + content


def unsigned(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The content of a block after its head, by one of the four lacings; fixed needs equal sizes."""
    if lacing == 0:
        return frames[0]
    out = bytearray([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if lacing == 1:
        for n in sizes:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif lacing == 3:
        for i, n in enumerate(sizes):
            if not i:
                out += coded(n)
                continue
            step, width = n - sizes[i - 1], 1
            while abs(step) >= (1 << 7 * width - 1) - 1:
                width += 1
            out += coded(step + (1 << 7 * width - 1) - 1, width)
    return bytes(out) + b"".join(frames)


FRAME, PER_LACE, PER_CLUSTER = 192, 6, 24
_HEAD = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + unsigned(0x42F2, 4) + unsigned(0x42F3, 8) + element(0x4282, b"matroska") + unsigned(0x4287, 4) + unsigned(0x4285, 2))
_INFO = element(INFO, unsigned(SCALE, 1_000_000))
_TRACKS = element(TRACKS, element(ENTRY, unsigned(NUMBER, 1) + unsigned(KIND, 17) + element(CODEC, b"S_TEXT/UTF8")) + element(ENTRY, unsigned(NUMBER, 2) + unsigned(KIND, 2) + element(CODEC, b"A_OPUS") + unsigned(EACH, 20_000_000)))
UNKNOWN = b"\x01" + b"\xff" * 7


def mux(text: bytes) -> bytes:
    """A Matroska file whose frames, in order, are the bytes of a text. Blocks take turns: alone on track 1, in a group with a
    duration, and laced by each method on track 2; every second file has a Segment and Clusters of unknown size."""
    frames = [text[i : i + FRAME] for i in range(0, len(text), FRAME)]
    streamed, body, cues, i, turn, clock = len(frames) % 2, bytearray(_INFO + _TRACKS), bytearray(), 0, 0, 0
    while i < len(frames):
        place, start = len(body), clock
        inner, left = bytearray(unsigned(TIME, start)), PER_CLUSTER
        cues += element(POINT, unsigned(CUE_TIME, start) + element(PLACES, unsigned(CUE_TRACK, 1 if turn % 5 < 2 else 2) + unsigned(CUE_CLUSTER, place)))
        while left and i < len(frames):
            way = turn % 5
            take = frames[i : i + (1 if way < 2 else min(PER_LACE, left))]
            lacing = 0 if way < 2 else (1, 2, 3)[way - 2]
            if lacing == 2 and len(take[-1]) != FRAME:
                lacing = 1
            head = coded(1 if way < 2 else 2) + struct.pack(">h", clock - start)
            if way == 1:
                inner += element(GROUP, element(BLOCK, head + b"\0" + laced(take, 0)) + unsigned(LASTS, 20) + (element(REFERENCE, b"\xec") if turn % 2 else b""))
            else:
                inner += element(SIMPLE, head + bytes([0x80 | lacing << 1]) + laced(take, lacing))
            i, left, turn, clock = i + len(take), left - len(take), turn + 1, clock + 20 * len(take)
        body += b"\x1f\x43\xb6\x75" + (UNKNOWN if streamed else coded(len(inner))) + inner
    body += element(CUES, bytes(cues)) if cues else b""
    return _HEAD + b"\x18\x53\x80\x67" + (UNKNOWN if streamed else coded(len(body))) + bytes(body)


def muxed(docs: DataFrame) -> DataFrame:
    """doc_id and media, the text as a Matroska file; null for a null text."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else mux(x) for x in texts.to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, media binary")


def query(spark, sf_dir: str) -> DataFrame:
    return packets(muxed(table(spark, sf_dir, "documents")))


def cue_query(spark, sf_dir: str) -> DataFrame:
    return cues(muxed(table(spark, sf_dir, "documents")))
