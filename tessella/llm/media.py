"""MPEG transport streams: payloads multiplexed into 188-byte packets, and streams taken apart again.

The multiplexer writes a program association table, a program map table and one elementary stream of
private data in PES packets. Each access unit has a presentation time stamp; each `rap_every`-th one
is a random-access point with a clock reference. The demultiplexer trusts nothing: it resynchronises
on 0x47, checks the CRC of both tables, follows the continuity counters of each packet id,
reassembles PES packets and reports access units with time stamps and random-access flags.

A unit that lost packets is reported as damaged, not dropped.

Defined cases: null and empty texts give one padded block; a text of any length is one stream, of as
many access units as it takes; equal texts give equal streams; ids may be null or repeat; an empty
table gives no rows. Null or unreadable media give no access units. Only the named columns are read
(`store_texts`, `digests`), or the others pass through whatever their names (`access_units`, which
puts more underscores before its own where they clash).
"""

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

from tessella.llm.shared import arrow, small_batches, unused
from tessella.llm.words import texts_of

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0, 0x100, 0x101, 1
PRIVATE_DATA = 0x06  # stream type: PES packets of private data
PRIVATE_STREAM = 0xBD  # stream id
BLOCK = 576  # payloads are padded to a multiple of it
UNIT = BLOCK * 64  # bytes of an access unit
TICKS = 3600  # 90 kHz ticks from one unit to the next
RAP_EVERY = 8


def crc_table() -> np.ndarray:
    t = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        t[i] = c & 0xFFFFFFFF
    return t


def crc_mpeg(data: bytes, table: list | np.ndarray | None = None) -> int:
    table, c = crc_table().tolist() if table is None else table, 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ x]
    return c


def section(table_id: int, ext: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, ext, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc_mpeg(head + body))


def section_packets(pid: int, data: bytes, counter: int) -> tuple[bytes, int]:
    """Packets of one section, over as many as it takes, and the next continuity counter."""
    out, body = [], b"\x00" + data
    for at in range(0, len(body), PACKET - 4):
        head = struct.pack(">BHB", SYNC, (0 if at else 0x4000) | pid, 0x10 | counter & 15)
        out.append((head + body[at : at + PACKET - 4]).ljust(PACKET, b"\xff"))
        counter += 1
    return b"".join(out), counter


def pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def pts_value(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


class Muxer:
    """Streams whose tables stand before each random-access point, so that a reader may join there."""

    def __init__(self, unit: int = UNIT, rap_every: int = RAP_EVERY) -> None:
        self.unit, self.rap_every = min(unit, 65_000), rap_every
        pat = section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
        pmt = section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))
        self.tables = [b"".join(section_packets(pid, data, i)[0] for pid, data in ((PAT_PID, pat), (PMT_PID, pmt))) for i in range(16)]

    def __call__(self, payload: bytes) -> bytes:
        """One stream for one payload; an empty payload gives the tables alone."""
        out, counter = [] if payload else [self.tables[0]], 0
        for k, at in enumerate(range(0, len(payload), self.unit)):
            if k % self.rap_every == 0:
                out.append(self.tables[k // self.rap_every & 15])
            part = payload[at : at + self.unit]
            pts = k * TICKS & (1 << 33) - 1
            pes = b"\x00\x00\x01" + struct.pack(">BHBBB", PRIVATE_STREAM, len(part) + 8, 0x80, 0x80, 5) + pts_bytes(pts) + part
            out.append(self.packets(pes, counter, k % self.rap_every == 0, pts))
            counter += len(out[-1]) // PACKET
        return b"".join(out)

    @staticmethod
    def packets(pes: bytes, counter: int, rap: bool, pts: int) -> bytes:
        """All packets of one PES packet: the first may carry the clock, the last is stuffed."""
        clock = struct.pack(">BBIH", 7, 0x50, pts >> 1, (pts & 1) << 15 | 0x7E00) if rap else b""
        room = PACKET - 4 - len(clock)
        if len(pes) < room and rap:
            first = bytes([len(clock) - 1 + room - len(pes)]) + clock[1:] + b"\xff" * (room - len(pes)) + pes
            return struct.pack(">BHB", SYNC, 0x4000 | DATA_PID, 0x30 | counter & 15) + first
        lead = clock + pes[:room] if len(pes) >= room else None
        rest = pes[room:] if lead else pes
        n, tail = divmod(len(rest), PACKET - 4)
        m = np.empty((n, PACKET), np.uint8)
        if n:
            m[:, 4:] = np.frombuffer(rest, np.uint8, n * (PACKET - 4)).reshape(n, -1)
            m[:, 0], m[:, 1], m[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            m[:, 3] = 0x10 | (counter + bool(lead) + np.arange(n)) & 15
        out = struct.pack(">BHB", SYNC, 0x4000 | DATA_PID, (0x30 if rap else 0x10) | counter & 15) + lead if lead else b""
        out += m.tobytes()
        if tail:
            stuff = PACKET - 5 - tail
            field_ = bytes([stuff]) + (b"\x00" + b"\xff" * (stuff - 1) if stuff else b"")
            begins = 0 if lead else 0x4000
            out += struct.pack(">BHB", SYNC, begins | DATA_PID, 0x30 | counter + bool(lead) + n & 15) + field_ + rest[-tail:]
        return out


@dataclass
class Unit:
    pid: int
    stream_type: int
    pts: int | None
    random_access: bool
    damaged: bool
    data: bytes


@dataclass
class Stream:
    packets: int = 0
    lost_sync: int = 0
    bad_tables: int = 0
    gaps: int = 0
    duplicates: int = 0
    programs: dict = field(default_factory=dict)  # program -> packet id of its map
    streams: dict = field(default_factory=dict)  # packet id -> stream type
    units: list = field(default_factory=list)


def aligned(stream: bytes) -> tuple[np.ndarray, int]:
    """Packets as rows, and how often the sync byte was lost and found again."""
    n = len(stream) // PACKET
    whole = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    if len(stream) == n * PACKET and (whole[:, 0] == SYNC).all():
        return whole, 0
    rows, at, lost, locked = [], 0, 0, False
    while at + PACKET <= len(stream):
        if stream[at] == SYNC and (locked or at + PACKET >= len(stream) or stream[at + PACKET] == SYNC):
            rows.append(at)
            at, locked = at + PACKET, True
            continue
        lost += locked or not at
        locked = False
        found = stream.find(b"\x47", at + 1)
        at = found if found >= 0 else len(stream)
    return np.array([np.frombuffer(stream, np.uint8, PACKET, at) for at in rows], np.uint8).reshape(len(rows), PACKET), lost


def sections(rows: np.ndarray, start: np.ndarray, table: list) -> Iterator[tuple[int, bytes] | None]:
    """(table id, body) of the sections of one packet id, None for a broken or cut one.

    A section may begin anywhere behind the pointer of a packet and go on over following ones, as long
    as their counters do; a repeated packet counts once.
    """
    held, last, before = None, -1, b""  # held: bytes of the section at hand; None: wait for a start

    def whole() -> Iterator[tuple[int, bytes] | None]:
        nonlocal held
        while held and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2]) if len(held) >= 3 else 0
            if not size or len(held) < size:
                return
            yield (held[0], held[8 : size - 4]) if size >= 12 and not crc_mpeg(held[:size], table) else None
            held = held[size:]
        held = None

    for row, at in zip(rows, start):
        body, counter, begins = row[at:].tobytes(), int(row[3]) & 15, bool(row[1] & 0x40)
        if not body or counter == last and body == before:
            continue
        if held and last >= 0 and counter != last + 1 & 15:
            yield None
            held = None
        last, before = counter, body
        if begins:
            if held:
                held += body[1 : 1 + body[0]]
                yield from whole()
                if held:
                    yield None
            held = body[1 + body[0] :]
        elif held:
            held += body
        yield from whole()
    if held:
        yield None


def demux(stream: bytes, table: list | None = None) -> Stream:
    table = crc_table().tolist() if table is None else table
    out = Stream()
    rows, out.lost_sync = aligned(stream)
    out.packets = len(rows)
    if not len(rows):
        return out
    pid = (rows[:, 1] & 0x1F).astype(np.int64) << 8 | rows[:, 2]
    start = np.where(rows[:, 3] & 0x20, 5 + rows[:, 4].astype(np.int64), 4)
    start[(rows[:, 3] & 0x10) == 0] = PACKET
    start = np.minimum(start, PACKET)
    for got in sections(rows[pid == PAT_PID], start[pid == PAT_PID], table):
        if got is None or got[0] != 0:
            out.bad_tables += 1
            continue
        for program, p in struct.iter_unpack(">HH", got[1][: len(got[1]) // 4 * 4]):
            if program:
                out.programs[program] = p & 0x1FFF
    for p in sorted(set(out.programs.values())):
        for got in sections(rows[pid == p], start[pid == p], table):
            if got is None or got[0] != 2 or len(got[1]) < 4:
                out.bad_tables += 1
                continue
            b, at = got[1], 4 + ((got[1][2] & 0x0F) << 8 | got[1][3])
            while at + 5 <= len(b):
                out.streams[(b[at + 1] & 0x1F) << 8 | b[at + 2]] = b[at]
                at += 5 + ((b[at + 3] & 0x0F) << 8 | b[at + 4])
    for p, kind in out.streams.items():
        own = np.flatnonzero((pid == p) & (start < PACKET))
        if len(own):
            elementary(rows[own], start[own], p, kind, out)
    return out


def elementary(rows: np.ndarray, start: np.ndarray, pid: int, kind: int, out: Stream) -> None:
    """Continuity and PES packets of one stream."""
    step = np.diff((rows[:, 3] & 15).astype(np.int64)) & 15
    jump = (rows[1:, 3] & 0x20 > 0) & (rows[1:, 4] > 0) & (rows[1:, 5] & 0x80 > 0)  # announced
    twice = np.concatenate([[False], (step == 0) & ~jump & (rows[1:] == rows[:-1]).all(axis=1)])
    gap = np.concatenate([[False], (step != 1) & ~jump]) & ~twice
    out.gaps += int(gap.sum())
    out.duplicates += int(twice.sum())
    rows, start, gap = rows[~twice], start[~twice], gap[~twice]
    begins = np.flatnonzero(rows[:, 1] & 0x40)
    for k, lo in enumerate(begins):
        hi = begins[k + 1] if k + 1 < len(begins) else len(rows)
        flag = bool(rows[lo, 3] & 0x20 and rows[lo, 4] > 0 and rows[lo, 5] & 0x40)
        middle = rows[lo + 1 : hi]
        if len(middle) and (start[lo + 1 : hi - 1] == 4).all():
            pes = rows[lo, start[lo] :].tobytes() + middle[:-1, 4:].tobytes() + middle[-1, start[hi - 1] :].tobytes()
        else:
            pes = b"".join(r[s:].tobytes() for r, s in zip(rows[lo:hi], start[lo:hi]))
        damaged = bool(gap[lo + 1 : hi].any()) or (k + 1 < len(begins) and bool(gap[hi]))
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            out.units.append(Unit(pid, kind, None, flag, True, b""))
            continue
        size, skip = pes[4] << 8 | pes[5], 9 + pes[8]
        pts = pts_value(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
        data = pes[skip : 6 + size] if size else pes[skip:]
        out.units.append(Unit(pid, kind, pts, flag, damaged or (bool(size) and len(pes) < 6 + size), data))


def describe(s: Stream) -> str:
    """The stream's features in one line: all its access points by time stamp."""
    times = [u.pts for u in s.units if u.pts is not None]
    raps = [str(u.pts) for u in s.units if u.random_access]
    span = max(times) - min(times) if times else 0
    return f"programs={len(s.programs)};streams={len(s.streams)};packets={s.packets};units={len(s.units)};gaps={s.gaps};damaged={sum(u.damaged for u in s.units)};span={span};access={len(raps)}:{','.join(raps)}"


def pad(text: bytes) -> bytes:
    size = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    return text.ljust(size, b"\xff")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text, padded, as a transport stream.

    Null and empty texts give one padded block; ids may be null or repeat; nothing else is read.
    """
    small_batches(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mux = Muxer()
        for batch in batches:
            off, raw = texts_of(batch.column(1))
            for lo in range(0, batch.num_rows, 256):  # a few texts at once bound the memory
                hi = min(lo + 256, batch.num_rows)
                media = [mux(pad(raw[off[i] : off[i + 1]].tobytes())) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off[lo : hi + 1]), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), over, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def access_units(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row for each access unit: the other columns, and _pid, _stream_type, _unit, _pts, _random_access, _damaged, _data.

    Rows with null or unreadable media give no units.
    """
    others = [c for c in media.columns if c != media_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields if f.name != media_col)
    kinds = {"pid": "int", "stream_type": "int", "unit": "int", "pts": "long", "random_access": "boolean", "damaged": "boolean", "data": "binary"}
    names = [*unused(others, tuple(kinds)).values()]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = crc_table().tolist()
        for batch in batches:
            at = batch.schema.get_field_index(media_col)
            for i in range(batch.num_rows):
                units = demux(batch.column(at)[i].as_py() or b"", table).units
                if units:
                    rest = batch.select(others).take(pa.array([i] * len(units)))
                    own = [pa.array([u.pid for u in units], pa.int32()), pa.array([u.stream_type for u in units], pa.int32()), pa.array(range(len(units)), pa.int32()), pa.array([u.pts for u in units], pa.int64()), pa.array([u.random_access for u in units]), pa.array([u.damaged for u in units]), pa.array([u.data for u in units], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*rest.columns, *own], names=[*others, *names])

    return arrow(media, over, (fields + ", " if fields else "") + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds.values())))


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from (id, n_bytes, media): sizes, digests of payload and media, features."""
    small_batches(media.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = crc_table().tolist()
        for batch in batches:
            rows = []
            for stored in batch.column(2):
                body = stored.as_py() or b""
                s = demux(body, table)
                payload = b"".join(u.data for u in s.units)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(body), hashlib.sha256(body).hexdigest(), describe(s)))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = dict(media.dtypes)[id_col]
    out = arrow(media.select(F.col(id_col).alias("id"), "n_bytes", "media"), over, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
