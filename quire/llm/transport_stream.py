"""Media columns as MPEG transport streams (operator 3).

A payload is stored as 8-bit samples in the elementary packets of one private
stream: 188-byte packets carry a program association table, a program map table
and the elementary packets, each with a time stamp; every few elementary packets
begin at a random-access point with a clock reference. Reading parses the
tables, checks their CRCs and all continuity counters, reassembles the
elementary packets and collects time stamps and random-access points.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe_trie import slices
from quire.llm.tables import text_or_empty

# Fixed values of the format.
PACKET, SYNC, STUFFING = 188, 0x47, 0xFF
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x1000, 0x0100
PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 1, 0x06, 0xBD
CLOCK = 90_000

#: Samples of one elementary packet, samples a second, and elementary packets from one random-access point to the next.
UNIT, RATE, ACCESS_EVERY = 16_384, 8_000, 4
#: The payload's length is a positive multiple of this.
ALIGN = 64
SLICE_BYTES = 2 << 20


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def _table(pid: int, section: bytes) -> bytes:
    section += struct.pack(">I", crc32_mpeg(section))
    packet = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return packet + bytes([STUFFING]) * (PACKET - len(packet))


@lru_cache(1)
def tables() -> bytes:
    """The two table packets: program 1 has one stream of private data."""
    pat = struct.pack(">BHHBBBHH", 0x00, 0xB000 | 13, 1, 0xC1, 0, 0, PROGRAM, 0xE000 | PMT_PID)
    pmt = struct.pack(">BHHBBBHHBHH", 0x02, 0xB000 | 18, PROGRAM, 0xC1, 0, 0, 0xE000 | STREAM_PID, 0xF000, PRIVATE_DATA, 0xE000 | STREAM_PID, 0xF000)
    return _table(PAT_PID, pat) + _table(PMT_PID, pmt)


def _stamp(prefix: int, t: int) -> bytes:
    return struct.pack(">BHH", prefix << 4 | (t >> 30 & 7) << 1 | 1, (t >> 15 & 0x7FFF) << 1 | 1, (t & 0x7FFF) << 1 | 1)


def write(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    import numpy as np

    out, counter = [tables()], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        samples, pts = payload[at : at + UNIT], (at * CLOCK // RATE) & ((1 << 33) - 1)
        access = unit % ACCESS_EVERY == 0
        body = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM, len(samples) + 8, 0x84, 0x80, 5) + _stamp(2, pts) + samples
        if access:  # flags: random access, clock reference
            field_ = struct.pack(">BBIBB", 7, 0x50, pts >> 1, (pts & 1) << 7 | 0x7E, 0)
        else:
            field_ = b""
        first = PACKET - 4 - len(field_)
        if len(body) < first:  # the only packet: its adaptation field fills what the body leaves
            room = PACKET - 4 - len(body)
            field_ = bytes([room - 1]) + (field_[1:] or b"\0")[: room - 1]
            field_ += bytes([STUFFING]) * (room - len(field_))
            first = len(body)
        rest = len(body) - first
        full, last = divmod(rest, PACKET - 4)
        n = 1 + full + (last > 0)
        packets = np.empty((n, PACKET), "u1")
        packets[:, 0] = SYNC
        packets[:, 1], packets[:, 2] = STREAM_PID >> 8, STREAM_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter += n
        data = np.frombuffer(body, "u1")
        if field_:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(field_)] = np.frombuffer(field_, "u1")
        packets[0, PACKET - first :] = data[:first]
        if full:
            packets[1 : 1 + full, 4:] = data[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if last:
            gap = PACKET - 4 - last
            packets[-1, 3] |= 0x20
            packets[-1, 4] = gap - 1
            if gap > 1:
                packets[-1, 5] = 0
                packets[-1, 6 : 4 + gap] = STUFFING
            packets[-1, 4 + gap :] = data[len(data) - last :]
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Media:
    """What a stream holds. ``faults`` counts what doesn't follow the format."""

    payload: bytes = b""
    program: int = -1
    map_pid: int = -1
    stream_pid: int = -1
    stream_type: int = -1
    packets: int = 0
    faults: int = 0
    #: Elementary packets' time stamps, and the clock references (27 MHz).
    stamps: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)
    #: Of each program: its number, the PID of its map, and its streams as (PID, type).
    programs: list[tuple[int, int, list[tuple[int, int]]]] = field(default_factory=list)
    #: Number of the elementary packet at each random-access point, and its offset in the payload.
    access: list[tuple[int, int]] = field(default_factory=list)

    def feature(self) -> str:
        shown = lambda xs: ",".join(map(str, xs))
        return f"program={self.program};pmt={self.map_pid};pid={self.stream_pid};type={self.stream_type};packets={self.packets};pes={len(self.stamps)};pts={shown(self.stamps)};pcr={shown(self.clocks)};access={shown(f'{u}@{o}' for u, o in self.access)};faults={self.faults}"


def _payload(packet: bytes) -> bytes:
    """What a packet carries after its header and adaptation field."""
    if not packet[3] & 0x10:
        return b""
    return packet[4 + (1 + packet[4] if packet[3] & 0x20 else 0) :]


def sections(packets: list[bytes]) -> tuple[list[bytes], int]:
    """The sections of one PID's packets, over as many packets as they take, without their CRCs; and the number of wrong ones."""
    found, wrong, pending = [], 0, None

    def close(data: bytes) -> bytes | None:
        """Cut whole sections off; what is left is the begin of one."""
        nonlocal wrong
        while len(data) >= 3 and data[0] != STUFFING:
            size = 3 + (struct.unpack_from(">H", data, 1)[0] & 0x0FFF)
            if len(data) < size:
                return data
            if size < 12 or _crc(data[:size]) != 0:
                wrong += 1
            else:
                found.append(data[: size - 4])
            data = data[size:]
        return data if data and data[0] != STUFFING else None

    for packet in packets:
        data = _payload(packet)
        if packet[1] & 0x40 and data:  # a pointer to where a section begins
            before, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if pending is not None:
                wrong += close(pending + before) is not None
            pending = close(data)
        elif pending is not None:
            pending = close(pending + data)
    return found, wrong + (pending is not None)


@lru_cache(64)
def _crc(section: bytes) -> int:
    return crc32_mpeg(section)


def continued(rows):
    """Which packets of one PID aren't repetitions, and the number of breaks in their continuity counters.

    A packet may be sent twice; a packet that says so may break continuity.
    """
    import numpy as np

    counters, carries = (rows[:, 3] & 15).astype("i4"), ((rows[:, 3] >> 4) & 1).astype("i4")
    stated = ((rows[:, 3] & 0x20) > 0) & (rows[:, 4] > 0) & ((rows[:, 5] & 0x80) > 0)
    again = np.zeros(len(rows), bool)
    again[1:] = (counters[1:] == counters[:-1]) & (carries[1:] > 0) & (carries[:-1] > 0)
    at = np.flatnonzero(again)
    again[at] = (rows[at, 12:] == rows[at - 1, 12:]).all(axis=1)  # clock references may differ in a repetition
    own = ~again
    breaks = int((((counters[own][1:] - counters[own][:-1] - carries[own][1:]) & 15 != 0) & ~stated[own][1:]).sum())
    return own, breaks


def read(stream: bytes, program: int | None = None) -> Media:
    """Parse a transport stream: tables, continuity, elementary packets, time stamps, clock references, random-access points.

    The payload is that of the first stream of ``program``, or of the first
    program. Of several versions of a table the last one counts. What doesn't
    follow the format is counted as a fault, whatever the bytes are.
    """
    import numpy as np

    media = Media()
    whole = len(stream) // PACKET
    media.faults += int(len(stream) % PACKET > 0)
    packets = np.frombuffer(stream[: whole * PACKET], "u1").reshape(whole, PACKET)
    media.packets = whole
    good = (packets[:, 0] == SYNC) & (packets[:, 1] < 0x80)
    media.faults += int(whole - good.sum())
    pid = (packets[:, 1].astype("i4") & 0x1F) << 8 | packets[:, 2]

    def table(own_pid: int, kind: int) -> list[bytes]:
        rows = packets[good & (pid == own_pid)]
        if not len(rows):
            return []
        own, breaks = continued(rows)
        found, wrong = sections([r.tobytes() for r in rows[own]])
        media.faults += breaks + wrong
        return [s for s in found if s[0] == kind and s[5] & 1]  # those that hold now

    maps: dict[int, int] = {}
    for section in table(PAT_PID, 0x00):
        for at in range(8, len(section) - 3, 4):
            number, to = struct.unpack_from(">HH", section, at)
            if number:
                maps[number] = to & 0x1FFF
    for map_pid in dict.fromkeys(maps.values()):
        streams: dict[int, list[tuple[int, int]]] = {}
        for section in table(map_pid, 0x02):
            if len(section) < 12:  # too short for the length of what describes the program
                media.faults += 1
                continue
            at, own_streams = 12 + (struct.unpack_from(">H", section, 10)[0] & 0x0FFF), []
            while at + 5 <= len(section):
                kind, to, size = struct.unpack_from(">BHH", section, at)
                own_streams.append((to & 0x1FFF, kind))
                at += 5 + (size & 0x0FFF)
            streams[struct.unpack_from(">H", section, 3)[0]] = own_streams
        media.programs += [(number, map_pid, streams.get(number, [])) for number, to in maps.items() if to == map_pid]
    chosen = [p for p in media.programs if program in (None, p[0])][:1]
    if chosen:
        media.program, media.map_pid, streams = chosen[0]
        if streams:
            media.stream_pid, media.stream_type = streams[0]

    own = np.flatnonzero(good & (pid == media.stream_pid))
    if media.stream_pid < 0 or not len(own):
        return media
    rows = packets[own]
    once, breaks = continued(rows)
    media.faults += breaks
    rows = rows[once]
    control, begins = rows[:, 3] >> 4 & 3, (rows[:, 1] & 0x40) > 0
    carries = (control & 1).astype("i4")
    adapted = (control & 2) > 0
    size = np.where(adapted, rows[:, 4].astype("i4") + 1, 0)
    access = adapted & (size > 1) & ((rows[:, 5] & 0x40) > 0)
    for i in np.flatnonzero(adapted & (size > 7) & ((rows[:, 5] & 0x10) > 0)):
        base, low = struct.unpack_from(">IH", rows[i].tobytes(), 6)
        media.clocks.append((base << 1 | low >> 15) * 300 + (low & 0x1FF))
    starts = np.where(carries > 0, np.minimum(4 + size, PACKET), PACKET)
    data = rows[np.arange(PACKET) >= starts[:, None]].tobytes()
    ends = np.cumsum(PACKET - starts)
    begin = np.flatnonzero(begins & (carries > 0))
    parts, total = [], 0
    cuts = [*(ends[begin] - (PACKET - starts[begin])).tolist(), len(data)]
    for number, (i, at, to) in enumerate(zip(begin.tolist(), cuts, cuts[1:])):
        if data[at : at + 3] != b"\0\0\1" or to - at < 9:
            media.faults += 1
            continue
        length, flags, head = struct.unpack_from(">H", data, at + 4)[0], data[at + 7], data[at + 8]
        if flags & 0x80 and (head < 5 or to - at < 14):  # no room for the time stamp that it claims
            media.faults += 1
        elif flags & 0x80:
            a, b, c = struct.unpack_from(">BHH", data, at + 9)
            media.stamps.append((a >> 1 & 7) << 30 | (b >> 1) << 15 | c >> 1)
        if access[i]:
            media.access.append((number, total))
        end = at + 6 + length if length else to
        media.faults += int(end != to)
        parts.append(data[at + 9 + head : end])
        total += len(parts[-1])
    media.payload = b"".join(parts)
    return media


def padded(text: bytes) -> bytes:
    """Bytes 0 appended, up to a positive multiple of ``ALIGN``."""
    return text + bytes(-len(text) % ALIGN or (0 if text else ALIGN))


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(key).alias("__key"), text_or_empty(text).alias("__text"))
    return rows, f"`{key}` {rows.schema['__key'].dataType.simpleString()}"


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, media``: each text's UTF-8 bytes, padded, as a transport stream.

    Null and empty texts are stored as one unit of zeros. Equal texts give equal
    streams; an empty table gives no rows; further columns are ignored.
    """
    rows, kind = _rows(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", SLICE_BYTES):
            texts = part.column("__text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(map(len, texts), pa.int64()), pa.array((write(padded(t)) for t in texts), pa.binary())], names=[key, "n_bytes", "media"])

    return rows.mapInArrow(run, f"{kind}, n_bytes long, media binary")


def describe(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read stored streams ``key, n_bytes, media`` back: digests of payload and stream, and the feature text. A null stream has null results."""
    kind = media.schema[key].dataType.simpleString()
    rows = media.select(F.col(key).alias("__key"), "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        from hashlib import sha256

        for part in slices(batches, "media", SLICE_BYTES):
            streams = part.column("media").to_pylist()
            found = [None if s is None else read(s) for s in streams]
            of = lambda f, kind: pa.array([None if m is None else f(m, s) for m, s in zip(found, streams)], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("__key"), part.column("n_bytes"),
                    of(lambda m, s: len(m.payload), pa.int64()), of(lambda m, s: sha256(m.payload).hexdigest(), pa.string()), of(lambda m, s: zlib.crc32(m.payload[-ALIGN:]), pa.int64()),
                    of(lambda m, s: len(s), pa.int64()), of(lambda m, s: sha256(s).hexdigest(), pa.string()), of(lambda m, s: m.feature(), pa.string()),
                ],
                names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
