"""Media columns: MPEG transport streams in binary columns.

Writing: a payload is cut into units, each an elementary packet with a presentation time stamp, on one stream of one program;
transport packets carry program tables, continuity counters, a random-access mark at each unit and stuffing. Reading: the
program association and map tables (with their checksums) lead to the elementary streams, counters are checked, elementary
packets are put together from transport packets, and time stamps and random-access points are kept with the payload. A packet
that was sent twice counts once, lost synchronisation is found again, and a unit that lacks packets is marked.
All of it works on arrays of whole packets. Texts are handled one at a time, however long; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import utf8
from fieldbook.session import ship

# Fixed values of the format.
PACKET, SYNC, PAT_PID = 188, 0x47, 0
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06
CLOCK = 90_000
# Our choice of identifiers and of the payload bytes in a unit, 25 units a second.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT, UNITS_A_SECOND = 16_384, 25


@lru_cache(4096)
def section_crc(section: bytes) -> int:
    """CRC-32 of program sections: polynomial 0x04C11DB7, not reflected, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


def _program_tables() -> bytes:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


_TABLES = _program_tables()


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])


def write_stream(payload: bytes) -> bytes:
    """A transport stream that carries the payload without loss."""
    out, counter = [_TABLES], 0
    for k, a in enumerate(range(0, len(payload), UNIT)):
        own = payload[a : a + UNIT]
        unit = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(own) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(k * CLOCK // UNITS_A_SECOND) + own
        # The first packet has a random-access mark, which takes two bytes; the last is stuffed.
        n = 1 + max(0, -(-(len(unit) - 182) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n) & 15)
        packets[0, 1] |= 0x40
        counter = counter + n & 15
        start = np.full(n, 4)
        start[0] = 6
        start[-1] += n * 184 - 2 - len(unit)
        marked = start > 4
        packets[marked, 3] |= 0x20
        packets[marked, 4] = start[marked] - 5
        packets[start > 5, 5] = 0
        packets[0, 5] = 0x40
        packets[np.arange(PACKET) >= start[:, None]] = np.frombuffer(unit, np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


def _bodies(parts: list[tuple[bool, bytes]], table: int) -> list[bytes]:
    """Bodies of the valid sections of one table; parts: the payloads of its packets, and whether a section starts in each.

    A section may go on in the packets after it, and several may share a packet.
    """
    found, held = [], None
    for starts, data in parts:
        pieces = [data]
        if starts:
            # The first byte says how much still belongs to the section before.
            at = 1 + data[0] if data else 0
            pieces = [data[1:at], data[at:]]
        for k, piece in enumerate(pieces):
            held = piece if k else None if held is None else held + piece
            while held and len(held) >= 3 and held[0] != 0xFF:
                size = 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)
                if len(held) < size:
                    break
                if held[0] == table and size >= 12 and section_crc(held[: size - 4]) == int.from_bytes(held[size - 4 : size], "big"):
                    found.append(held[8 : size - 4])
                held = held[size:]
    return found


def _packets(media: bytes) -> tuple[np.ndarray, int]:
    """(packets, errors): whole packets that start with the sync byte. Bytes between them are skipped, one error for each stretch."""
    n = len(media) // PACKET
    packets = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    if (packets[:, 0] == SYNC).all():
        return packets, int(len(media) % PACKET > 0)
    raw = np.frombuffer(media, np.uint8)
    sync = np.flatnonzero(raw == SYNC)
    sure = lambda p: all(q >= len(raw) or raw[q] == SYNC for q in (p, p + PACKET, p + 2 * PACKET))
    first = lambda low, high: next((int(p) for p in sync[np.searchsorted(sync, low) : np.searchsorted(sync, high)] if sure(p)), None)
    out, errors, at, kept = [], 0, 0, False
    while at + PACKET <= len(raw):
        if raw[at] == SYNC and (kept or sure(at)):
            run = raw[at : len(raw) - (len(raw) - at) % PACKET : PACKET] == SYNC
            many = len(run) if run.all() else int(run.argmin())
            kept, after = True, at + many * PACKET
            # A last packet within which better ones begin is no packet.
            lost = first(after - PACKET + 1, after) if after < len(raw) and not (after + PACKET < len(raw) and sure(after + PACKET)) else None
            many -= lost is not None
            errors += lost is not None
            out.append(raw[at : at + many * PACKET].reshape(many, PACKET))
            at = after if lost is None else lost
            continue
        errors += 1
        if kept and at + PACKET < len(raw) and sure(at + PACKET):  # one packet has lost its sync byte
            at += PACKET
            continue
        found = first(at, len(raw))
        at, kept = (len(raw), False) if found is None else (found, True)
    errors += at < len(raw)
    return np.concatenate([np.zeros((0, PACKET), np.uint8), *out]), errors


def read_stream(media: bytes) -> dict:
    """Payload of all elementary streams, with time stamps, random-access points and the errors that were met.

    units: (time stamp or None, offset in the payload, length, whether it starts at a random-access mark, whether packets are missing
    within it). Stretches without packets, packets marked as damaged, an incomplete last one, what precedes a
    stream's first unit and units that are cut short count as errors; what can be read is. A packet that repeats the one before it
    on its stream is dropped; any other jump of the counter is a break, unless the stream announces it.
    """
    packets, errors = _packets(media)
    n = len(packets)
    damaged = packets[:, 1] & 0x80 > 0
    errors += int(damaged.sum())
    packets = packets[~damaged]
    pid = (packets[:, 1] & 0x1F).astype(np.int64) << 8 | packets[:, 2]
    starts, control, counter = packets[:, 1] & 0x40 > 0, packets[:, 3] >> 4 & 3, packets[:, 3] & 15
    field = control & 2 > 0
    offset = np.where(field, 5 + packets[:, 4].astype(np.int64), 4)
    told = np.where(field & (packets[:, 4] > 0), packets[:, 5], 0)
    marked, announced = told & 0x40 > 0, told & 0x80 > 0
    loaded = (control & 1 > 0) & (offset < PACKET)

    def own_packets(wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Packets of a stream without repeats (equal but for a clock in the first bytes), and by how much the counter jumps to each (0: as it should)."""
        own = np.flatnonzero((pid == wanted) & loaded)
        if len(own) > 1:
            again = np.concatenate([[False], (counter[own[1:]] == counter[own[:-1]]) & (packets[own[1:], 12:] == packets[own[:-1], 12:]).all(1)])
            own = own[~again]
        jump = np.concatenate([[0], (counter[own[1:]].astype(int) - counter[own[:-1]] - 1) & 15]).astype(int)[: len(own)]
        return own, np.where(announced[own], 0, jump)

    def sections(wanted: int, table: int) -> list[bytes]:
        return _bodies([(bool(starts[i]), packets[i, offset[i] :].tobytes()) for i in own_packets(wanted)[0]], table)

    programs = [int.from_bytes(x[i + 2 : i + 4], "big") & 0x1FFF for x in sections(PAT_PID, 0) for i in range(0, len(x) - 3, 4) if x[i : i + 2] != b"\0\0"]
    streams: dict[int, int] = {}
    for program in dict.fromkeys(programs):
        for x in sections(program, 2):
            at = 4 + (int.from_bytes(x[2:4], "big") & 0x0FFF)
            while at + 5 <= len(x):
                streams.setdefault(int.from_bytes(x[at + 1 : at + 3], "big") & 0x1FFF, x[at])
                at += 5 + (int.from_bytes(x[at + 3 : at + 5], "big") & 0x0FFF)
    payload, units, breaks, held = [], [], 0, 0
    for stream in streams:
        own, jump = own_packets(stream)
        breaks += int((jump > 0).sum())
        data = packets[own][np.arange(PACKET) >= offset[own][:, None]].tobytes()
        ends = np.cumsum(PACKET - offset[own])
        first = np.flatnonzero(starts[own])
        errors += int(len(own) > 0 and (not len(first) or first[0] > 0))
        begins = [int(ends[i] - PACKET + offset[own[i]]) for i in first]
        for i, j, a, b in zip(first, [*first, len(own)][1:], begins, [*begins, len(data)][1:], strict=True):
            unit = data[a:b]
            if len(unit) < 9 or unit[:3] != b"\0\0\1":
                errors += 1
                continue
            size = int.from_bytes(unit[4:6], "big")
            body = unit[9 + unit[8] : 6 + size if size else None]
            short = size > len(unit) - 6
            errors += short
            # Missing: a jump inside the unit, or at the next one's start if the unit is short or its length unknown.
            missing = bool((jump[i + 1 : j] > 0).any()) or ((short or not size) and j < len(own) and bool(jump[j] > 0))
            pts = (unit[9] >> 1 & 7) << 30 | unit[10] << 22 | unit[11] >> 1 << 15 | unit[12] << 7 | unit[13] >> 1 if unit[7] & 0x80 and len(unit) > 13 else None
            units.append((pts, held, len(body), bool(marked[own[i]]), missing))
            payload.append(body)
            held += len(body)
    return {"payload": b"".join(payload), "units": units, "packets": n, "streams": len(streams), "breaks": breaks, "errors": errors}


def padded(text: bytes | None, unit: int = 64) -> bytes:
    """The payload of a text: its UTF-8 bytes, then bytes 0 up to a positive multiple of `unit`."""
    text = text or b""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


_READ = pa.struct([("payload", pa.binary()), ("units", pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_()), ("missing", pa.bool_())]))), ("packets", pa.int64()), ("streams", pa.int64()), ("breaks", pa.int64()), ("errors", pa.int64())])
_READ_SQL = "struct<payload:binary,units:array<struct<pts:bigint,offset:bigint,length:bigint,random_access:boolean,missing:boolean>>,packets:bigint,streams:bigint,breaks:bigint,errors:bigint>"


_KEYS = ("pts", "offset", "length", "random_access", "missing")


def _slices(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _read(media: list[bytes | None]) -> pa.Array:
    found = [None if x is None else read_stream(x) for x in media]
    for x in found:
        if x is not None:
            x["units"] = [dict(zip(_KEYS, u, strict=True)) for u in x["units"]]
    return pa.array(found, _READ)


def _muxed(docs: DataFrame, id_col: str, text_col: str, back: bool) -> DataFrame:
    ship(docs.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _slices(batch):
                texts = utf8(part.column(1))
                media = pa.array([write_stream(padded(t)) for t in texts], pa.binary())
                made = [part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), media]
                yield pa.RecordBatch.from_arrays([*made, *([_read(media.to_pylist())] if back else [])], ["id", "n_bytes", "media", "read"][: 3 + back])

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary" + f", read {_READ_SQL}" * back)
    return got.withColumnRenamed("id", id_col)


def mux(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as a transport stream, however long; null is empty. Repeated rows and null ids stay; an empty
    table gives an empty result; other columns don't matter."""
    return _muxed(docs, id_col, text_col, False)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """mux and demux in one pass: (id, n_bytes, media, read), where read comes from the stored bytes alone."""
    return _muxed(docs, id_col, text_col, True)


def demux(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds `read`, what read_stream finds in the media column; null media give null. A column named read is replaced."""
    ship(df.sparkSession)
    df = df.drop("read")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, _read(part.column(media_col).to_pylist())], [*part.schema.names, "read"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, read {_READ_SQL}")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all from the stored bytes read back."""
    read = round_trip(docs, id_col, text_col)
    units = F.col("read.units")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), F.col("read.packets")), F.concat(F.lit("streams="), F.col("read.streams")), F.concat(F.lit("units="), F.size(units)),
        F.concat(F.lit("random_access="), F.size(F.filter(units, lambda u: u["random_access"]))), F.concat(F.lit("pts="), F.array_min(F.transform(units, lambda u: u["pts"])), F.lit("-"), F.array_max(F.transform(units, lambda u: u["pts"]))),
        F.concat(F.lit("breaks="), F.col("read.breaks")), F.concat(F.lit("errors="), F.col("read.errors")),
    )
    payload = F.col("read.payload")
    return read.select(id_col, "n_bytes", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
