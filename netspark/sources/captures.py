"""Capture files to packet rows, and packet rows to capture files.

A folder of captures is read file by file, in parallel; each file is decoded whole in
the task that read it. Rotate captures (some hundred MB each) so files spread well. Both
capture formats are read, also when packed with gzip, bzip2 or xz. A file that can't be
read gives no packets and a row in ``capture_errors``; it does not stop the others.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import socket
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netspark.schemas import PACKETS

# ---- fixed values: file magic -> (byte order, fractions per second); link type -> header bytes before IP
MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
}
SECTION, INTERFACE, SIMPLE_PACKET, NAMES_BLOCK, PACKET = 0x0A0D0D0A, 1, 3, 4, 6
SECTION_ORDER = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}
TIME_UNIT_OPTION = 9
IPV4_NAME = 1
# Hosts that have no IPv4 address are written under numbers of this reserved block, which no wire carries, and named.
STAND_IN = 240
PACKED = {b"\x1f\x8b": gzip.decompress, b"BZh": bz2.decompress, b"\xfd7zXZ\x00": lzma.decompress}
LINK_HEADER = {0: 4, 1: 14, 101: 0, 113: 16, 228: 0}
TCP_FLAGS = [(0x01, "F"), (0x02, "S"), (0x04, "R"), (0x08, "P"), (0x10, "A"), (0x20, "U"), (0x40, "E"), (0x80, "C")]
# ---------------------------------------------------------------------------------
NAMES = "*.{pcap,pcapng,cap,dmp}{,.gz,.bz2,.xz}"
#: Bits of arrival_seq for the place in a file; the file's number stands above them, so 2^28 packets a file
#: and 2^28 files leave room for the numbers that operators derive from it.
PLACE_BITS = 28
_COLUMNS = [field.split()[0] for field in PACKETS.split(", ")]
_NUMBERS = [field.split()[0] for field in PACKETS.split(", ") if field.split()[1] in ("bigint", "int")]


def _decode_packet(frame: memoryview, skip: int) -> tuple | None:
    """(protocol, src_ip, dst_ip, src_port, dst_port, size, header, payload, flags) of what was kept of a packet.

    Null when it is not IPv4 TCP, UDP or ICMP, or a later fragment, which has no ports.
    """
    if skip == 14 and len(frame) >= 18 and frame[12:14] == b"\x81\x00":
        skip = 18
    ip = frame[skip:]
    if len(ip) < 20 or ip[0] >> 4 != 4 or (skip >= 14 and skip != 16 and frame[skip - 2 : skip] != b"\x08\x00"):
        return None
    if (ip[6] << 8 | ip[7]) & 0x1FFF:
        return None
    header = (ip[0] & 15) * 4
    protocol, rest = ip[9], ip[header:]
    src, dst = ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20]))
    sport = dport = 0
    flags = None
    if protocol == 6 and len(rest) >= 14:
        sport, dport = struct.unpack(">HH", rest[:4])
        flags = "".join(letter for bit, letter in TCP_FLAGS if rest[13] & bit)
    elif protocol == 17 and len(rest) >= 4:
        sport, dport = struct.unpack(">HH", rest[:4])
    elif protocol != 1:
        return None
    return protocol, src, dst, sport, dport, len(frame), header, max(len(frame) - header, 0), flags


def _link_header(link: int) -> int:
    if link not in LINK_HEADER:
        raise ValueError(f"link type {link} is not supported")
    return LINK_HEADER[link]


def _classic(data: memoryview) -> Iterator[tuple[int, memoryview, int]]:
    """(time in microseconds, frame, bytes before IP) of each packet."""
    order, fractions = MAGIC[bytes(data[:4])]
    if len(data) < 24:
        raise ValueError("the file header is cut short")
    skip, at = _link_header(struct.unpack(f"{order}I", data[20:24])[0]), 24
    while at + 16 <= len(data):
        seconds, fraction, kept, _ = struct.unpack(f"{order}IIII", data[at : at + 16])
        yield seconds * 1_000_000 + fraction * 1_000_000 // fractions, data[at + 16 : at + 16 + kept], skip
        at += 16 + kept


def _blocks(data: memoryview, names: dict[str, str]) -> Iterator[tuple[int, memoryview, int]]:
    """The same of a file of typed blocks; names of stand-in addresses are added to ``names``."""
    at, order, links = 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == struct.pack(">I", SECTION):  # reads the same either way round
            order, links = SECTION_ORDER.get(bytes(data[at + 8 : at + 12]), ""), []
            if not order:
                raise ValueError("a section has no byte order")
        kind, size = struct.unpack(f"{order}II", data[at : at + 8])
        if size < 12:
            raise ValueError("a block is shorter than its frame")
        body = data[at + 8 : at + size - 4]
        if kind == INTERFACE:
            links.append((struct.unpack(f"{order}H", body[:2])[0], _time_units(body[8:], order)))
        elif kind == NAMES_BLOCK:
            names.update(_names(body, order))
        elif kind == PACKET and len(body) >= 20:
            number, high, low, kept, _ = struct.unpack(f"{order}IIIII", body[:20])
            link, units = links[number]
            yield (high << 32 | low) * 1_000_000 // units, body[20 : 20 + kept], _link_header(link)
        elif kind == SIMPLE_PACKET and links:  # has no time
            yield 0, body[4 : 4 + struct.unpack(f"{order}I", body[:4])[0]], _link_header(links[0][0])
        at += size


def _names(records: memoryview, order: str) -> dict[str, str]:
    """The first name of each address of the reserved block; real addresses stay what they are."""
    at, found = 0, {}
    while at + 4 <= len(records):
        kind, size = struct.unpack(f"{order}HH", records[at : at + 4])
        value = bytes(records[at + 4 : at + 4 + size])
        if kind == 0:
            break
        if kind == IPV4_NAME and size > 4 and STAND_IN <= value[0] < 255:
            found.setdefault(".".join(map(str, value[:4])), value[4:].split(b"\x00")[0].decode())
        at += 4 + (size + 3) // 4 * 4
    return found


def _time_units(options: memoryview, order: str) -> int:
    """Time units per second that an interface's options state."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(f"{order}HH", options[at : at + 4])
        if code == TIME_UNIT_OPTION and size:
            value = options[at + 4]
            return 1 << (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def decode_capture(content: bytes, first_seq: int) -> Iterator[tuple]:
    """Packet rows of one capture file, in file order."""
    for magic, unpack in PACKED.items():
        if content[: len(magic)] == magic:
            content = unpack(content)
            break
    data, names = memoryview(content), {}
    if bytes(data[:4]) in MAGIC:
        packets = _classic(data)
    elif data[:4] == struct.pack(">I", SECTION):
        packets = _blocks(data, names)
    else:
        raise ValueError("not a capture file")
    for seq, (ts_us, frame, skip) in enumerate(packets, first_seq):
        packet = _decode_packet(frame, skip)
        if packet is not None:
            protocol, src, dst, *rest = packet
            yield (seq, ts_us, protocol, names.get(src, src), names.get(dst, dst), *rest)


def number_files(names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, number) for every file of ``names`` (path).

    Files of ``known`` (an earlier result) keep their numbers and new ones follow by name, so that
    the numbers of packets, flows and evidence stay what they are when files arrive. One row per file.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy("path")
    if known is None:
        return names.select("path", (F.row_number().over(by_name) - 1).cast("bigint").alias("number"))
    used = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).scalar()
    fresh = names.join(known, "path", "left_anti").select("path", (F.row_number().over(by_name) - 1 + used).cast("bigint").alias("number"))
    return known.select("path", "number").unionByName(fresh)


def _decoded(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Packet rows with their file's path and their place in it; a file that fails gives one row with ``error`` at its end."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    columns = ["path", "error", *_COLUMNS]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    for row in decode_capture(content, 0):
                        rows.append((path, None, *row))
                        if len(rows) == 50_000:
                            yield pd.DataFrame(rows, columns=columns).astype(dict.fromkeys(_NUMBERS, "Int64"))
                            rows = []
                except (ValueError, IndexError, struct.error, OSError, EOFError, lzma.LZMAError) as error:
                    rows.append((path, str(error), *[None] * len(_COLUMNS)))
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype(dict.fromkeys(_NUMBERS, "Int64"))

    return files.select("path", "content").mapInPandas(decode, f"path string, error string, {PACKETS}")


def decode_captures(spark: SparkSession, folder: str, pattern: str = NAMES, numbers: DataFrame | None = None) -> DataFrame:
    """Packets of every readable capture in ``folder``. Arrival order is file number (by name), then place in the file.

    Pass the stored result of ``number_files`` as ``numbers`` to keep numbers when files are added. File contents
    meet the numbers only after decoding, so they never move.
    """
    if numbers is None:
        numbers = number_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path"))
    rows = _decoded(spark, folder, pattern).filter("error is null").join(numbers, "path")
    seq = F.shiftleft("number", PLACE_BITS) + F.col("arrival_seq")
    return rows.withColumn("arrival_seq", seq).select(*_COLUMNS)


def capture_errors(spark: SparkSession, folder: str, pattern: str = NAMES) -> DataFrame:
    """(path, error) of the captures that could not be read, or not to their end."""
    return _decoded(spark, folder, pattern).filter("error is not null").select("path", "error")


def encode_packet(protocol: int, src: str, dst: str, sport: int, dport: int, size: int, flags: str | None) -> bytes:
    """An IPv4 packet of ``size`` bytes, filled up with zeros."""
    if protocol == 6:
        bits = sum(bit for bit, letter in TCP_FLAGS if letter in (flags or ""))
        body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, bits, 0, 0, 0)
    else:
        body = struct.pack(">HHHH", sport, dport, max(size - 20, 8), 0)
    addresses = bytes(map(int, f"{src}.{dst}".split(".")))
    return (struct.pack(">BBHHHBBH", 0x45, 0, size, 0, 0, 64, protocol, 0) + addresses + body).ljust(size, b"\x00")[:size]


def _is_ipv4(host: str) -> bool:
    try:
        return len(socket.inet_pton(socket.AF_INET, host)) == 4
    except (OSError, ValueError):
        return False


def _stand_ins(batch: pd.DataFrame) -> dict[str, str]:
    """A number of the reserved block for every host of a batch that has no IPv4 address, past those in use."""
    hosts = pd.unique(pd.concat([batch["src_ip"], batch["dst_ip"]]))
    others = sorted(h for h in hosts if not _is_ipv4(h))
    used, numbers = set(hosts), (f"{STAND_IN + (n >> 24)}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}" for n in range(1, 15 << 24))
    free = (n for n in numbers if n not in used)
    return {host: next(free) for host in others}


def _block(kind: int, body: bytes) -> bytes:
    body = body.ljust((len(body) + 3) // 4 * 4, b"\x00")
    size = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + size + body + size


def _opening(named: dict[str, str]) -> bytes:
    """What stands before the packets: a classic header, or where hosts are named the blocks that begin a section."""
    if not named:
        return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, 101)
    records = b""
    for host, address in named.items():
        value = bytes(map(int, address.split("."))) + host.encode() + b"\x00"
        records += struct.pack("<HH", IPV4_NAME, len(value)) + value.ljust((len(value) + 3) // 4 * 4, b"\x00")
    section = _block(SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    return section + _block(INTERFACE, struct.pack("<HHI", 101, 0, 1 << 18)) + _block(NAMES_BLOCK, records + bytes(4))


def write_captures(packets: DataFrame, path: str) -> None:
    """Packets as capture files of raw IP under ``path``, one or more per partition, in arrival order within each.

    A host that is no IPv4 address stands under a number of a reserved block and is named in its file, so it comes
    back as it was. Written by Spark's text writer, whose line end after the last packet readers skip.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            named = _stand_ins(batch)
            out = [_opening(named)]
            for row in batch.itertuples(index=False):
                src, dst = named.get(row.src_ip, row.src_ip), named.get(row.dst_ip, row.dst_ip)
                frame = encode_packet(row.protocol, src, dst, row.src_port, row.dst_port, row.frame_size, row.tcp_flags)
                if named:
                    head = struct.pack("<IIIII", 0, row.ts_us >> 32, row.ts_us & 0xFFFFFFFF, len(frame), len(frame))
                    out.append(_block(PACKET, head + frame))
                else:
                    out.append(struct.pack("<IIII", row.ts_us // 1_000_000, row.ts_us % 1_000_000, len(frame), len(frame)) + frame)
            if len(out) > 1:
                yield pd.DataFrame({"file": [b"".join(out)]})

    rows = packets.select("ts_us", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", F.col("size").alias("frame_size"), "tcp_flags")
    files = rows.mapInPandas(encode, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)
