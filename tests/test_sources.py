import gzip
import struct

from pyspark.sql import functions as F

from netspark.operators import windows
from netspark.operators.flows import flows, with_flow_id
from netspark.params import RetentionParams
from netspark.sources import captures, exports, packets, tables


def ip_packet(protocol, src, dst, body, version=4):
    head = struct.pack(">BBHHHBBH4s4s", version << 4 | 5, 0, 20 + len(body), 0, 0, 64, protocol, 0, bytes(src), bytes(dst))
    return head + body


def tcp(sport, dport, flags):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0) + b"data"


def capture(frames, order="<", nano=False, link=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for t, frame in frames:
        fraction = round((t % 1) * (1e9 if nano else 1e6))
        out += struct.pack(f"{order}IIII", int(t), fraction, len(frame), len(frame)) + frame
    return out


ETHER = b"\x00" * 12 + b"\x08\x00"
A, B = (10, 0, 0, 1), (10, 0, 0, 2)


def test_capture_folder(spark, tmp_path):
    udp = struct.pack(">HHHH", 53, 5353, 8, 0)
    first = capture(
        [
            (1.5, ETHER + ip_packet(6, A, B, tcp(1000, 80, 0x02))),
            (1.75, ETHER + ip_packet(47, A, B, b"gre tunnel")),
            (2.0, b"\x00" * 12 + b"\x86\xdd" + b"\x60" + b"\x00" * 60),
            (2.25, ETHER + ip_packet(6, B, A, tcp(80, 1000, 0x12))),
        ]
    )
    second = capture([(3.0, ip_packet(17, A, B, udp)), (3.000001, ip_packet(1, B, A, b"\x08\x00ping"))], ">", True, 101)
    (tmp_path / "a.pcap").write_bytes(first)
    (tmp_path / "b.pcap").write_bytes(second)
    rows = captures.decode_captures(spark, str(tmp_path)).orderBy("arrival_seq").collect()
    assert [(r["protocol"], r["src_ip"], r["src_port"], r["dst_port"], r["tcp_flags"]) for r in rows] == [
        (6, "10.0.0.1", 1000, 80, "S"), (6, "10.0.0.2", 80, 1000, "SA"), (17, "10.0.0.1", 53, 5353, None), (1, "10.0.0.2", 0, 0, None),
    ]
    assert [r["ts_us"] for r in rows] == [1_500_000, 2_250_000, 3_000_000, 3_000_001]
    assert (rows[0]["size"], rows[0]["header_size"], rows[0]["payload_size"]) == (58, 20, 38)
    assert flows(with_flow_id(captures.decode_captures(spark, str(tmp_path)))).count() == 3


def block(kind, body, order="<"):
    body += b"\x00" * (-len(body) % 4)
    return struct.pack(f"{order}II", kind, len(body) + 12) + body + struct.pack(f"{order}I", len(body) + 12)


def blocks(frames, order="<"):
    """A capture of typed blocks whose interface counts nanoseconds."""
    out = block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    out += block(1, struct.pack(f"{order}HHI", 1, 0, 0) + struct.pack(f"{order}HHB3x", 9, 1, 9) + struct.pack(f"{order}HH", 0, 0), order)
    for t, frame in frames:
        time = round(t * 10**9)
        out += block(6, struct.pack(f"{order}IIIII", 0, time >> 32, time & 0xFFFFFFFF, len(frame), len(frame)) + frame, order)
        out += block(5, b"statistics", order)
    return out


def test_captures_of_all_kinds_and_broken_ones(spark, tmp_path):
    packet = ETHER + ip_packet(6, A, B, tcp(1000, 80, 0x02))
    later = bytearray(ETHER + ip_packet(17, A, B, b"\xde\xad\xbe\xef more"))
    later[14 + 6 : 14 + 8] = struct.pack(">H", 185)
    snapped = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 40, 1) + struct.pack("<IIII", 9, 0, 48, 1500) + packet[:48]
    (tmp_path / "a.pcapng").write_bytes(blocks([(1.5, packet), (1.75, bytes(later))]))
    (tmp_path / "b.pcapng").write_bytes(blocks([(2.5, packet)], ">"))
    (tmp_path / "c.pcap.gz").write_bytes(gzip.compress(capture([(3.5, packet)])))
    (tmp_path / "d.pcap").write_bytes(snapped)
    (tmp_path / "e.pcap").write_bytes(b"no capture at all")
    (tmp_path / "f.pcap.gz").write_bytes(gzip.compress(capture([(4.5, packet)]))[:-12])
    (tmp_path / "g.pcap").write_bytes(capture([(5.5, packet)])[:-3] + b"")
    rows = captures.decode_captures(spark, str(tmp_path)).orderBy("arrival_seq").collect()
    assert [r["ts_us"] for r in rows] == [1_500_000, 2_500_000, 3_500_000, 9_000_000, 5_500_000]
    assert {(r["src_port"], r["dst_port"]) for r in rows} == {(1000, 80)}
    assert rows[3]["size"] == 48 and rows[0]["size"] == len(packet)
    errors = {r["path"].rsplit("/", 1)[-1] for r in captures.capture_errors(spark, str(tmp_path)).collect()}
    assert errors == {"e.pcap", "f.pcap.gz"}


def test_file_numbers_stay_when_files_arrive(spark, tmp_path):
    packet = ETHER + ip_packet(6, A, B, tcp(1000, 80, 0x02))
    for name, t in (("b.pcap", 2.0), ("d.pcap", 4.0)):
        (tmp_path / name).write_bytes(capture([(t, packet)]))
    names = lambda: spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    numbers = spark.createDataFrame(captures.number_files(names()).collect())
    first = {r["ts_us"]: r["arrival_seq"] for r in captures.decode_captures(spark, str(tmp_path), numbers=numbers).collect()}
    (tmp_path / "a.pcap").write_bytes(capture([(1.0, packet)]))
    again = captures.decode_captures(spark, str(tmp_path), numbers=captures.number_files(names(), numbers))
    second = {r["ts_us"]: r["arrival_seq"] for r in again.collect()}
    assert first.items() <= second.items() and len(set(second.values())) == 3
    assert "binaryFile" in again._jdf.queryExecution().executedPlan().toString()


def test_packets_written_as_captures_come_back(spark, tmp_path):
    rows = [(i, 10**15 + i * 37, (6, 17, 1)[i % 3], "10.0.0.1", "10.0.0.2", 0 if i % 3 == 2 else 1000 + i, 0 if i % 3 == 2 else 80, 60 + i, 20, 40 + i, None if i % 3 else "FA") for i in range(60)]
    df = spark.createDataFrame(rows, captures.PACKETS).repartition(3)
    captures.write_captures(df, str(tmp_path / "x"))
    found = captures.decode_captures(spark, str(tmp_path / "x"), "part-*").drop("arrival_seq")
    assert sorted(map(tuple, found.collect()), key=str) == sorted((r[1:] for r in rows), key=str)


def test_hosts_without_an_address_come_back_from_captures(spark, tmp_path):
    """Client numbers beyond 65 535 give texts like 10.0.360.1, which no IPv4 header can hold."""
    rows = [(1_000_000, 6, "10.0.360.1", "192.168.1.2", 1, 22, 60, "S"), (2_500_001, 17, "192.168.1.2", "printer", 53, 9, 48, None),
            (3_000_000, 1, "240.0.0.1", "255.255.255.255", 0, 0, 40, None), (4_000_000, 6, "printer", "10.0.360.1", 2, 3, 61, "FA")]
    columns = "ts_us bigint, protocol int, src_ip string, dst_ip string, src_port int, dst_port int, size int, tcp_flags string"
    df = spark.createDataFrame(rows, columns).coalesce(1)
    captures.write_captures(df, str(tmp_path / "named"))
    got = captures.decode_captures(spark, str(tmp_path / "named"), "part-*").select(*df.columns).collect()
    assert sorted(map(tuple, got)) == rows


def test_packet_files_and_audit(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([(1.5, ETHER + ip_packet(6, A, B, tcp(1, 2, 0x02)))]))
    rows = captures.decode_captures(spark, str(tmp_path))
    rows.write.json(str(tmp_path / "j"))
    assert packets.read_packets(spark, str(tmp_path / "j"), "json").collect() == rows.collect()
    tables.append_audit(spark.createDataFrame([("block", "x")], "action string, ip string"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 1


def test_evidence_by_day(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("b", 86_400_000_000), ("c", 86_400_000_001)], "evidence_id string, ts_us bigint")
    tables.append_evidence(df, str(tmp_path / "e"))
    tables.append_evidence(df, str(tmp_path / "e"))
    day = tables.read_evidence(spark, str(tmp_path / "e")).filter("event_date = date'1970-01-02'")
    assert day.count() == 4 and "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()


def test_retention_rewrites_old_days_only(spark, tmp_path):
    day, path = 86_400_000_000, str(tmp_path / "e")
    rows = [("n1", 0, "NORMAL", "a"), ("n2", 5 * day, "NORMAL", None), ("a1", 5 * day, "ATTACK", "a"), ("a2", 6 * day, "ATTACK", "b"), ("n3", 99 * day, "NORMAL", "a")]
    df = spark.createDataFrame(rows, "evidence_id string, ts_us bigint, verdict string, src_ip string")
    tables.append_evidence(df, path)
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "e" / "event_date=1970-04-10").iterdir()}
    incidents = spark.createDataFrame([("a", "OPEN"), ("b", "RESOLVED")], "key string, status string")
    gone = tables.rewrite_evidence(spark, path, incidents, 100 * day, RetentionParams())
    assert gone == ["1970-01-01", "1970-01-07"]
    assert {r["evidence_id"] for r in tables.read_evidence(spark, path).collect()} == {"a1", "n3"}
    assert untouched == {f: f.stat().st_mtime_ns for f in (tmp_path / "e" / "event_date=1970-04-10").iterdir()}
    recent = windows.evidence_buffer(tables.read_evidence(spark, path).withColumn("arrival_seq", F.col("ts_us")))
    assert [r["evidence_id"] for r in recent.collect()] == ["n3"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, f"line {i}") for i in range(50)], "section int, place int, line string")
    exports.write_ordered_lines(df, str(tmp_path / "lines"), "section", "place")
    got = []
    for part in sorted((tmp_path / "lines").glob("part-*")):
        got += part.read_text().splitlines()
    assert got == [f"line {i}" for i in sorted(range(50), key=lambda i: (i % 3, i))]
    exports.write_csv(spark.createDataFrame([("a", None)], "x string, y string").coalesce(1), str(tmp_path / "csv"))
    assert [p.read_text() for p in (tmp_path / "csv").glob("part-*")] == ["x,y\na,\n"]
