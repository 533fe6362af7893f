"""Packets to bidirectional flows.

A flow key is the pair of endpoints in (ip text, port) order plus the protocol. In
arrival order a packet opens a flow when its key has none open, and a packet with F
or R among its flags is the last of its flow. A flow is therefore numbered by how
many closing packets its key has seen before, which is one ``scan`` over the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.operators.scan import SEQUENCE_CHUNKS, Running, scan
from netspark.params import FlowParams

KEY = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]
FLOW = [*KEY, "session_no"]

# Leftover flows come after every flow that closed itself.
_LEFTOVER = 1 << 59


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add the endpoint pair in canonical order, and whether the packet leaves the first of it."""
    same_ip = F.col("src_ip") == F.col("dst_ip")
    from_a = (F.col("src_ip") < F.col("dst_ip")) | (same_ip & (F.col("src_port") <= F.col("dst_port")))

    def end(forward: str, backward: str) -> Column:
        return F.when(F.col("from_a"), F.col(forward)).otherwise(F.col(backward))

    return packets.withColumn("from_a", from_a).select(
        "*",
        end("src_ip", "dst_ip").alias("ip_a"),
        end("src_port", "dst_port").alias("port_a"),
        end("dst_ip", "src_ip").alias("ip_b"),
        end("dst_port", "src_port").alias("port_b"),
    )


def closes(flags: Column) -> Column:
    return F.coalesce(flags.contains("F") | flags.contains("R"), F.lit(False))


def with_flow_id(packets: DataFrame, params: FlowParams = FlowParams()) -> DataFrame:
    """Add key, ``session_no``, ``opens`` (first packet of its flow) and ``gap_us`` to each packet.

    ``gap_us`` is the time since the previous packet of the same flow in arrival
    order, never negative, null on the first packet.
    """
    return _sessions(_keyed(packets), KEY, SEQUENCE_CHUNKS, params)


def _keyed(packets: DataFrame) -> DataFrame:
    return with_flow_key(packets).withColumn("closes", closes(F.col("tcp_flags")).cast("int"))


def _sessions(
    keyed: DataFrame, keys: list[str], widths: tuple[int, ...], params: FlowParams, also: tuple[str, ...] = ()
) -> DataFrame:
    before = scan(
        keyed,
        keys,
        "arrival_seq",
        {
            "closed_before": Running("sum", "closes", inclusive=False),
            "prev_closes": Running("last", "closes", inclusive=False),
            "prev_ts": Running("last", "ts_us", inclusive=False),
        },
        widths,
        also=also,
    )
    follows_close = F.coalesce(F.col("prev_closes") == 1, F.lit(True))
    if params.idle_timeout_us is None:
        sessions = before.withColumn("opens", follows_close).withColumnRenamed("closed_before", "session_no")
    else:
        idle = F.col("ts_us") - F.col("prev_ts") >= params.idle_timeout_us
        flagged = before.withColumn("opens", follows_close | F.coalesce(idle, F.lit(False)))
        flagged = flagged.withColumn("_opened", F.col("opens").cast("int")).drop("closed_before")
        sessions = scan(
            flagged, keys, "arrival_seq", {"session_no": Running("sum", "_opened")}, widths
        ).drop("_opened")
    gap = F.when(~F.col("opens"), F.greatest(F.col("ts_us") - F.col("prev_ts"), F.lit(0)))
    return sessions.withColumn("gap_us", gap).drop("prev_closes", "prev_ts")


def sessions_in_place(packets: DataFrame, also: tuple[str, ...], params: FlowParams = FlowParams()) -> list[DataFrame]:
    """The rows of ``with_flow_id`` as two tables: of keys within one chunk of arrival numbers, and of all others.

    The first, nearly all, are dealt once by key and chunk (``piece``). Nothing is carried into a chunk, and whole
    flows are grouped where they lie. Rows have the key, ``from_a``, ``closes``, ``arrival_seq``, ``ts_us`` and the columns
    ``also``; where all of these are used, there is one exchange of the packets.
    """
    keyed = _keyed(packets).select(*KEY, "from_a", "closes", "arrival_seq", "ts_us", *also)
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*KEY, "arrival_seq")])
    by = [*KEY, "piece"]
    dealt = keyed.filter(complete).withColumn("piece", F.expr(f"arrival_seq div {SEQUENCE_CHUNKS[0]}L"))
    dealt = dealt.filter("piece is not null").repartition(*by)
    # Reading every column, this has the rows' own exchange.
    pieces = dealt.groupBy(*by).agg(F.max(F.hash(*keyed.columns)).alias("_all")).filter("_all is not null").select(*by)
    several = pieces.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).filter("_n > 1")
    # Rows are not sorted for a join that nearly none of them meets; an anti or semi join would go below the exchange.
    several = several.hint("shuffle_hash")
    whole = _sessions(dealt.join(several, by, "left").filter("_n is null").drop("_n"), by, (), params)
    cut = dealt.join(several, by).select(*keyed.columns).unionByName(keyed.filter(~complete))
    return [whole, _sessions(cut, KEY, SEQUENCE_CHUNKS, params, tuple(keyed.columns))]


def started_flows(packets: DataFrame, params: FlowParams = FlowParams()) -> DataFrame:
    """``new_flow_events`` of packets whose flows are not yet known."""

    def end(forward: str, backward: str) -> Column:
        return F.when(F.col("from_a"), F.col(forward)).otherwise(F.col(backward))

    ends = {"src_ip": end("ip_a", "ip_b"), "dst_ip": end("ip_b", "ip_a"), "dst_port": end("port_b", "port_a")}
    return reduce(DataFrame.unionByName, [new_flow_events(part.withColumns(ends)) for part in sessions_in_place(packets, (), params)])


def with_direction(packets: DataFrame) -> DataFrame:
    """Add ``direction`` per packet: forward iff it leaves the endpoint that opened the flow.

    Only needed to list packets; the flow features derive direction after grouping.
    """
    opener = F.when(F.col("opens"), F.col("from_a").cast("int"))
    known = scan(
        packets.withColumn("_opener", opener),
        KEY,
        "arrival_seq",
        {"_flow_from_a": Running("last", "_opener")},
        SEQUENCE_CHUNKS,
    )
    same_end = (F.col("ip_a") == F.col("ip_b")) & (F.col("port_a") == F.col("port_b"))
    forward = same_end | (F.col("_flow_from_a") == F.col("from_a").cast("int"))
    return known.withColumn("direction", F.when(forward, "forward").otherwise("backward")).drop(
        "_opener", "_flow_from_a"
    )


def flow_identity() -> list[Column]:
    """Aggregates that give a flow its identity, span and finish order.

    Who opened it is told by one flag, as the key holds both ends: with numbers alone the groups are
    hashed in place, where texts would have every packet sorted first.
    """
    return [
        F.min_by("from_a", "arrival_seq").alias("_first_from_a"),
        F.min_by("ts_us", "arrival_seq").alias("start_us"),
        F.max_by("ts_us", "arrival_seq").alias("last_us"),
        F.min("arrival_seq").alias("flow_id"),
        F.max("arrival_seq").alias("_last_seq"),
        (F.max("closes") == 1).alias("finished_cleanly"),
        F.count(F.lit(1)).alias("total_packets"),
    ]


def name_flow(grouped: DataFrame) -> DataFrame:
    """Expand the identity aggregates. ``finish_seq`` orders flows as a replay reports them:
    self-closed flows by their last packet, then the rest by their first."""
    finish = F.when(F.col("finished_cleanly"), F.col("_last_seq")).otherwise(
        F.lit(_LEFTOVER).cast("bigint") + F.col("flow_id")
    )

    def end(forward: str, backward: str) -> Column:
        return F.when(F.col("_first_from_a"), F.col(forward)).otherwise(F.col(backward))

    return grouped.withColumns(
        {
            "src_ip": end("ip_a", "ip_b"),
            "dst_ip": end("ip_b", "ip_a"),
            "src_port": end("port_a", "port_b"),
            "dst_port": end("port_b", "port_a"),
            "finish_seq": finish,
        }
    )


def flows(sessions: DataFrame) -> DataFrame:
    """One row per flow, single-packet flows included."""
    grouped = sessions.groupBy(*FLOW).agg(*flow_identity())
    return name_flow(grouped).select(
        "flow_id", "finish_seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        "start_us", "last_us", "finished_cleanly", "total_packets",
    )


def new_flow_events(sessions: DataFrame) -> DataFrame:
    """One row per flow creation, taken from the packet that opened it: no grouping."""
    return sessions.filter("opens").select(
        F.col("arrival_seq").alias("flow_id"), "ts_us", "src_ip", "dst_ip", "dst_port"
    )
