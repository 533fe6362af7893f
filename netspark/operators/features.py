"""The flow feature vector: one grouped aggregate, no window.

Which endpoint opened a flow is only known per flow, so every directional statistic
is aggregated for both ends of the key ("a" and "b") and the pair is swapped once
the opening packet is known. All aggregates combine map-side, so an elephant flow
costs its reducer one partial row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.operators.flows import FLOW, KEY, flow_identity, name_flow, sessions_in_place, with_flow_id, with_flow_key
from netspark.params import FlowParams
from netspark.schemas import FEATURE_COLUMNS, IDENTITY_COLUMNS, STALE_MARKER_KEYS
from netspark.session import stage

_FLAGS = {"syn": "S", "ack": "A", "fin": "F", "rst": "R", "psh": "P", "urg": "U"}


def _one_end(end: str, test: Column) -> list[Column]:
    size, header = F.when(test, F.col("size")), F.when(test, F.col("header_size"))
    columns = [
        F.count_if(test).alias(f"{end}_packets"),
        F.coalesce(F.sum(size), F.lit(0)).alias(f"{end}_bytes"),
    ]
    for name, value in (("pkt_len", size), ("header_len", header)):
        columns += [
            F.avg(value).alias(f"{end}_{name}_mean"),
            F.max(value).alias(f"{end}_{name}_max"),
            F.min(value).alias(f"{end}_{name}_min"),
            F.stddev_samp(value).alias(f"{end}_{name}_std"),
        ]
    return columns


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def flow_features(sessions: DataFrame, params: FlowParams = FlowParams()) -> DataFrame:
    """Identity, span and the feature columns of every flow with enough packets."""
    same_end = (F.col("ip_a") == F.col("ip_b")) & (F.col("port_a") == F.col("port_b"))
    from_a = F.col("from_a") | same_end
    gap = F.col("gap_us") / F.lit(1e6)
    grouped = sessions.groupBy(*FLOW, *[c for c in ("piece",) if c in sessions.columns]).agg(
        *flow_identity(),
        *_one_end("a", from_a),
        *_one_end("b", ~from_a),
        F.sum("size").alias("total_bytes"),
        F.avg(gap).alias("iat_mean"),
        F.max(gap).alias("iat_max"),
        F.min(gap).alias("iat_min"),
        F.stddev_samp(gap).alias("iat_std"),
        *[F.count_if(F.col("tcp_flags").contains(letter)).alias(f"{n}_count") for n, letter in _FLAGS.items()],
        F.count("tcp_flags").alias("_flagged"),
        F.avg("payload_size").alias("avg_payload_size"),
        F.avg((F.col("payload_size") == 0).cast("double")).alias("zero_payload_ratio"),
    )
    named = name_flow(grouped.filter(F.col("total_packets") >= params.min_packets))

    def oriented(stat: str, forward: bool) -> Column:
        a, b = F.col(f"a_{stat}"), F.col(f"b_{stat}")
        opened_by_a = F.col("_first_from_a") | same_end
        return F.when(opened_by_a, a if forward else b).otherwise(b if forward else a)

    duration = F.greatest((F.col("last_us") - F.col("start_us")) / F.lit(1e6), F.lit(1e-6))
    columns = {
        "duration_seconds": duration,
        "fwd_packets": oriented("packets", True),
        "bwd_packets": oriented("packets", False),
        "fwd_bytes": oriented("bytes", True),
        "bwd_bytes": oriented("bytes", False),
        "bytes_per_second": F.col("total_bytes") / duration,
        "packets_per_second": F.col("total_packets") / duration,
        "bwd_fwd_packet_ratio": _ratio(oriented("packets", False), oriented("packets", True)),
        "fwd_packet_share": _ratio(oriented("packets", True), F.col("total_packets")),
        "iat_cv": F.coalesce(F.when(F.col("iat_mean") > 0, F.coalesce("iat_std", F.lit(0.0)) / F.col("iat_mean")), F.lit(0.0)),
        "syn_ratio": _ratio(F.col("syn_count"), F.col("_flagged")),
        "ack_ratio": _ratio(F.col("ack_count"), F.col("_flagged")),
        "is_well_known_dst_port": (F.col("dst_port") < 1024).cast("int"),
    }
    for stat in ("mean", "max", "min", "std"):
        for direction, forward in (("fwd", True), ("bwd", False)):
            for measure in ("pkt_len", "header_len"):
                value = oriented(f"{measure}_{stat}", forward).cast("double")
                columns[f"{direction}_{measure}_{stat}"] = F.coalesce(value, F.lit(0.0))
        columns[f"iat_{stat}"] = F.coalesce(F.col(f"iat_{stat}"), F.lit(0.0))
    features = [columns.get(c, F.col(c)).alias(c) for c in FEATURE_COLUMNS]
    return named.select(
        "flow_id", "finish_seq", *IDENTITY_COLUMNS, "start_us", "last_us", "finished_cleanly", *features
    )


def packet_features(packets: DataFrame, params: FlowParams = FlowParams()) -> DataFrame:
    """The features of packets whose flows are not yet known: flows of nearly all keys are grouped where their packets lie."""
    parts = sessions_in_place(packets, ("size", "header_size", "payload_size", "tcp_flags"), params)
    return reduce(DataFrame.unionByName, [flow_features(part, params) for part in parts])


#: Longest flow whose gaps are folded one after another; a longer one keeps the sums of its parts.
ORDERED_PACKETS = 100_000


def _near_edge(name: str, digits: int) -> Column:
    """Whether the order of additions can decide the last of ``digits`` digits of a timing feature."""
    scale = F.lit(10.0**digits)
    size = F.lit(1.0) + F.col(name) if name == "iat_cv" else F.col("iat_max")
    error = (F.col("total_packets") + 8) * F.lit(2.0**-50) * size * scale
    scaled = F.col(name) * scale
    return F.abs(scaled - F.floor(scaled) - 0.5) <= error


def timing_in_arrival_order(
    flows: DataFrame, packets: DataFrame, digits: dict[str, int], params: FlowParams = FlowParams()
) -> DataFrame:
    """The flows with ``iat_mean``, ``iat_std`` and ``iat_cv`` fit to be printed with ``digits`` digits.

    Partial sums of doubles depend on how packets were dealt, which shows where a value lies on a rounding edge.
    The gaps of such flows, and of no others, are summed again one by one in arrival order.
    """
    near = F.lit(False)
    for name, places in digits.items():
        near = near | _near_edge(name, places)
    near = F.coalesce(near & (F.col("total_packets") <= ORDERED_PACKETS), F.lit(False))
    edge = stage(flows.filter(near), "timing-edges")
    theirs = with_flow_key(packets).join(with_flow_key(edge).select(*KEY).distinct(), KEY, "left_semi")
    gaps = F.array_sort(F.collect_list(F.when(F.col("gap_us").isNotNull(), F.struct("arrival_seq", "gap_us"))))
    grouped = with_flow_id(theirs.select(*packets.columns), params).groupBy(*FLOW).agg(
        F.min("arrival_seq").alias("flow_id"), gaps.alias("_gaps")
    )

    def add(held: Column, gap: Column) -> Column:
        x, n = gap["gap_us"] / F.lit(1e6), held["n"] + 1
        mean = held["mean"] + (x - held["mean"]) / n
        return F.struct(
            n.alias("n"), (held["total"] + x).alias("total"), mean.alias("mean"),
            (held["spread"] + (x - mean) * (x - held["mean"])).alias("spread"),
        )

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "total", "mean", "spread")])
    folded = grouped.join(edge.select("flow_id"), "flow_id", "left_semi").select(
        "flow_id", F.aggregate("_gaps", zero, add).alias("_f")
    )
    n, mean = F.col("_f.n"), F.when(F.col("_f.n") > 0, F.col("_f.total") / F.col("_f.n")).otherwise(F.lit(0.0))
    std = F.when(n > 1, F.sqrt(F.col("_f.spread") / (n - 1))).otherwise(F.lit(0.0))
    timing = folded.select("flow_id", mean.alias("iat_mean"), std.alias("iat_std"))
    timing = timing.withColumn("iat_cv", F.when(F.col("iat_mean") > 0, F.col("iat_std") / F.col("iat_mean")).otherwise(F.lit(0.0)))
    mended = edge.drop("iat_mean", "iat_std", "iat_cv").join(timing, "flow_id").select(*flows.columns)
    return flows.filter(~near).unionByName(mended)


def schema_version(keys: Column) -> Column:
    """Short fingerprint of a feature key list."""
    return F.substring(F.sha2(F.array_join(F.array_sort(keys), ","), 256), 1, 12)


def current_schema_version() -> Column:
    return schema_version(F.array(*[F.lit(c) for c in FEATURE_COLUMNS]))


def feature_keys(all_features: Column) -> Column:
    """Sorted non-identity keys of a stored JSON feature object."""
    identity = F.array(*[F.lit(c) for c in IDENTITY_COLUMNS])
    return F.array_sort(F.array_except(F.json_object_keys(all_features), identity))


def is_current_schema(all_features: Column) -> Column:
    return feature_keys(all_features) == F.array(*[F.lit(c) for c in sorted(FEATURE_COLUMNS)])


def is_stale(all_features: Column) -> Column:
    markers = F.array(*[F.lit(c) for c in STALE_MARKER_KEYS])
    return F.size(F.array_except(markers, F.json_object_keys(all_features))) > 0
