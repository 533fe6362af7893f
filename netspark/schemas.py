"""Table schemas, the feature column list, and fixed vocabularies."""

from __future__ import annotations

PACKETS = (
    "arrival_seq bigint, ts_us bigint, protocol int, src_ip string, dst_ip string, "
    "src_port int, dst_port int, size int, header_size int, payload_size int, tcp_flags string"
)

NEW_FLOWS = "flow_id bigint, ts_us bigint, src_ip string, dst_ip string, dst_port int"

EVIDENCE = (
    "evidence_id string, arrival_seq bigint, detector string, ts_us bigint, verdict string, "
    "reasoning string, src_ip string, dst_ip string, dst_port int, payload string, attack_type string"
)

ACTIONS = "arrival_seq bigint, key string, action string"

MODEL_VERSIONS = (
    "version string, trained_at string, sample_count int, feature_schema_version string, "
    "model_name string, f1_macro double, promoted boolean"
)

GEO_RANGES = (
    "start_ip bigint, end_ip bigint, country string, country_code string, city string, "
    "latitude double, longitude double, as_text string, org string"
)

# ---- fixed values -------------------------------------------------------------
# Who the flow belongs to; never a model input.
IDENTITY_COLUMNS = ["src_ip", "dst_ip", "src_port", "dst_port"]

# The current flow-feature schema, identity excluded. A stored sample is current
# exactly when its keys equal this set.
FEATURE_COLUMNS = [
    "protocol",
    "duration_seconds", "total_packets", "total_bytes",
    "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes",
    "bytes_per_second", "packets_per_second",
    "bwd_fwd_packet_ratio", "fwd_packet_share",
    "fwd_pkt_len_mean", "fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_std",
    "bwd_pkt_len_mean", "bwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_std",
    "fwd_header_len_mean", "fwd_header_len_max", "fwd_header_len_min", "fwd_header_len_std",
    "bwd_header_len_mean", "bwd_header_len_max", "bwd_header_len_min", "bwd_header_len_std",
    "iat_mean", "iat_max", "iat_min", "iat_std", "iat_cv",
    "syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "urg_count",
    "syn_ratio", "ack_ratio",
    "avg_payload_size", "zero_payload_ratio",
    "is_well_known_dst_port",
]

# Feature keys whose absence marks a stored sample as stale.
STALE_MARKER_KEYS = ["ack_ratio", "fwd_packet_share", "iat_cv"]

# Feature keys a labelled row also carries as real columns.
PROMOTED_COLUMNS = [
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "total_packets", "packets_per_second", "syn_ratio", "zero_payload_ratio",
]

NORMAL, SUSPICIOUS, ATTACK = "NORMAL", "SUSPICIOUS", "ATTACK"
WARMING_UP, UNAVAILABLE = "WARMING_UP", "UNAVAILABLE"

# Order in which a flow's detectors report.
DETECTORS = ["anomaly", "llm", "ddos", "port_scan", "brute_force"]

ATTACK_TYPES = ["port_scan", "syn_flood", "ddos", "brute_force", "data_exfiltration", "benign", "unknown"]
REAL_ATTACK_TYPES = ["port_scan", "syn_flood", "ddos", "brute_force", "data_exfiltration"]
CONFIDENCES = ["high", "medium", "low", "unknown"]
PROMOTING_CONFIDENCES = ["high", "medium"]

AGGREGATE_KEY = "__aggregate__"
OPEN, RESOLVED = "OPEN", "RESOLVED"
TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
# -------------------------------------------------------------------------------
