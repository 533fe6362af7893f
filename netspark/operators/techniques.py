"""ATT&CK technique tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: (technique, name, tactic) per detector and per reviewed attack type
TECHNIQUES = [
    ("T1498", "Network Denial of Service", "Impact"),
    ("T1046", "Network Service Discovery", "Discovery"),
    ("T1110", "Brute Force", "Credential Access"),
    ("T1110.004", "Credential Stuffing", "Credential Access"),
    ("T1041", "Exfiltration Over C2 Channel", "Exfiltration"),
    ("T1021", "Remote Services", "Lateral Movement"),
    ("T1071", "Application Layer Protocol", "Command and Control"),
    ("T1595", "Active Scanning", "Reconnaissance"),
]
BY_DETECTOR = {"ddos": "T1498", "port_scan": "T1046", "brute_force": "T1110"}
BY_ATTACK_TYPE = {
    "port_scan": "T1046",
    "ddos": "T1498",
    "brute_force": "T1110",
    "credential_stuffing": "T1110.004",
    "data_exfiltration": "T1041",
    "lateral_movement": "T1021",
    "command_and_control": "T1071",
    "reconnaissance": "T1595",
}
# ---------------------------------------------------------------------------------


def technique_table(spark: SparkSession) -> DataFrame:
    """The dimension: (detector, attack_type or null, technique_id, technique_name, tactic)."""
    facts = {t[0]: t for t in TECHNIQUES}
    rows = [(d, None, *facts[t]) for d, t in BY_DETECTOR.items()]
    rows += [("llm", a, *facts[t]) for a, t in BY_ATTACK_TYPE.items()]
    return spark.createDataFrame(
        rows, "detector string, attack_type string, technique_id string, technique_name string, tactic string"
    )


def tag_techniques(evidence: DataFrame) -> DataFrame:
    """Left join to the dimension (eleven rows, so broadcast); anomaly evidence has no technique."""
    dim = technique_table(evidence.sparkSession).select(
        F.col("detector").alias("_d"), F.col("attack_type").alias("_a"), "technique_id", "technique_name", "tactic"
    )
    by_type = F.when(F.col("detector") == "llm", F.col("attack_type"))
    match = (F.col("detector") == F.col("_d")) & by_type.eqNullSafe(F.col("_a"))
    return evidence.join(F.broadcast(dim), match, "left").drop("_d", "_a")


def technique_id(detector: Column, attack_type: Column) -> Column:
    """The same mapping as an expression, for aggregates that need no join."""
    tracker = F.create_map(*[F.lit(x) for pair in BY_DETECTOR.items() for x in pair])
    review = F.create_map(*[F.lit(x) for pair in BY_ATTACK_TYPE.items() for x in pair])
    return F.when(detector == "llm", F.try_element_at(review, attack_type)).otherwise(
        F.try_element_at(tracker, detector)
    )
