"""Counters, gauges and the risk histogram as one long table (metric, labels, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.operators.incidents import attached_evidence, open_incidents, running_risk
from netspark.schemas import TIERS

# ---- fixed values: upper bounds of the risk histogram
RISK_BUCKETS = [0, 10, 25, 40, 50, 65, 80, 90, 100]


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("detector", "verdict").agg(F.count(F.lit(1)).alias("evidence_total"))


def incident_event_counts(bridge: DataFrame) -> DataFrame:
    """Opened: the row that created an incident. Updated: each later attached row."""
    return attached_evidence(bridge).agg(
        F.count_if("is_new").alias("incidents_opened"), F.count_if(~F.col("is_new")).alias("incidents_updated")
    )


def risk_histogram(bridge: DataFrame) -> DataFrame:
    """Cumulative counts of the risk observed after each attached row, per upper bound."""
    score = F.col("risk_score")
    observed = running_risk(bridge).agg(
        *[F.count_if(score <= b).alias(f"le_{b}") for b in RISK_BUCKETS],
        F.count(F.lit(1)).alias("le_inf"),
    )
    pairs = ", ".join(f"'{b}', le_{b}" for b in RISK_BUCKETS) + ", '+Inf', le_inf"
    return observed.selectExpr(f"stack({len(RISK_BUCKETS) + 1}, {pairs}) as (le, observations)")


def tier_counts(bridge: DataFrame) -> DataFrame:
    """Risk assessments by tier, every tier present."""
    counts = running_risk(bridge).agg(*[F.count_if(F.col("risk_tier") == t).alias(t) for t in TIERS])
    pairs = ", ".join(f"'{t}', {t}" for t in TIERS)
    return counts.selectExpr(f"stack({len(TIERS)}, {pairs}) as (risk_tier, assessments)")


def open_gauge(incident_table: DataFrame) -> DataFrame:
    return open_incidents(incident_table).agg(F.count(F.lit(1)).alias("incidents_open"))


def block_action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action", "backend").agg(F.count(F.lit(1)).alias("block_actions"))


def call_counts(reviews: DataFrame) -> DataFrame:
    """Review calls by outcome."""
    outcome = F.when(F.col("available"), "success").otherwise("failed")
    return reviews.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("calls"))


def export_counts(evidence: DataFrame, bridge: DataFrame) -> DataFrame:
    """Export lines by granularity: one per evidence row, one per incident update."""
    sent = F.lit("sent").alias("outcome")
    rows = evidence.agg(F.count(F.lit(1)).alias("exports")).select(F.lit("evidence").alias("granularity"), sent, "exports")
    updates = attached_evidence(bridge).agg(F.count(F.lit(1)).alias("exports"))
    return rows.unionByName(updates.select(F.lit("incident").alias("granularity"), sent, "exports"))


def metrics(evidence: DataFrame, bridge: DataFrame, incident_table: DataFrame, actions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every value as (metric, labels, value); labels are ``k=v`` pairs."""

    def long(df: DataFrame, metric: str, value: str, labels: dict[str, str]) -> DataFrame:
        pairs: list[Column] = [F.concat(F.lit(f"{name}="), F.col(c)) for name, c in labels.items()]
        return df.select(
            F.lit(metric).alias("metric"),
            (F.concat_ws(",", *pairs) if pairs else F.lit("")).alias("labels"),
            F.col(value).cast("bigint").alias("value"),
        )

    events = incident_event_counts(bridge)
    return reduce(
        DataFrame.unionByName,
        [
            long(evidence_counts(evidence), "evidence_total", "evidence_total", {"detector": "detector", "verdict": "verdict"}),
            long(events, "incidents_opened_total", "incidents_opened", {}),
            long(events, "incidents_updated_total", "incidents_updated", {}),
            long(risk_histogram(bridge), "incident_risk_score_bucket", "observations", {"le": "le"}),
            long(tier_counts(bridge), "risk_tier_assessments_total", "assessments", {"tier": "risk_tier"}),
            long(open_gauge(incident_table), "incidents_open_current", "incidents_open", {}),
            long(block_action_counts(actions), "block_actions_total", "block_actions", {"action": "action", "backend": "backend"}),
            long(call_counts(reviews), "llm_calls_total", "calls", {"outcome": "outcome"}),
            long(export_counts(evidence, bridge), "cef_export_total", "exports", {"granularity": "granularity", "outcome": "outcome"}),
        ],
    )
