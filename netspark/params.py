"""Operator parameters with their default thresholds.

Times are seconds, as an operator reads them in a report; operators convert to
integer microseconds (``*_us`` properties) before they touch data, because range
logic needs an exact integral key.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FlowParams:
    idle_timeout_seconds: float | None = None  # None = replay: a quiet key stays one flow
    min_packets: int = 2

    @property
    def idle_timeout_us(self) -> int | None:
        return None if self.idle_timeout_seconds is None else int(self.idle_timeout_seconds * 1_000_000)


@dataclass(frozen=True)
class DdosParams:
    window_seconds: float = 10.0
    attack_flows: int = 500
    attack_sources: int = 20
    suspicious_flows: int = 200
    suspicious_sources: int = 10

    @property
    def window_us(self) -> int:
        return int(self.window_seconds * 1_000_000)


@dataclass(frozen=True)
class PortScanParams:
    window_seconds: float = 10.0
    attack_ports: int = 20
    suspicious_ports: int = 8

    @property
    def window_us(self) -> int:
        return int(self.window_seconds * 1_000_000)


@dataclass(frozen=True)
class BruteForceParams:
    window_seconds: float = 60.0
    attack_attempts: int = 15
    suspicious_attempts: int = 5
    watched_ports: tuple[int, ...] = (22, 3389, 21, 23, 3306, 5432)

    @property
    def window_us(self) -> int:
        return int(self.window_seconds * 1_000_000)


@dataclass(frozen=True)
class AnomalyParams:
    warmup_flows: int = 30
    contamination: float = 0.01
    suspicious_score: float = -0.015
    flood_packets_per_second: float = 1000.0
    flood_min_packets: int = 20
    trees: int = 500
    max_samples: int = 256
    seed: int = 42
    min_variance: float = 1e-9
    min_columns: int = 8


@dataclass(frozen=True)
class VerdictParams:
    min_score: float = -0.03
    calls_per_minute: int = 35  # in any trailing ``budget_seconds``
    budget_seconds: float = 60.0
    queue_length: int = 500
    poll_seconds: float = 2.0
    chunk_seconds: float = 3600.0  # folded in one task

    @property
    def budget_us(self) -> int:
        return int(self.budget_seconds * 1_000_000)

    @property
    def poll_us(self) -> int:
        return int(self.poll_seconds * 1_000_000)

    @property
    def chunk_us(self) -> int:
        return int(self.chunk_seconds * 1_000_000)


@dataclass(frozen=True)
class BlockParams:
    duration_minutes: float = 60.0
    escalation_multiplier: float = 3.0
    escalation_max_multiplier: float = 10.0
    whitelist: tuple[str, ...] = ()
    own_addresses: tuple[str, ...] = ("127.0.0.1", "::1")
    block_private_ranges: bool = False
    dry_run: bool = True
    backend: str = "none"


@dataclass(frozen=True)
class AlertParams:
    rate_limit_seconds: float = 600.0

    @property
    def rate_limit_us(self) -> int:
        return int(self.rate_limit_seconds * 1_000_000)


@dataclass(frozen=True)
class TrainingParams:
    min_samples: int = 10
    min_classes: int = 2
    min_per_class: int = 2
    test_share: float = 0.2
    seed: int = 42
    trees: int = 200
    forest_depth: int = 30  # Spark's largest; a tree stops earlier when its leaves are pure
    boosting_rounds: int = 200
    boosting_depth: int = 6
    parallel_classes: int = 8
    sources: tuple[str, ...] = ("llm",)
    retrain_threshold: int = 100


@dataclass(frozen=True)
class RetentionParams:
    bulk_days: float = 7.0
    finding_days: float = 90.0
    samples_per_label: int = 5000


@dataclass(frozen=True)
class EvidenceParams:
    buffer_seconds: float = 300.0


@dataclass(frozen=True)
class ExportParams:
    """Identity fields a SIEM listener sees; set them to your own product."""

    vendor: str = "netspark"
    product: str = "detections"
    version: str = "1.0"
    brand: str = "netspark"


@dataclass(frozen=True)
class Params:
    flow: FlowParams = field(default_factory=FlowParams)
    ddos: DdosParams = field(default_factory=DdosParams)
    port_scan: PortScanParams = field(default_factory=PortScanParams)
    brute_force: BruteForceParams = field(default_factory=BruteForceParams)
    anomaly: AnomalyParams = field(default_factory=AnomalyParams)
    verdict: VerdictParams = field(default_factory=VerdictParams)
    block: BlockParams = field(default_factory=BlockParams)
    alert: AlertParams = field(default_factory=AlertParams)
    training: TrainingParams = field(default_factory=TrainingParams)
    retention: RetentionParams = field(default_factory=RetentionParams)
    export: ExportParams = field(default_factory=ExportParams)
