"""The tables the registered queries read, built once per session and data folder.

Evidence, incidents, features and labelled rows are stored tables in the product, so
they are staged as Parquet in the shared folder and read back by every query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.functions.ip import is_multicast_or_broadcast
from netspark.operators import anomaly, evidence, flows, incidents, response, training, verdicts, windows
from netspark.operators.features import packet_features
from netspark.params import (
    AlertParams,
    BlockParams,
    BruteForceParams,
    DdosParams,
    FlowParams,
    PortScanParams,
    TrainingParams,
)
from netspark.plans import adapters
from netspark.schemas import FEATURE_COLUMNS, IDENTITY_COLUMNS, STALE_MARKER_KEYS
from netspark.session import small_partitions, stage

HOUR = 3600.0
# Events are minutes apart, so their windows are hours long (FIXTURES.md section 3).
DDOS = DdosParams(6 * HOUR, attack_flows=95, attack_sources=72, suspicious_flows=90, suspicious_sources=68)
PORT_SCAN = PortScanParams(24 * HOUR, attack_ports=6, suspicious_ports=4)
BRUTE_FORCE = BruteForceParams(72 * HOUR, attack_attempts=3, suspicious_attempts=2)
SECONDS = {"ddos": 6 * HOUR, "port_scan": 24 * HOUR, "brute_force": 72 * HOUR}
# Orders of one day start within a second; a source's orders are days apart.
PACKET_DDOS = DdosParams(10.0, attack_flows=11, attack_sources=10, suspicious_flows=10, suspicious_sources=9)
PACKET_SCAN = PortScanParams(720 * HOUR, attack_ports=6, suspicious_ports=4)
PACKET_GUESS = BruteForceParams(2400 * HOUR, attack_attempts=2, suspicious_attempts=1)
BLOCK = BlockParams(block_private_ranges=True, dry_run=False, duration_minutes=2880.0)
ALERT = AlertParams(rate_limit_seconds=3 * 86_400.0)
SCORED_FEATURES = [
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "total_packets", "packets_per_second", "syn_ratio",
    "zero_payload_ratio",
]

_CACHE: dict[tuple[str, str, str], DataFrame | training.TrainedModel] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        small_partitions(spark, [f"{sf_dir}/{name}.parquet" for name in ("events", "orders", "lineitem")])

    def _key(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, self.sf_dir, name

    def _is_stored(self, name: str) -> bool:
        return self._key(name) in _CACHE

    def _staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = self._key(name)
        if key not in _CACHE:
            _CACHE[key] = stage(build(), name)
        return _CACHE[key]

    # ---- from packets -----------------------------------------------------------
    def packets(self) -> DataFrame:
        return self._staged("packets", lambda: adapters.packets(self.spark, self.sf_dir))

    def sessions(self) -> DataFrame:
        return flows.with_flow_id(self.packets())

    def features(self) -> DataFrame:
        if self._is_stored("all_flows"):
            return self._all_flows().filter(F.col("total_packets") >= FlowParams().min_packets)
        return self._staged("features", lambda: packet_features(self.packets()))

    def _all_flows(self) -> DataFrame:
        return self._staged("all_flows", lambda: packet_features(self.packets(), FlowParams(min_packets=1)))

    def started(self) -> DataFrame:
        """The started flows, single packets too, for queries that read features as well: packets are dealt and grouped once for both.

        Where features are stored already, the openings are taken from the packets.
        """
        if self._is_stored("features"):
            return self._staged("started", lambda: flows.started_flows(self.packets()))
        return self._all_flows().select("flow_id", F.col("start_us").alias("ts_us"), "src_ip", "dst_ip", "dst_port")

    def scored_features(self) -> DataFrame:
        """Features with a given score in thousandths, which stands in for a fitted model."""
        given = self.features().withColumn("score", (F.col("total_bytes") % 97 - 60) / F.lit(1000.0))
        return given.withColumn("ts_us", F.col("last_us")).withColumn(
            "verdict", anomaly.anomaly_verdict(F.col("score"))
        )

    def feature_responses(self) -> DataFrame:
        cases = F.array(*[F.lit(c) for c in adapters.RESPONSE_CASES])
        index = F.expr("cast(flow_id div 100 % 10 as int)")
        return self.features().select("flow_id", F.get(cases, index).alias("raw_text"))

    # ---- from events ------------------------------------------------------------
    def new_flows(self) -> DataFrame:
        return self._staged(
            "new_flows", lambda: adapters.new_flows(self.spark, self.sf_dir).withColumn("finish_seq", F.col("flow_id"))
        )

    def scored(self) -> DataFrame:
        return anomaly.with_warmup(adapters.scored_flows(self.spark, self.sf_dir))

    def responses(self) -> DataFrame:
        return adapters.responses(self.spark, self.sf_dir)

    def actions(self) -> DataFrame:
        return adapters.actions(self.spark, self.sf_dir)

    def ddos(self) -> DataFrame:
        return self._staged("ddos", lambda: windows.ddos_windows(self.new_flows(), None, DDOS))

    def port_scan(self) -> DataFrame:
        return self._staged("port_scan", lambda: windows.port_scan_windows(self.new_flows(), None, PORT_SCAN))

    def _port_scan_ports(self) -> DataFrame:
        """For readers of ports and verdicts: the whole table if it is stored already, else one with no target told."""
        if self._is_stored("port_scan"):
            return self.port_scan()
        return self._staged(
            "port_scan_ports",
            lambda: windows.port_scan_windows(self.new_flows(), None, PORT_SCAN, detail=False).select(
                "flow_id", "finish_seq", "ts_us", "src_ip", "verdict", "distinct_ports"
            ),
        )

    def _scan_transitions(self, targets: bool) -> DataFrame:
        """Changes into ATTACK, which are few; only flows that their windows can hold take part in the sweep over targets."""
        moved = windows.verdict_transitions(self._port_scan_ports(), ["src_ip"], "finish_seq")
        if "distinct_targets" in moved.columns:
            return moved
        if not targets:
            return moved.withColumn("distinct_targets", F.lit(None).cast("bigint"))

        def with_targets() -> DataFrame:
            checks = stage(moved.drop("verdict", "distinct_ports"), "scan_changes")
            contacts = windows.contacts_seen(self.new_flows(), checks, PORT_SCAN)
            return windows.port_scan_windows(contacts, checks, PORT_SCAN, detail="targets").drop("confidence_pct")

        return self._staged("scan_transitions", with_targets)

    def brute_force(self) -> DataFrame:
        return self._staged("brute_force", lambda: windows.brute_force_windows(self.new_flows(), BRUTE_FORCE))

    def reviews(self) -> DataFrame:
        unicast = self.scored().filter(~is_multicast_or_broadcast(F.col("dst_ip")))
        return verdicts.reviews(verdicts.candidates(unicast), verdicts.parse_verdicts(self.responses()))

    def _from_flows(self) -> list[DataFrame]:
        return [evidence.from_anomaly(self.scored(), SCORED_FEATURES), evidence.from_reviews(self.reviews())]

    def flow_evidence(self) -> DataFrame:
        """Evidence of the detectors that judge single flows: from the store, or without working out the others'.

        Dealt anew, as the store has it in as few files as there were tasks over the events, and its payloads are long.
        """
        if self._is_stored("evidence"):
            rows = self.evidence().filter("detector in ('anomaly', 'llm')")
        else:
            rows = evidence.evidence(*self._from_flows())
        return rows.select("arrival_seq", "detector", "payload").repartition("arrival_seq")

    def build_evidence(self) -> DataFrame:
        return evidence.evidence(
            *self._from_flows(),
            evidence.from_ddos(self.ddos(), DDOS.window_seconds),
            evidence.from_port_scan(self.port_scan(), PORT_SCAN.window_seconds),
            evidence.from_brute_force(self.brute_force(), BRUTE_FORCE.window_seconds),
        )

    def evidence(self) -> DataFrame:
        """Stored without its ids, which follow from the other columns and are most of its bytes."""
        return evidence.with_id(self._staged("evidence", lambda: self.build_evidence().drop("evidence_id")))

    def bridge(self) -> DataFrame:
        """Correlated and stored without ids and payloads: both would be dealt twice, and no report reads payloads."""
        narrow = self.evidence().drop("evidence_id", "payload")
        return evidence.with_id(self._staged("bridge", lambda: incidents.correlate(narrow, self.actions())))

    def incidents(self) -> DataFrame:
        return self._staged("incidents", lambda: incidents.incidents(self.bridge()))

    def transitions(self, targets: bool = True) -> dict[str, DataFrame]:
        return {
            "ddos": windows.verdict_transitions(self.ddos(), [], "finish_seq"),
            "port_scan": self._scan_transitions(targets),
            "brute_force": windows.verdict_transitions(self.brute_force(), windows.TRIPLE, "finish_seq"),
        }

    def attack_events(self) -> DataFrame:
        return self._staged(
            "attack_events",
            lambda: response.attack_events(flows=self.scored(), windows=SECONDS, **self.transitions()),
        )

    def unblocks(self) -> DataFrame:
        """Operators lift the block of every fourth attacked source a day after its first event."""
        events = self.attack_events().filter(F.col("src_ip") != response.MULTIPLE_SOURCES)
        first = events.groupBy(F.col("src_ip").alias("ip")).agg(F.min("seq").alias("seq"), F.min("ts_us").alias("ts_us"))
        octet = F.expr("try_cast(get(split(ip, '[.]'), 3) as int)")
        return first.filter(octet % 4 == 0).select("ip", (F.col("seq") + 5).alias("seq"), (F.col("ts_us") + 86_400_000_000).alias("ts_us"))

    def block_actions(self) -> DataFrame:
        decided = response.block_decisions(self.attack_events(), BLOCK)
        return response.block_actions(decided, self.unblocks(), BLOCK)

    def packet_evidence(self, detail: bool = True) -> DataFrame:
        """Evidence of four detectors over the packet table, each flow checked at its last packet.

        Without ``detail``, for readers of verdicts, scans are told by their ports alone and rows have no reasoning and payload.
        """
        started = self.started()
        features = self.features()
        checks = features.select("flow_id", "finish_seq", F.col("last_us").alias("ts_us"), "src_ip")
        attempts = checks.join(features.select("flow_id", "dst_ip", "dst_port"), "flow_id")
        scored = features.withColumn("ts_us", F.col("last_us")).withColumn(
            "score", (F.col("total_bytes") % 97 - 60) / F.lit(1000.0)
        )
        judged = anomaly.with_warmup(scored)
        scans = windows.port_scan_windows(started, checks, PACKET_SCAN, detail)
        if not detail:
            untold = {"distinct_targets": "bigint", "scan_start_us": "bigint", "scan_end_us": "bigint", "duration_seconds": "double", "ports_per_second": "double"}
            scans = scans.withColumns({c: F.lit(None).cast(kind) for c, kind in untold.items()})
        rows = evidence.evidence(
            evidence.from_anomaly(judged, IDENTITY_COLUMNS + FEATURE_COLUMNS),
            evidence.from_ddos(windows.ddos_windows(started, checks, PACKET_DDOS), PACKET_DDOS.window_seconds),
            evidence.from_port_scan(scans, PACKET_SCAN.window_seconds),
            evidence.from_brute_force(windows.brute_force_windows(attempts, PACKET_GUESS), PACKET_GUESS.window_seconds),
        )
        return rows if detail else rows.drop("reasoning", "payload")

    # ---- labelled rows ----------------------------------------------------------
    def _flow_labels(self) -> DataFrame:
        """Rows of both flow tables; every sixth order is from before three features existed."""
        labelled = verdicts.label(self.scored_features(), verdicts.parse_verdicts(self.feature_responses()))
        stored = IDENTITY_COLUMNS + FEATURE_COLUMNS
        older = [c for c in stored if c not in STALE_MARKER_KEYS]
        is_old = F.expr("flow_id div 100 % 6 = 0")
        full = verdicts.labelled_rows(labelled.filter(~is_old), stored)
        stale = verdicts.labelled_rows(labelled.filter(is_old), older)
        events = verdicts.label(self.scored(), verdicts.parse_verdicts(self.responses()))
        legacy = verdicts.labelled_rows(events, SCORED_FEATURES).withColumn("id", -1 - F.col("id"))
        return full.unionByName(stale).unionByName(legacy)

    def build_labelled(self, targets: bool = True) -> DataFrame:
        """Rows of both flow tables and of the trackers, whose scans tell no targets without ``targets``."""
        moved = self.transitions(targets)
        trackers = verdicts.tracker_labels(moved["ddos"], moved["port_scan"], moved["brute_force"], SECONDS)
        rank = F.element_at(F.create_map(*[F.lit(x) for x in ("ddos", 2, "port_scan", 3, "brute_force", 4)]), F.col("label"))
        trackers = trackers.withColumn("id", -1_000_000_000 - F.col("id") * 8 - rank)
        return self._flow_labels().unionByName(trackers)

    def labelled(self) -> DataFrame:
        return self._staged("labelled", self.build_labelled)

    def reviewed(self) -> DataFrame:
        """The reviewed rows, all that training reads: of the stored table, or built without the trackers', which nobody reviewed."""
        of_reviewer = F.col("label_source").isin(*TrainingParams().sources)
        if self._is_stored("labelled"):
            return self.labelled().filter(of_reviewer)
        return self._staged("reviewed", lambda: self._flow_labels().filter(of_reviewer))

    def labels(self) -> DataFrame:
        """id, time, label and source of every labelled row: of the stored table, or built without features and targets."""
        columns = ["id", "timestamp", "label", "label_source"]
        if self._is_stored("labelled"):
            return self.labelled().select(*columns)
        return self._staged("labels", lambda: self.build_labelled(targets=False).select(*columns))

    # ---- models -----------------------------------------------------------------
    def best_model(self) -> training.TrainedModel:
        """Trained once per application and folder, at the full size."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "best_model")
        if key not in _CACHE:
            _CACHE[key] = training.train_best(self.reviewed())
        return _CACHE[key]

    def versions(self) -> DataFrame:
        """One model version per day of events, trained on the reviewed rows so far."""
        days = adapters.read(self.spark, self.sf_dir, "events").selectExpr("date_format(ts, 'yyyyMMdd') day", "event_type")
        daily = days.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
        return daily.selectExpr(
            "concat(day, '_000000') version",
            "concat(substr(day, 1, 4), '-', substr(day, 5, 2), '-', substr(day, 7, 2), 'T00:00:00+00:00') trained_at",
            "cast(errors * 10 as int) sample_count",
            "substr(sha2(cast(n as string), 256), 1, 12) feature_schema_version",
            "if(n % 2 = 0, 'RandomForest', 'GradientBoosting') model_name",
            "n % 50 / 50.0D f1_macro",
            "false promoted",
        )
