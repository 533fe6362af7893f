"""Training sets, splits, models, evaluation, and clean-up of labelled rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from netspark.functions.ip import is_multicast_or_broadcast
from netspark.operators import trees
from netspark.operators.features import feature_keys, is_current_schema, is_stale
from netspark.params import TrainingParams
from netspark.schemas import FEATURE_COLUMNS, STALE_MARKER_KEYS
from netspark.session import stage


class NotEnoughData(ValueError):
    pass


def usable_samples(labelled: DataFrame, p: TrainingParams = TrainingParams()) -> DataFrame:
    """Reviewed rows with the current feature schema, of classes with enough rows.

    Class sizes are a grouped count joined back: no class is gathered in one place.
    """
    current = labelled.filter(F.col("label_source").isin(*p.sources) & is_current_schema(F.col("all_features")))
    sizes = current.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= p.min_per_class)
    return current.join(sizes.select("label"), "label", "left_semi")


def training_set(labelled: DataFrame, p: TrainingParams = TrainingParams()) -> DataFrame:
    """The usable samples, or ``NotEnoughData`` with the counts that fall short."""
    reviewed = labelled.filter(F.col("label_source").isin(*p.sources))
    per_label = reviewed.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_current_schema(F.col("all_features"))).alias("current")
    )
    counts = {r["label"]: (r["n"], r["current"]) for r in per_label.collect()}
    total, current = sum(n for n, _ in counts.values()), sum(c for _, c in counts.values())
    classes = [label for label, (_, c) in counts.items() if c > 0]
    enough = [label for label, (_, c) in counts.items() if c >= p.min_per_class]
    if total < p.min_samples:
        raise NotEnoughData(f"{total} labelled samples, {p.min_samples} required")
    if current < p.min_samples:
        raise NotEnoughData(f"{current} current-schema samples ({total - current} stale), {p.min_samples} required")
    if len(classes) < p.min_classes:
        raise NotEnoughData(f"labels {sorted(classes)}: {p.min_classes} required")
    if len(enough) < p.min_classes:
        raise NotEnoughData(f"labels with {p.min_per_class} samples {sorted(enough)}: {p.min_classes} required")
    return usable_samples(labelled, p)


def split_size(samples: int, classes: int, share: float = 0.2) -> int:
    """Test rows: the share (ties to even), at least one per class on either side."""
    size = min(max(classes, round(share * samples)), samples - classes)
    if size < classes:
        raise NotEnoughData(f"{samples} samples cannot be split with every one of {classes} classes on both sides")
    return size


def split_quotas(counts: dict[str, int], share: float = 0.2) -> dict[str, int]:
    """Test rows per class: proportional, at least one, at least one left, summing to ``split_size``."""
    total = sum(counts.values())
    size = split_size(total, len(counts), share)
    exact = {c: n * size / total for c, n in counts.items()}
    quota = {c: min(max(1, int(exact[c])), n - 1) for c, n in counts.items()}
    by_need = sorted(counts, key=lambda c: (quota[c] - exact[c], c))
    while sum(quota.values()) < size:
        for c in by_need:
            if sum(quota.values()) < size and quota[c] < counts[c] - 1:
                quota[c] += 1
    while sum(quota.values()) > size:
        for c in reversed(by_need):
            if sum(quota.values()) > size and quota[c] > 1:
                quota[c] -= 1
    return quota


# Hexadecimal digits a round adds: 4096 buckets a class.
ROUND_DIGITS = 3
DRAW_DIGITS = 32


def smallest_draws(rows: DataFrame, quotas: dict[str, int]) -> dict[str, str]:
    """Per class the prefix of ``draw`` with which its smallest ``quota`` draws end.

    ``rows`` has (label, draw), draws being md5 texts. A round counts, per class, the rows of the open
    bucket by their next digits and goes on in the bucket that holds the quota's end; a class is done when that bucket
    ends with the quota. Counting combines map-side, so a hot class costs at most 4096 rows a map task; no row
    is ranked or moved, and a class of n rows takes about log(n) / log(4096) + 1 rounds.
    """
    open_at, found = {label: ("", n) for label, n in quotas.items()}, {}
    length = 0
    while open_at:
        at = F.create_map(*[F.lit(x) for label, (prefix, _) in open_at.items() for x in (label, prefix)])
        need = F.create_map(*[F.lit(x) for label, (_, n) in open_at.items() for x in (label, n)])
        here = rows.filter(F.substring("draw", 1, length) == F.element_at(at, F.col("label"))) if length else rows
        length += ROUND_DIGITS
        steps = here.groupBy("label", F.substring("draw", 1, length).alias("next")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("label").orderBy("next"))
        ends = steps.withColumn("upto", upto).filter(F.col("upto") >= F.element_at(need, F.col("label")))
        first = ends.groupBy("label").agg(F.min(F.struct("next", "n", "upto")).alias("end"))
        for label, end in first.collect():
            left = open_at[label][1] - (end["upto"] - end["n"])
            if left == end["n"] or length >= DRAW_DIGITS:
                found[label] = end["next"]
                del open_at[label]
            else:
                open_at[label] = (end["next"], left)
    return found


def stratified_split(samples: DataFrame, p: TrainingParams = TrainingParams(), id_column: str = "id") -> DataFrame:
    """Add ``in_test``: per class the quota of rows with the smallest md5 of ``id:seed``.

    The cut of each class is searched in rounds of counts; the rows themselves are compared with it and never
    shuffled. Rows with the same id go to the same side, even where that oversteps the quota. The driver sees a count and a
    cut per class and round.
    """
    counts = {r["label"]: r["n"] for r in samples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.md5(F.concat_ws(":", F.col(id_column).cast("bigint").cast("string"), F.lit(str(p.seed))))
    cuts = smallest_draws(stage(samples.select("label", draw.alias("draw")), "draws"), split_quotas(counts, p.test_share))
    cut = F.element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col("label"))
    return samples.withColumn("in_test", F.substring(draw, F.lit(1), F.length(cut)) <= cut)


def sample_features(labelled: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Stored JSON features as double columns, with id, label and the ``also`` columns."""
    schema = ", ".join(f"`{c}` double" for c in FEATURE_COLUMNS)
    parsed = labelled.withColumn("_f", F.from_json("all_features", schema))
    return parsed.select("id", "label", *(also or []), *[F.col(f"_f.{c}").alias(c) for c in sorted(FEATURE_COLUMNS)])


def with_class_weight(train: DataFrame) -> DataFrame:
    """Add ``weight`` so that every class counts the same in total."""
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.agg(F.sum("_n").alias("total"), F.count(F.lit(1)).alias("classes")).first()
    weighted = sizes.withColumn("weight", F.lit(float(totals["total"])) / (F.col("_n") * F.lit(totals["classes"])))
    return train.join(weighted.select("label", "weight"), "label")


@dataclass
class TrainedModel:
    name: str
    model: object
    labels: list[str]
    f1_macro: float
    other_f1_macro: float
    samples: int


#: Rows a training task takes at least: boosting runs a job per tree level, and on few rows their tasks are all it waits for.
ROWS_PER_TASK = 20_000


def training_tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_TASK))


#: Rows and classes up to which models are grown over rows that a task holds as bins (about 250 bytes a row while they grow).
HELD_ROWS = 2_000_000
HELD_CLASSES = 250


def train_best(labelled: DataFrame, p: TrainingParams = TrainingParams(), held_rows: int = HELD_ROWS) -> TrainedModel:
    """Train a balanced random forest and one-vs-rest gradient boosting; keep the higher macro F1, ties to the forest.

    All rows, trees and rounds are taken. Up to ``held_rows`` tasks grow whole trees by the rules of Spark's learners (`trees`);
    beyond, Spark's learners grow them level by level, over as many tasks as the number of rows asks for.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    # Written once: every training pass reads these columns.
    split = stratified_split(training_set(labelled, p), p)
    rows = stage(sample_features(split, ["in_test"]), "training-rows")
    train, test = rows.filter(~F.col("in_test")), rows.filter("in_test")
    columns = sorted(FEATURE_COLUMNS)
    indexer = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc").fit(rows)
    shared = [
        indexer,
        VectorAssembler(inputCols=columns, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]
    samples, classes = rows.count(), len(indexer.labels)
    weighted = stage(with_class_weight(train).repartition(training_tasks(samples)), "training-weights")
    shaping = Pipeline(stages=shared).fit(weighted)
    if samples <= held_rows and classes <= HELD_CLASSES:
        shaped = shaping.transform(weighted).select("id", "label_index", "weight", vector_to_array("features").alias("values"))
        fitted = [
            ("RandomForest", lambda: trees.fit_forest(shaping, shaped, samples, classes, p.trees, p.forest_depth, p.seed)),
            ("GradientBoosting", lambda: trees.fit_boosting(shaping, shaped, samples, classes, p.boosting_rounds, p.boosting_depth, p.seed)),
        ]
    else:
        fitted = _distributed_learners(shaping, weighted, p)
    results = []
    for name, fit in fitted:
        model = fit()
        results.append((macro_f1(classify(test, model, indexer.labels)), name, model))
    results.sort(key=lambda r: -r[0])  # stable, so a tie keeps the forest
    best, other = results
    return TrainedModel(best[1], best[2], list(indexer.labels), best[0], other[0], samples)


def _distributed_learners(shaping, weighted: DataFrame, p: TrainingParams) -> list[tuple[str, Callable]]:
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier

    forest = RandomForestClassifier(
        numTrees=p.trees, maxDepth=p.forest_depth, seed=p.seed, weightCol="weight", labelCol="label_index", featuresCol="features"
    )
    boosting = OneVsRest(
        classifier=GBTClassifier(maxIter=p.boosting_rounds, maxDepth=p.boosting_depth, seed=p.seed),
        labelCol="label_index", featuresCol="features", parallelism=p.parallel_classes,
    )

    def fit(learner) -> PipelineModel:
        return PipelineModel([shaping, learner.fit(shaping.transform(weighted))])

    return [("RandomForest", lambda: fit(forest)), ("GradientBoosting", lambda: fit(boosting))]


def classify(features: DataFrame, model, labels: list[str]) -> DataFrame:
    """Add ``predicted_label`` and ``probabilities`` (label to share).

    One-vs-rest margins are squashed to (0, 1) and normalised.
    """
    from pyspark.ml.functions import vector_to_array

    def array(name: str) -> Column:
        return F.col(name) if isinstance(scored.schema[name].dataType, ArrayType) else vector_to_array(name)

    ready = features if "label" in features.columns else features.withColumn("label", F.lit(labels[0]))
    scored = model.transform(ready)
    names = F.array(*[F.lit(x) for x in labels])
    if "probability" in scored.columns:
        shares = array("probability")
    else:
        margins = F.transform(array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(margins, F.lit(0.0), lambda a, x: a + x)
        shares = F.transform(margins, lambda m: m / total)
    predicted = F.element_at(names, (F.col("prediction") + 1).cast("int"))
    return scored.select(
        *features.columns, predicted.alias("predicted_label"), F.map_from_arrays(names, shares).alias("probabilities")
    )


def classify_flagged(results: DataFrame, model, labels: list[str]) -> DataFrame:
    """Predictions for flagged flows whose destination is one host."""
    eligible = F.col("verdict").isin("SUSPICIOUS", "ATTACK") & ~is_multicast_or_broadcast(F.col("dst_ip"))
    return classify(results.filter(eligible), model, labels)


# ---- evaluation -----------------------------------------------------------------
def confusion(predictions: DataFrame, truth: str = "label", guess: str = "predicted_label") -> DataFrame:
    return predictions.groupBy(F.col(truth).alias("label"), F.col(guess).alias("predicted_label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) over the union of true and predicted labels; 0 when undefined.

    Works on the confusion counts, which are as many as label pairs.
    """
    sides = F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed")),
        F.struct(F.col("predicted_label").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed")),
    )
    hit = F.when(F.col("label") == F.col("predicted_label"), F.col("n")).otherwise(0)
    flat = matrix.select(hit.alias("hit"), F.posexplode(sides).alias("side", "s"))
    grouped = flat.groupBy(F.col("s.label").alias("label")).agg(
        F.sum("s.support").alias("support"),
        F.sum("s.guessed").alias("guessed"),
        F.sum(F.when(F.col("side") == 0, F.col("hit")).otherwise(0)).alias("hits"),
    )

    def share(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    precision, recall = share(F.col("hits"), F.col("guessed")), share(F.col("hits"), F.col("support"))
    return grouped.select(
        "label", precision.alias("precision"), recall.alias("recall"),
        share(F.col("hits") * 2, F.col("support") + F.col("guessed")).alias("f1"), "support",
    )


def macro_f1(predictions: DataFrame) -> float:
    return float(class_report(confusion(predictions)).agg(F.avg("f1")).first()[0] or 0.0)


# ---- diagnostics and clean-up ---------------------------------------------------
def schema_split(labelled: DataFrame, p: TrainingParams = TrainingParams()) -> DataFrame:
    """(keys, samples, tag) per distinct feature key set of the reviewed rows, most common first."""
    reviewed = labelled.filter(F.col("label_source").isin(*p.sources))
    keys = F.array_join(feature_keys(F.col("all_features")), ",")
    markers = F.array(*[F.lit(k) for k in STALE_MARKER_KEYS])
    grouped = reviewed.groupBy(keys.alias("schema_keys")).agg(F.count(F.lit(1)).alias("samples"))
    names = F.split("schema_keys", ",")
    tag = F.when(F.size(F.array_except(markers, names)) == 0, "current").otherwise("stale")
    return grouped.select(
        "schema_keys", F.size(names).alias("n_keys"), "samples", tag.alias("tag")
    ).orderBy(F.desc("samples"), "schema_keys")


def stale_rows(labelled: DataFrame, p: TrainingParams = TrainingParams()) -> DataFrame:
    return labelled.filter(F.col("label_source").isin(*p.sources) & is_stale(F.col("all_features")))


def stale_report(labelled: DataFrame) -> DataFrame:
    return stale_rows(labelled).agg(
        F.count(F.lit(1)).alias("stale"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest")
    )


def drop_stale(labelled: DataFrame, p: TrainingParams = TrainingParams()) -> DataFrame:
    """The table without stale reviewed rows; write it in place of the old one."""
    return labelled.filter(~(F.col("label_source").isin(*p.sources) & is_stale(F.col("all_features"))))


def multicast_flood_labels(labelled: DataFrame) -> DataFrame:
    """Reviewed rows labelled ddos whose destination is a multicast or broadcast address."""
    return labelled.filter(_multicast_flood())


def drop_multicast_flood_labels(labelled: DataFrame) -> DataFrame:
    return labelled.filter(~_multicast_flood())


def _multicast_flood() -> Column:
    return (
        (F.col("label") == "ddos") & (F.col("label_source") == "llm") & is_multicast_or_broadcast(F.col("dst_ip"))
    )
