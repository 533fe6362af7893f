"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each document has a vector of transformed statistics. For every (lang, source) the minimum covariance determinant is
estimated by concentration steps: the nearest `core` share of the group gives the next mean and covariance, and so on,
until the determinant falls by no more than `least_fall` (in its logarithm) or after `steps` steps. There are two starts, medians with median
deviations and the moments of all rows; the one that ends with the smaller determinant counts. The covariance is then
scaled, up or down, so that the median distance is what a normal sample would have, and a document whose squared Mahalanobis
distance is beyond the chi-square quantile is rejected. A group of n documents that pass the base rules is judged by the
moments of a mixture: its own estimate with the share n / (n + `shrink`), that of all documents with the rest, so nothing
jumps as a group grows. Statistics that hardly vary in a group get the spread `floor` at least, in every step and
after scaling, so that a majority of equal values does not make every other value an outlier; what such a statistic
takes from the distances is taken from the median of the normal sample too.

Everything is DataFrame functions. Group estimates are one small row each. They are broadcast while there are at most
MOST_GROUPS of them and joined on salted keys beyond that, so a hot source is never one task; sums and quantiles are
taken in each task first.

Null and empty texts have no words and fail the base rules. A null lang or source is a group of its own.
Very long texts are taken whole. Repeated rows count as often as they stand. An empty table gives no rows. Columns of clashing names do not matter:
only doc_id, text, lang and source are read, and `keep` hands on all columns as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import cut

SPACE, VISIBLE = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"
WINDOW = 8
MOST_GROUPS, SALTS = 10_000, 64
#: Rows of statistics that a task of a step reads at least, where there are as many.
TASK_ROWS = 20_000
FEATURES = ["word_length", "symbols", "capitals", "repeats", "dup_lines", "length"]


@dataclass(frozen=True)
class McdParams:
    core: float = 0.75
    steps: int = 20
    least_fall: float = 0.01
    quantile: float = 0.9999
    shrink: int = 50
    least_words: int = 20
    most_repeat_percent: int = 30
    #: Least standard deviation of each of FEATURES. Where no other text repeats anything, copies of more than 54 % of the
    #: lines are beyond the limit by themselves (ln(1 + 54)^2 / 0.75^2 = 28.5); one line that comes twice is not, with the
    #: words that it repeats (at worst one of 7 equal lines, 7.4 / 0.75^2 + 11.5 = 24.7, or one of 3 short ones, 22.5).
    #: Repeated words alone are left to `most_repeat_percent`.
    floor: tuple[float, ...] = (0.1, 0.5, 0.5, 1.0, 0.75, 0.5)


def chi_square(quantile: float, degrees: int) -> float:
    """Quantile of the chi-square distribution (the cube-root normal approximation)."""
    part = 2 / (9 * degrees)
    return degrees * (1 - part + NormalDist().inv_cdf(quantile) * part**0.5) ** 3


def with_statistics(docs: DataFrame, name: str, params: McdParams) -> DataFrame:
    """All columns and `name`: a struct with the base statistics, base_failed, the group and FEATURES."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    q = lambda part: f"`{name}_{part}`"
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Each step uses what the one before has worked out once.
    step = docs.select(
        *own,
        F.filter(F.split(plain, SPACE), lambda w: w != "").alias(f"{name}_words"),
        F.filter(F.split(plain, "\n"), lambda x: x.rlike(VISIBLE)).alias(f"{name}_lines"),
        F.length(F.regexp_replace(plain, "[^#*$%&|<>]+", "")).alias(f"{name}_symbols"),
        F.length(F.regexp_replace(plain, "[^A-Z]+", "")).alias(f"{name}_capitals"),
    )
    passed = [*own, *(F.col(q(c)) for c in ("lines", "symbols", "capitals"))]
    step = step.select(*passed, F.col(q("words")), F.expr(f"transform({q('words')}, w -> xxhash64(w))").alias(f"{name}_hashes"))
    passed = [*passed, F.expr(f"size({q('words')})").alias(f"{name}_n"), F.expr(f"length(array_join({q('words')}, ''))").alias(f"{name}_chars")]
    window = ", ".join(f"get({q('hashes')}, i + {k})" for k in range(WINDOW))
    step = step.select(
        *passed,
        F.expr(f"if(size({q('hashes')}) < {WINDOW}, array(), transform(sequence(0, size({q('hashes')}) - {WINDOW}), i -> xxhash64({window})))").alias(f"{name}_windows"),
    )
    passed = [*passed[:-2], F.col(q("n")), F.col(q("chars"))]
    # Only texts in which a window comes again have their windows sorted.
    step = step.select(
        *passed,
        F.expr(
            f"if(size(array_distinct({q('windows')})) = size({q('windows')}), null, sort_array(transform({q('windows')}, (h, i) -> struct(h, i))))"
        ).alias(f"{name}_sorted"),
    )
    same = lambda other: f"coalesce(get({q('sorted')}, k {other}).h = s.h, false)"
    step = step.select(
        *passed,
        F.expr(f"sort_array(transform(filter({q('sorted')}, (s, k) -> {same('- 1')} or {same('+ 1')}), s -> s.i))").alias(f"{name}_again"),
    )
    covered = f"{WINDOW} + aggregate(zip_with(slice({q('again')}, 1, size({q('again')}) - 1), slice({q('again')}, 2, size({q('again')}) - 1), (a, b) -> least({WINDOW}, b - a)), 0, (x, y) -> x + y)"
    step = step.select(
        *passed,
        F.expr(f"if({q('again')} is null, 0, {covered})").alias(f"{name}_repeats"),
        F.expr(f"size({q('lines')}) - size(array_distinct({q('lines')}))").alias(f"{name}_dup_lines"),
    )
    # The id is never negative, so this is never true; as it is not a function of the row, filters on the result stay
    # above this step, instead of being pushed down as copies of all the expressions below.
    never = "shiftright(monotonically_increasing_id(), 63) <> 0"
    share = lambda part, whole: f"ln(1 + 100 * {q(part)} / greatest({whole}, 1))"
    n, chars = q("n"), q("chars")
    return step.select(
        *own,
        F.struct(
            F.expr(f"cast({n} as bigint)").alias("n_words"),
            F.expr(f"cast({chars} as bigint)").alias("word_chars"),
            *(F.expr(f"cast({q(a)} as bigint)").alias(b) for a, b in (("symbols", "n_symbols"), ("dup_lines", "n_dup_lines"), ("repeats", "n_repeat_words"))),
            F.expr(f"{n} < {params.least_words} or 100 * {q('repeats')} > {params.most_repeat_percent} * {n} or {never}").alias("base_failed"),
            F.to_json(F.struct(F.col("lang").cast("string"), F.col("source").cast("string"))).alias("group"),
            F.expr(f"ln(greatest({chars}, 1) / greatest({n}, 1))").alias("word_length"),
            F.expr(share("symbols", chars)).alias("symbols"),
            F.expr(share("capitals", chars)).alias("capitals"),
            F.expr(share("repeats", n)).alias("repeats"),
            F.expr(share("dup_lines", f"size({q('lines')})")).alias("dup_lines"),
            F.expr(f"ln(1 + {n})").alias("length"),
        ).alias(name),
    )


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns of FEATURES and of an estimate: mean_i and the factor l_i_j."""
    solved: list[Column] = []
    for i, name in enumerate(FEATURES):
        rest = F.col(name) - F.col(f"mean_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * solved[j]
        solved.append(rest / F.col(f"l_{i}_{i}"))
    total = F.lit(0.0)
    for part in solved:
        total = total + part * part
    return total


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _with_factor(moments: DataFrame, params: McdParams) -> DataFrame:
    """group, mean_i, v_i_j and the factor l_i_j, of the variances with their floors, from group, mean_i, v_i_j; one
    projection per column of the factor."""
    means = [f"mean_{i}" for i in range(len(FEATURES))]
    out = moments
    for i, j in sorted(_PAIRS, key=lambda p: (p[1], p[0])):
        rest = F.greatest(F.col(f"v_{i}_{j}"), F.lit(params.floor[i] ** 2)) if i == j else F.col(f"v_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        value = F.sqrt(F.greatest(rest, F.lit(params.floor[i] ** 2 / 4))) if i == j else rest / F.col(f"l_{j}_{j}")
        out = out.withColumn(f"l_{i}_{j}", value)
    return out.select("group", *means, *(f"{x}_{i}_{j}" for x in "vl" for i, j in _PAIRS))


def _normal_median(params: McdParams) -> Column:
    """Median squared distance of a normal sample of covariance v_i_j: statistics below their floor count in part."""
    degrees = F.lit(0.0)
    for i in range(len(FEATURES)):
        degrees = degrees + F.least(F.col(f"v_{i}_{i}") / params.floor[i] ** 2, F.lit(1.0))
    degrees = F.greatest(degrees, F.lit(1.0))
    return degrees * F.pow(1 - 2 / (9 * degrees), F.lit(3))


def attach(rows: DataFrame, group: Column, estimates: DataFrame, n_groups: int) -> DataFrame:
    """Join the one row per group to its rows without gathering a group."""
    if n_groups <= MOST_GROUPS:
        return rows.join(F.broadcast(estimates), group == estimates["group"], "left").drop(estimates["group"])
    salted = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return rows.join(salted, (group == salted["group"]) & (salt == salted["salt"]), "left").drop(salted["group"], salted["salt"])


def _moments(rows: DataFrame, *more: Column) -> DataFrame:
    """group, means mean_i and covariances v_i_j of FEATURES for each `mine`, and further aggregates."""
    return rows.groupBy(F.col("mine").alias("group")).agg(
        *(F.avg(x).alias(f"mean_{i}") for i, x in enumerate(FEATURES)),
        *(F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"v_{i}_{j}") for i, j in _PAIRS),
        *more,
    )


def _held(estimates_: DataFrame, n_groups: int) -> DataFrame:
    """A table of a row per group, cut, in as many partitions as its rows need, however many partitions it was made from."""
    return cut(estimates_.repartition(1 + n_groups // 1000))


def starts(rows: DataFrame, params: McdParams, n_groups: int) -> DataFrame:
    """The two starts of each group, named 0 and 1 before its name: medians with median deviations, and all its moments."""
    plain = _held(_moments(rows, *(F.percentile_approx(x, 0.5, 1000).alias(f"middle_{i}") for i, x in enumerate(FEATURES))), n_groups)
    middle = plain.select("group", *(f"middle_{i}" for i in range(len(FEATURES))))
    spread = attach(rows, F.col("mine"), middle, n_groups).groupBy(F.col("mine").alias("group")).agg(
        *(F.first(f"middle_{i}").alias(f"mean_{i}") for i in range(len(FEATURES))),
        *(F.percentile_approx(F.abs(F.col(x) - F.col(f"middle_{i}")), 0.5, 1000).alias(f"mad_{i}") for i, x in enumerate(FEATURES)),
    )
    robust = spread.select(
        F.concat(F.lit("0"), "group").alias("group"),
        *(f"mean_{i}" for i in range(len(FEATURES))),
        *((F.pow(F.col(f"mad_{i}") * 1.4826, F.lit(2)) if i == j else F.lit(0.0)).alias(f"v_{i}_{j}") for i, j in _PAIRS),
    )
    return robust.unionByName(plain.select(F.concat(F.lit("1"), "group").alias("group"), *robust.columns[1:]))


def concentrate(rows: DataFrame, first: DataFrame, params: McdParams, n_groups: int) -> DataFrame:
    """Concentration steps of each group of `first` over its rows, until its determinant falls no more: the estimate with its
    log determinant `size`. A step that would raise the determinant, which floors and approximate quantiles can do, is not taken."""
    columns = ["group", *(f"mean_{i}" for i in range(len(FEATURES))), *(f"{x}_{i}_{j}" for x in "vl" for i, j in _PAIRS)]
    now = _held(_with_factor(first, params).select("*", F.lit(None).cast("double").alias("size"), F.lit(True).alias("open")), n_groups)
    log_determinant = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(len(FEATURES))), F.lit(0.0)) * 2
    for _ in range(params.steps):
        # Only groups that still fall have their rows read on.
        live = now.filter("open")
        far = attach(rows, F.col("mine"), live, n_groups).filter(F.col("mean_0").isNotNull()).select("mine", _distance().alias("d2"))
        edge = far.groupBy(F.col("mine").alias("group")).agg(F.percentile_approx("d2", params.core, 1000).alias("edge"))
        core = attach(rows, F.col("mine"), _held(live.join(edge, "group"), n_groups), n_groups).filter(_distance() <= F.col("edge"))
        new = _with_factor(_moments(core), params).select(*columns, log_determinant.alias("size"))
        before = live.select(F.col("group").alias("name"), F.col("size").alias("was"), F.struct(*columns[1:], "size").alias("old"))
        met = before.join(new.select(F.col("group").alias("name"), F.struct(*columns[1:], "size").alias("new")), "name")
        falls = F.col("was").isNull() | (F.col("new.size") < F.col("was"))
        on = F.col("was").isNull() | (F.col("new.size") < F.col("was") - params.least_fall)
        step = met.select(F.col("name").alias("group"), F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e"), on.alias("open")).select("group", "e.*", "open")
        now = _held(step.unionByName(now.filter("not open")), n_groups)
        if now.filter("open").isEmpty():
            break
    return now


def estimates(statistics: DataFrame, params: McdParams) -> tuple[DataFrame, int]:
    """group, mean_i, l_i_j for every group of `statistics` (rows of the struct) that has a member, and their number."""
    ok = statistics.filter(~F.col("base_failed"))
    sizes = cut(statistics.groupBy("group").agg(F.count_if(~F.col("base_failed")).alias("rows")))
    n_groups, total = sizes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # Texts come in many partitions; their statistics are small, and each step would leave files for every one of them.
    ok = ok.coalesce(max(ok.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS)))
    # Each row counts for its group and for the whole, which is group * here.
    rows = ok.select("doc_id", F.explode(F.array(F.col("group"), F.lit("*"))).alias("mine"), *FEATURES)
    twice = rows.select("doc_id", F.explode(F.array(*(F.concat(F.lit(x), "mine") for x in "01"))).alias("mine"), *FEATURES)
    found = concentrate(twice, starts(rows, params, n_groups + 1), params, 2 * n_groups + 2)
    # Of both starts, the one that came to the smaller determinant.
    parts = [c for c in found.columns if c not in ("group", "size", "open")]
    best = found.groupBy(F.expr("substr(group, 2)").alias("group")).agg(F.min(F.struct("size", F.col("group").alias("start"), *parts)).alias("e"))
    now = _held(best.select("group", *(f"e.{c}" for c in parts)), n_groups)
    far = attach(rows, F.col("mine"), now, n_groups + 1).select("mine", _distance().alias("d2"))
    half = far.groupBy(F.col("mine").alias("group")).agg(F.percentile_approx("d2", 0.5, 1000).alias("half"))
    scale = F.col("half") / _normal_median(params)
    means = [f"mean_{i}" for i in range(len(FEATURES))]
    scaled = cut(now.join(half, "group").select("group", *means, *((F.col(f"v_{i}_{j}") * scale).alias(f"v_{i}_{j}") for i, j in _PAIRS)))
    # Moments of a mixture: a group of n rows has the share n / (n + shrink), the whole has the rest.
    whole = scaled.filter("group = '*'").select(F.col("group").alias("all"), *(F.col(c).alias(f"w_{c}") for c in scaled.columns if c != "group"))
    met = sizes.withColumn("all", F.lit("*")).join(whole, "all").join(scaled, "group", "left")
    share = F.col("rows") / (F.col("rows") + params.shrink)
    apart = lambda i: F.coalesce(F.col(f"mean_{i}") - F.col(f"w_mean_{i}"), F.lit(0.0))
    mixed = met.select(
        "group",
        *((F.col(f"w_mean_{i}") + share * apart(i)).alias(f"mean_{i}") for i in range(len(FEATURES))),
        *(
            (share * F.coalesce(F.col(f"v_{i}_{j}"), F.lit(0.0)) + (1 - share) * F.col(f"w_v_{i}_{j}") + share * (1 - share) * apart(i) * apart(j)).alias(f"v_{i}_{j}")
            for i, j in _PAIRS
        ),
    )
    return cut(_with_factor(mixed, params).drop(*(f"v_{i}_{j}" for i, j in _PAIRS))), n_groups


def judged(docs: DataFrame, params: McdParams = McdParams()) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and distance (squared, null if the base rules failed) of every row."""
    chosen = docs.select("doc_id", "text", "lang", "source")
    statistics = cut(with_statistics(chosen, "q", params).select("doc_id", "q.*"))
    found, n_groups = estimates(statistics, params)
    return _verdict(statistics, F.col("group_of"), found, n_groups, params, statistics.columns)


def _verdict(statistics: DataFrame, group: Column, found: DataFrame, n_groups: int, params: McdParams, columns: list[str]) -> DataFrame:
    named = statistics.withColumnRenamed("group", "group_of")
    rows = attach(named, group, found, n_groups)
    distance = F.when(~F.col("base_failed"), _distance())
    # A table whose documents all fail has no estimate; then there is nothing to be told apart from.
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= chi_square(params.quantile, len(FEATURES)))
    base = [c for c in columns if c not in ("group", *FEATURES)]
    return rows.select(*base, kept.alias("kept"), distance.alias("distance"))


def keep(docs: DataFrame, params: McdParams = McdParams()) -> DataFrame:
    """The documents that pass, with all their columns. Statistics are worked out again instead of moving the texts."""
    statistics = cut(with_statistics(docs.select("doc_id", "text", "lang", "source"), "q", params).select("doc_id", "q.*"))
    found, n_groups = estimates(statistics, params)
    name = "_quality"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    marked = with_statistics(docs, name, params)
    fields = [f for f in statistics.columns if f != "doc_id"]
    wide = marked.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id"), *(F.col(f"{name}.{f}").alias(f) for f in fields))
    verdict = _verdict(wide, F.col("group_of"), found, n_groups, params, ["doc", *fields])
    return verdict.filter("kept").select("doc.*")
