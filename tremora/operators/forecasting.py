"""Baselines, calibration, walk-forward folds, boosted trees and forecast snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.functions.rates import elapsed_years, extrapolated_rate, poisson_probability
from tremora.operators import isotonic
from tremora.operators.context import year_of
from tremora.operators.metrics import evaluate
from tremora.operators.ranking import dense_ids
from tremora.schema import FEATURE_COLUMNS, FORECAST_COLUMNS, TRIGGER_COLUMNS
from tremora.session import materialize


@dataclass(frozen=True)
class RateSpec:
    """Cutoff, b-value, target magnitude and horizon of a rate baseline."""

    m0: float = 5.0
    b: float = 1.0
    mc: float = 4.5
    horizon_days: float = 30.0


# Target column -> (magnitude, horizon in days).
TARGETS = {"y_m5_30d": (5.0, 30.0), "y_m6_30d": (6.0, 30.0), "y_m5_7d": (5.0, 7.0)}


def _rate(count: Column, years: Column, s: RateSpec) -> Column:
    return extrapolated_rate(count, years, s.b, s.m0, s.mc)


def long_term(s: RateSpec) -> Column:
    return poisson_probability(_rate(F.col("cnt_all"), elapsed_years(F.col("t_us")), s), s.horizon_days)


def last_year(s: RateSpec) -> Column:
    return poisson_probability(_rate(F.col("cnt_365d"), F.lit(1.0), s), s.horizon_days)


def smoothed(s: RateSpec) -> Column:
    cell = _rate(F.col("cnt_365d"), F.lit(1.0), s)
    around = _rate(F.col("nb_cnt_365d") / 9.0, F.lit(1.0), s)
    return poisson_probability((cell + around) * F.lit(0.5), s.horizon_days)


BASELINES: dict[str, Callable[[RateSpec], Column]] = {
    "poisson_lt": long_term, "poisson_1y": last_year, "poisson_smooth": smoothed,
}


def baseline_predictions(features: DataFrame, target: str, spec: RateSpec, names: Sequence[str] = tuple(BASELINES)) -> DataFrame:
    """Long form (all feature columns, model, p, y): every row scored by every named baseline in one pass."""
    options = [F.struct(F.lit(name).alias("model"), BASELINES[name](spec).alias("p")) for name in names]
    return features.select("*", F.col(target).cast("long").alias("y"), F.inline(F.array(*options)))


def split_at_year(features: DataFrame, first_test_year: int) -> tuple[DataFrame, DataFrame]:
    year = year_of(F.col("t_us"))
    return features.filter(year < first_test_year), features.filter(year >= first_test_year)


def climatology(train: DataFrame, target: str) -> DataFrame:
    """One row (p): the training base rate."""
    return train.agg(F.avg(F.col(target).cast("double")).alias("p"))


def positive_weight(train: DataFrame, target: str) -> DataFrame:
    """One row: weight = (n - pos) / max(pos, 1), and n."""
    pos = F.sum(F.col(target).cast("long"))
    return train.agg(((F.count(F.lit(1)) - pos) / F.greatest(pos, F.lit(1))).alias("weight"), F.count(F.lit(1)).alias("n"))


def _yearly(features: DataFrame, target: str) -> DataFrame:
    return features.groupBy(year_of(F.col("t_us")).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("pos")
    )


def _with_earlier_years(yearly: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """Add n_<name> and pos_<name> over years year+first .. year+last; one row per calendar year goes in."""
    years = Window.orderBy("year").rangeBetween(first, last)
    return yearly.select("*", *[F.coalesce(F.sum(c).over(years), F.lit(0)).alias(f"{c}_{name}") for c in ("n", "pos")])


def walk_forward(features: DataFrame, target: str, first_test_year: int) -> DataFrame:
    """(fold, n_train, pos_train, n_test, pos_test): train on earlier years, test on the fold's year.

    Computed from yearly counts: one scan for all folds, and years without test rows do not appear.
    """
    return (
        _with_earlier_years(_yearly(features, target), "train", Window.unboundedPreceding, -1)
        .filter(F.col("year") >= first_test_year)
        .select(F.col("year").alias("fold"), "n_train", "pos_train", F.col("n").alias("n_test"), F.col("pos").alias("pos_test"))
    )


def three_way_folds(features: DataFrame, target: str, first_test_year: int, min_fit_pos: int = 20) -> DataFrame:
    """(fold, sizes, climatology): fit before Y-1, calibrate on Y-1, test on Y; thin folds are left out."""
    yearly = _with_earlier_years(_yearly(features, target), "fit", Window.unboundedPreceding, -2)
    yearly = _with_earlier_years(yearly, "calib", -1, -1)
    seen, hits = F.col("n_fit") + F.col("n_calib"), F.col("pos_fit") + F.col("pos_calib")
    return (
        yearly.filter((F.col("year") >= first_test_year) & (F.col("n_calib") > 0) & (F.col("pos_fit") >= min_fit_pos))
        .select(
            F.col("year").alias("fold"), F.col("n").alias("n_test"), F.col("pos").alias("pos_test"), "n_fit", "pos_fit", "n_calib", "pos_calib",
            F.try_divide(hits.cast("double"), seen.cast("double")).alias("climatology"),
        )
    )


# --- calibration ------------------------------------------------------------------------------------


def fit_isotonic(predictions: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Blocks of the isotonic map from p to the observed frequency, one map for each value of `keys`."""
    return isotonic.fit(predictions, keys, p, y)


def apply_isotonic(blocks: DataFrame, predictions: DataFrame, p: str = "p", out: str = "p_cal", keys: Sequence[str] = ()) -> DataFrame:
    """Linear between blocks, constant outside them, kept within [0, 1]."""
    return isotonic.apply(blocks, predictions, keys, p, out)


# --- boosted trees ----------------------------------------------------------------------------------


def feature_names(features: DataFrame) -> list[str]:
    """Input columns in their declared order; all but the triggering pair must be there, and that as a pair or not at all."""
    held = set(features.columns)
    missing = sorted(set(FEATURE_COLUMNS) - held)
    if missing or len(held.intersection(TRIGGER_COLUMNS)) == 1:
        raise ValueError(f"incomplete feature table: {missing or TRIGGER_COLUMNS}")
    return [*FEATURE_COLUMNS, *(TRIGGER_COLUMNS if held.issuperset(TRIGGER_COLUMNS) else ())]


# Two profiles; the second grows level by level, not leaf by leaf, with larger leaves.
TREES = {
    "trees_a": dict(maxIter=300, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5),
    "trees_b": dict(maxIter=300, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=50),
}


def assemble(features: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return VectorAssembler(inputCols=list(names or feature_names(features)), outputCol="inputs").transform(features)


_AT_ONCE = 10  # models trained side by side
_TASK_ROWS = 40_000  # training rows of a task; a round is a few jobs, so small tables are not spread thin


def train_trees(features: DataFrame, target: str, profile: str = "trees_a", seed: int = 0, at_once: int = 1, **overrides):
    """A model of `at_once` that share the executors: beyond three, each gets fewer and larger tasks, as they fill the cores together."""
    n, weight = positive_weight(features, target).select("n", "weight").first()
    rows = assemble(features).withColumn("label", F.col(target).cast("double")).withColumn(
        "weight", F.when(F.col(target) > 0, F.lit(float(weight or 1.0))).otherwise(F.lit(1.0))
    )
    settings = {"checkpointInterval": 20, **TREES[profile], **overrides}
    learner = GBTClassifier(featuresCol="inputs", labelCol="label", weightCol="weight", seed=seed, **settings)
    tasks = n // (_TASK_ROWS * max(at_once // 2, 1)) + 1
    # Read once a round and level: kept in memory, on disk beyond it.
    held = rows.select("inputs", "label", "weight").coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return learner.fit(held)
    finally:
        held.unpersist()


def train_side_by_side(jobs: Sequence[tuple[DataFrame, str]], target: str, **overrides) -> list:
    """Models of (rows, profile) pairs. One boosting round is a few short jobs, so several models share the executors."""
    at_once = min(len(jobs), _AT_ONCE)
    with ThreadPool(_AT_ONCE) as pool:
        return pool.map(lambda job: train_trees(job[0], target, job[1], at_once=at_once, **overrides), jobs)


def tree_probability(model, features: DataFrame, out: str = "p") -> DataFrame:
    scored = model.transform(assemble(features))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("inputs", "rawPrediction", "probability", "prediction")


def split_importance(model, features: DataFrame, top: int = 8) -> DataFrame:
    names = feature_names(features)
    ranked = sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda x: -x[1])[:top]
    rows = [(rank + 1, name, float(v)) for rank, (name, v) in enumerate(ranked)]
    return features.sparkSession.createDataFrame(rows, "rank long, feature string, importance double")


def permutation_importance(model, features: DataFrame, target: str, names: Sequence[str], seed: int = 0) -> DataFrame:
    """(feature, auc_drop): ranking lost when one column is moved to other rows.

    Rows get dense positions in a hashed order; a column is permuted by joining on the position shifted
    by half the rows, so the permutation is distributed and repeatable.
    """
    keyed = features.select("*", F.xxhash64(F.lit(seed), "cell_id", "t_us").alias("_h"))
    placed = dense_ids(keyed, ["_h", "cell_id", "t_us"], "position")
    n = placed.count()
    partner = F.pmod(F.col("position") - 1 + F.lit(max(n // 2, 1)), F.lit(n)) + 1
    versions = [placed.select("*", F.lit("").alias("moved"))]
    for name in names:
        moved = placed.select(partner.alias("position"), F.col(name).alias("_new"))
        versions.append(placed.join(moved, "position").withColumn(name, F.col("_new")).drop("_new").withColumn("moved", F.lit(name)))
    scored = tree_probability(model, reduce(DataFrame.unionByName, versions)).select(
        "moved", F.col(target).cast("long").alias("y"), "p"
    )
    auc = evaluate(scored, ["moved"]).select("moved", "roc_auc")
    # One row per version: the unmoved one is the reference.
    base = F.max(F.when(F.col("moved") == "", F.col("roc_auc"))).over(Window.partitionBy())
    return auc.select("moved", (base - F.col("roc_auc")).alias("auc_drop")).filter("moved <> ''").withColumnRenamed("moved", "feature")


# --- backtests and verdicts -------------------------------------------------------------------------


def backtest_folds(
    features: DataFrame, target: str, first_test_year: int, trainers: Sequence[str] = tuple(TREES),
    min_fit_pos: int = 20, b: float = 1.0, mc: float = 4.5, **tree_overrides,
) -> DataFrame:
    """Pooled out-of-sample predictions (fold, model, y, p, p_ref), each calibrated on the year before.

    The scores of all folds and models are written once; one keyed isotonic fit calibrates them all.
    """
    m0, horizon = TARGETS[target]
    spec = RateSpec(m0=m0, b=b, mc=mc, horizon_days=horizon)
    year = year_of(F.col("t_us"))
    folds = three_way_folds(features, target, first_test_year, min_fit_pos).orderBy("fold").collect()  # one row per year
    if not folds:
        raise ValueError("no fold has enough data")
    jobs = [(fold, name) for fold in folds for name in trainers]
    models = train_side_by_side([(features.filter(year < fold["fold"] - 1), name) for fold, name in jobs], target, **tree_overrides)

    def part(fold, model: str, scored: DataFrame) -> DataFrame:
        return scored.select(
            F.lit(fold["fold"]).cast("long").alias("fold"), F.lit(model).alias("model"), (year == fold["fold"]).alias("tested"),
            F.col(target).cast("long").alias("y"), F.col("p").cast("double").alias("p"), F.lit(fold["climatology"]).cast("double").alias("p_ref"),
        )

    around = {fold["fold"]: features.filter(year.between(fold["fold"] - 1, fold["fold"])) for fold in folds}
    parts = [part(fold, "poisson_smooth", around[fold["fold"]].withColumn("p", smoothed(spec))) for fold in folds]
    parts += [part(fold, name, tree_probability(m, around[fold["fold"]])) for (fold, name), m in zip(jobs, models)]
    scored = materialize(reduce(DataFrame.unionByName, parts))
    keys = ["fold", "model"]
    blocks = fit_isotonic(scored.filter("NOT tested"), keys=keys)
    calibrated = apply_isotonic(blocks, scored.filter("tested"), keys=keys).select("fold", "model", "y", F.col("p_cal").alias("p"), "p_ref")
    known = scored.filter(F.col("tested") & (F.col("model") == "poisson_smooth"))
    return calibrated.unionByName(known.select("fold", F.lit("climatology").alias("model"), "y", F.col("p_ref").alias("p"), "p_ref"))


def baseline_comparison(features: DataFrame, target: str, first_test_year: int, b: float = 1.0, mc: float = 4.5) -> DataFrame:
    """Scores of climatology and of each baseline, raw and calibrated on the training years."""
    m0, horizon = TARGETS[target]
    spec = RateSpec(m0=m0, b=b, mc=mc, horizon_days=horizon)
    train, test = split_at_year(features, first_test_year)
    base = climatology(train, target).first()["p"]
    constant = test.select(F.lit("climatology").alias("model"), F.lit("raw").alias("version"), F.col(target).cast("long").alias("y"), F.lit(base).alias("p"))
    known, asked = (baseline_predictions(d, target, spec).select("model", "y", "p") for d in (train, test))
    calibrated = apply_isotonic(fit_isotonic(known, keys=["model"]), asked, keys=["model"])
    pooled = constant.unionByName(asked.select("model", F.lit("raw").alias("version"), "y", "p"))
    pooled = pooled.unionByName(calibrated.select("model", F.lit("calibrated").alias("version"), "y", F.col("p_cal").alias("p")))
    return evaluate(pooled.withColumn("p_ref", F.lit(base)), ["model", "version"], p_ref="p_ref")


def recent_rate_verdict(scores: DataFrame) -> DataFrame:
    """Whether the last-year rate beats the long-term rate by calibrated skill."""
    of = lambda name: F.max(F.when(F.col("model") == name, F.col("bss")))
    deltas = scores.agg(of("poisson_1y").alias("bss_recent"), of("poisson_lt").alias("bss_long"))
    return deltas.withColumn("verdict", F.when(F.col("bss_recent") > F.col("bss_long"), "supported").otherwise("inconclusive"))


def model_verdict(scores: DataFrame, candidates: Sequence[str], baseline: str = "poisson_smooth") -> DataFrame:
    """Best candidate by ROC area against the baseline: supported, partial or not supported."""
    row = F.struct(F.coalesce("roc_auc", F.lit(0.0)).alias("roc"), "pr_auc", "bss", "model")
    is_candidate = F.col("model").isin(*candidates)
    picked = scores.agg(
        F.max(F.when(is_candidate, row)).alias("c"), F.max(F.when(F.col("model") == baseline, row)).alias("b")
    )
    ranks_better = (F.col("c.roc") > F.col("b.roc")) & (F.col("c.pr_auc") > F.col("b.pr_auc"))
    return picked.select(
        F.col("c.model").alias("best"), (F.col("c.roc") - F.col("b.roc")).alias("d_roc"),
        (F.col("c.pr_auc") - F.col("b.pr_auc")).alias("d_pr"),
        F.when(ranks_better & (F.col("c.bss") > 0), "supported").when(ranks_better, "partial").otherwise("not supported").alias("verdict"),
    )


# --- snapshots --------------------------------------------------------------------------------------


def split_latest(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows at the last instant, rows before it)."""
    last = features.agg(F.max("t_us")).first()[0]
    return features.filter(F.col("t_us") == last), features.filter(F.col("t_us") < last)


def forecast_snapshot(features: DataFrame, b: float = 1.0, mc: float = 4.5) -> DataFrame:
    """Calibrated M5 and M6 probabilities per cell at the last instant."""
    now, history = split_latest(features)
    wanted = {"p_m5_30d": "y_m5_30d", "p_m6_30d": "y_m6_30d"}
    # equal rates that differ in the last bits, because their counts were added in another order, are one point
    scores = [F.struct(F.lit(c).alias("column"), F.round(smoothed(RateSpec(m0=TARGETS[t][0], b=b, mc=mc)), 12).alias("p"), F.col(t).alias("y")) for c, t in wanted.items()]
    blocks = fit_isotonic(history.select(F.inline(F.array(*scores))), keys=["column"])
    calibrated = apply_isotonic(blocks, now.select("cell_id", F.inline(F.array(*scores))), keys=["column"])
    wide = calibrated.groupBy("cell_id").agg(*[F.max(F.when(F.col("column") == c, F.col("p_cal"))).alias(c) for c in wanted])
    return now.join(wide, "cell_id").select(*FORECAST_COLUMNS, "t_us")


def grid_view(snapshot: DataFrame, target: str = "m5") -> DataFrame:
    if target not in ("m5", "m6"):
        raise ValueError("target is m5 or m6")
    return snapshot.select(F.col("cen_lat").alias("lat"), F.col("cen_lon").alias("lon"), F.col(f"p_{target}_30d").alias("p"), "cnt_365d")


def top_cells(snapshot: DataFrame, k: int = 10, by: str = "p_m5_30d") -> DataFrame:
    return snapshot.orderBy(F.desc(by), "cell_id").limit(k)
