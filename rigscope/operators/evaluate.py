"""Model evaluation as aggregates."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GRADES, SensorSpec
from ..functions.scalars import first_match
from .sequence import SEQ, add_sequence


def aucs(df: DataFrame, label: str, scores) -> dict:
    """G1 for several score columns in one pass: area under the ROC curve, ties counted half (NaN with one class only).

    Rows are first counted by distinct score; these counts are dealt out by ranges of the score, each range adds up
    its own share, and one row a range reaches the driver: positives times the negatives below them, and
    what the ranges before hold of either."""
    scores = list(scores)
    long = df.select(F.col(label).cast("int").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("s")) for i, c in enumerate(scores)])).alias("p"))
    per = (long.filter(F.col("p.s").isNotNull()).groupBy("p.k", "p.s")
           .agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg")))
    dealt = per.repartitionByRange("k", "s").withColumn("part", F.spark_partition_id())
    below = F.sum("neg").over(Window.partitionBy("k", "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    area = F.col("pos") * (F.coalesce(below, F.lit(0)) + F.col("neg") / 2)
    parts = (dealt.withColumn("area", area).groupBy("k", "part")
             .agg(F.sum("area").alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect())
    out = {}
    for i, c in enumerate(scores):
        total = pos = neg = 0
        for r in sorted((r for r in parts if r["k"] == i), key=lambda r: r["part"]):
            total += r["area"] + r["pos"] * neg
            pos, neg = pos + r["pos"], neg + r["neg"]
        out[c] = total / (pos * neg) if pos and neg else float("nan")
    return out


def auc(df: DataFrame, label: str, score: str) -> float:
    """G1 for one score column."""
    return aucs(df, label, [score])[score]


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """[[tn, fp], [fn, tp]] as four columns plus each cell's share of the total (%)."""
    y, p = F.col(label), F.col(pred)
    c = df.agg(
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
    )
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return c.select("*", *[(F.col(k) / total * F.lit(100.0)).alias(f"{k}_pct") for k in ("tn", "fp", "fn", "tp")])


def f1_from(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of the positive class (0 when undefined)."""
    den = F.lit(2) * tp + fp + fn
    return F.when(den > 0, (F.lit(2.0) * tp) / den).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision / recall / f1 / support per class, accuracy, macro and weighted averages."""
    c = confusion(df, label, pred)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))

    def safe(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    n = tn + fp + fn + tp
    p0, r0 = safe(tn, tn + fn), safe(tn, tn + fp)
    p1, r1 = safe(tp, tp + fp), safe(tp, tp + fn)
    f0 = safe(F.lit(2.0) * p0 * r0, p0 + r0)
    f1 = safe(F.lit(2.0) * p1 * r1, p1 + r1)
    s0, s1 = tn + fp, fn + tp
    acc = safe(tn + tp, n)
    rows = F.array(
        F.struct(F.lit("0").alias("class"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("class"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 n.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), safe(p0 * s0 + p1 * s1, n).alias("precision"),
                 safe(r0 * s0 + r1 * s1, n).alias("recall"), safe(f0 * s0 + f1 * s1, n).alias("f1"),
                 n.alias("support")),
    )
    return c.select(F.explode(rows).alias("r")).select("r.*")


def mae(df: DataFrame, y: str, p: str) -> DataFrame:
    """G5."""
    return df.agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"), F.count(F.lit(1)).alias("n"))


def grade(auc_col) -> Column:
    """G7."""
    a = F.col(auc_col) if isinstance(auc_col, str) else auc_col
    return first_match([(a >= F.lit(cut), g) for cut, g in GRADES], "C")


def roc_points(df: DataFrame, label: str, prob: str, step: float = 0.01) -> DataFrame:
    """ROC points at thresholds ``k * step`` for a probability in [0, 1]: counts per bucket, then
    cumulative true/false positives from the top.  The window runs over at most 1/step + 1 rows."""
    top_bucket = int(round(1.0 / step))
    b = F.least(F.greatest(F.floor(F.col(prob) / F.lit(step)).cast("int"), F.lit(0)), F.lit(top_bucket))
    per = df.groupBy(b.alias("bucket")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    top = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    return per.select(
        (F.col("bucket") * F.lit(step)).alias("threshold"),
        (F.sum("pos").over(top) / F.sum("pos").over(everything)).alias("tpr"),
        (F.sum("neg").over(top) / F.sum("neg").over(everything)).alias("fpr"),
    )


def lead_times(pred: DataFrame, spec: SensorSpec) -> DataFrame:
    """G9 per failure: the first at-risk row of the run-up (rows sharing the same next failure) and the
    lead time in days.  An aggregate per (machine, failure), so no machine-wide window."""
    risky = (F.col("predicted_failure") == 1) & (F.col("days_to_failure_pred") <= F.lit(spec.thresholds.alert_days))
    g = (pred.filter(F.col("next_failure_us").isNotNull())
         .groupBy(spec.entity, "next_failure_us")
         .agg(F.min(F.when(risky, F.col(spec.time_us))).alias("first_alert_us")))
    return g.select(spec.entity, "next_failure_us", "first_alert_us",
                    ((F.col("next_failure_us") - F.col("first_alert_us")) / F.lit(86_400_000_000.0)).alias("lead_days"))


def downtime_summary(leads: DataFrame, emergency_hours: float = 24.0, planned_hours: float = 8.0,
                     min_lead_days: float = 1.0) -> DataFrame:
    """Mean lead time of warned failures and the downtime reduction
    ``(baseline - planned) / baseline * 100``: baseline treats every failure as an emergency repair,
    the planned case repairs failures warned at least ``min_lead_days`` ahead in ``planned_hours``."""
    warned = F.col("lead_days") >= F.lit(min_lead_days)
    agg = leads.agg(F.count(F.lit(1)).alias("failures"),
                    F.sum(warned.cast("long")).alias("warned"),
                    F.avg(F.when(warned, F.col("lead_days"))).alias("mean_lead_days"))
    baseline = F.col("failures") * F.lit(emergency_hours)
    planned = F.col("warned") * F.lit(planned_hours) + (F.col("failures") - F.col("warned")) * F.lit(emergency_hours)
    return agg.select("*", F.when(baseline > 0, (baseline - planned) / baseline * F.lit(100.0)).alias("downtime_reduction_pct"))


PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_WALK = 64        # steps of a walk; a step ends out of range with a chance of 1 / sqrt(n), and n <= 4096 never needs more


def round_keys(seed: int, number: int, rounds: int = 6) -> list[tuple[int, int, int]]:
    """Constants of the rounds of permutation ``number`` under ``seed``."""
    rng = random.Random(f"{seed}:{number}")
    return [tuple(rng.randrange(1, PRIMES[1]) for _ in range(4)) for _ in range(rounds)]


def _network(x: Column, n: int, keys: list[tuple[int, int, int, int]]) -> Column:
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)

    def mixed(half: Column, key) -> Column:
        return ((half * F.lit(key[0]) + F.lit(key[1])) % F.lit(PRIMES[0]) * F.lit(key[2]) + F.lit(key[3])) % F.lit(PRIMES[1])

    left, right = F.floor(x / F.lit(b)), x % F.lit(b)
    for k, key in enumerate(keys):
        if k % 2:
            right = (right + mixed(left, key)) % F.lit(b)
        else:
            left = (left + mixed(right, key)) % F.lit(a)
    return left * F.lit(b) + right


def permuted_places(df: DataFrame, place: str, n: int, keys: dict[str, list]) -> DataFrame:
    """``df`` with a column for each entry of ``keys``: a keyed permutation of the places 0 .. n - 1, computed row by row.

    A Feistel network, whose halves are the quotient and remainder of the place by b, works on the least rectangle a x b that holds
    n places (a = ceil(sqrt n), b = ceil(n / a)). Each round adds a hash of one half to the other one. A place that
    leaves the range goes through the network again until it is back (cycle walking)."""
    once = df.withColumns({c: _network(F.col(place), n, k) for c, k in keys.items()})

    def walk(c: str, k: list) -> Column:
        back = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), F.col(c), lambda x, _: F.when(x < n, x).otherwise(_network(x, n, k)))
        return F.when(F.col(c) < n, F.col(c)).otherwise(back)

    return once.withColumns({c: walk(c, k) for c, k in keys.items()})


def permuted(df: DataFrame, feats, record: str, seed: int = 42) -> DataFrame:
    """``df`` with a column ``<feature>_perm`` for each feature: its values dealt anew to the rows.

    Rows are numbered once, by ``record``, which is unique; the row at place p gives its value of feature j to the row at
    place that ``permuted_places`` gives p under that feature's keys. All features go through one shuffle as (place, feature, value)
    and meet the rows in one join. Places come from range-partitioned counts, so any number of rows is shuffled as
    one, and the result depends on the rows alone."""
    feats = list(feats)
    spec = SensorSpec(entity="_all", time_us=record, record=record)
    placed = add_sequence(df.withColumn("_all", F.lit(0)), spec).drop("_all").withColumnRenamed(SEQ, "_place")
    moved = permuted_places(placed, "_place", df.count(), {f"_to{j}": round_keys(seed, j) for j in range(1, len(feats) + 1)})
    given = F.array(*[F.struct(F.col(f"_to{j}").alias("place"), F.lit(j).alias("j"), F.col(f).cast("double").alias("v"))
                      for j, f in enumerate(feats, 1)])
    dealt = (moved.select(F.explode(given).alias("g")).groupBy(F.col("g.place").alias("_place"))
             .agg(*[F.max(F.when(F.col("g.j") == j, F.col("g.v"))).alias(f"{f}_perm") for j, f in enumerate(feats, 1)]))
    return placed.join(dealt, "_place").drop("_place")


def permutation_importance(df: DataFrame, feats, rescore, label: str, record: str, seed: int = 42):
    """AUC drop when one feature is shuffled across rows (``permuted``). ``rescore({feature: column})`` gives the score
    column from the columns to use for the features. Returns [(feature, auc_drop)] and the base AUC; all AUCs come
    from one pass."""
    feats = list(feats)
    d = permuted(df, feats, record, seed)
    own = {f: F.col(f) for f in feats}
    scores = {"_base": rescore(own)} | {f"_s{j}": rescore(own | {f: F.col(f"{f}_perm")}) for j, f in enumerate(feats)}
    found = aucs(d.select(label, *[c.alias(n) for n, c in scores.items()]), label, scores)
    return [(f, found["_base"] - found[f"_s{j}"]) for j, f in enumerate(feats)], found["_base"]
