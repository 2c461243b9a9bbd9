"""Window scoring with and without warm-up rows."""

from pyspark.sql import functions as F

from conftest import SF001
from rigscope.config import EVENTS_SPEC
from rigscope.plans.catalog import clean, scored
from rigscope.plans.scoring import score_window


def test_warmup_equals_full_scoring_and_no_warmup_differs(spark):
    s = scored(spark, SF001)
    c = clean(spark, SF001)
    start, end = "2024-01-20", "2024-01-25"
    warm = score_window(c, EVENTS_SPEC, s, start, end, warmup=True).select("record_id", F.col("anomaly_score").alias("w"))
    cold = score_window(c, EVENTS_SPEC, s, start, end, warmup=False).select("record_id", F.col("anomaly_score").alias("c"))
    full = s.frame.select("record_id", F.col("anomaly_score").alias("f"))
    j = warm.join(full, "record_id").join(cold, "record_id")
    n = warm.count()
    assert n > 0 and j.count() == n
    assert j.filter(F.abs(F.col("w") - F.col("f")) > 1e-9).count() == 0
    assert j.filter(F.abs(F.col("c") - F.col("f")) > 1e-9).count() > 0      # first rows lose their history
