import math
import random

import pytest
from pyspark.sql import functions as F

from hazeflow.operators.lookups import band_join

SCHEMA = "low double, high double, index_low double, index_high double"


def plain(x, bands):
    if x is None or math.isnan(x):
        return None
    held = sorted(b for b in bands if None not in b[:2] and not math.isnan(b[0] + b[1]) and b[0] <= x <= b[1])
    if not held:
        return None
    low, high, i, j = held[0]
    return i if low == high else (j - i) / (high - low) * (x - low) + i


def found(spark, values, bands):
    rows = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    out = band_join(rows, "x", spark.createDataFrame(bands, SCHEMA))
    assert out.columns == ["id", "x", "band_index"]
    return [r.band_index for r in out.orderBy("id").collect()]


def test_bands_equal_brute_force(spark):
    rng = random.Random(5)
    starts = [rng.uniform(-50, 500) for _ in range(60)]
    bands = [(s, s + 10 ** rng.uniform(-3, 2.5), float(rng.randrange(9)), float(rng.randrange(9, 90))) for s in starts]
    bands += [(7.0, 7.0, 3.0, 8.0), (7.0, 9.0, 1.0, 2.0), bands[0], (5.0, 4.0, 1.0, 2.0), (None, 3.0, 1.0, 2.0), (1.0, math.nan, 1.0, 2.0)]
    ends = [e for b in bands[:60] for e in b[:2]]
    values = [rng.uniform(-80, 700) for _ in range(300)] + ends + [7.0, 9.0, -1e300, math.inf, -math.inf, math.nan, None, 7.0]
    got = found(spark, values, bands)
    assert got == [plain(x, bands) for x in values]
    assert None in got[:300] and sum(g is not None for g in got) > 200


def test_gaps_and_ends(spark):
    bands = [(0.0, 12.0, 0.0, 50.0), (12.1, 35.4, 51.0, 100.0)]
    assert found(spark, [0.0, 12.0, 12.05, 12.1, 35.4, 35.5], bands) == [0.0, 50.0, None, 51.0, 100.0, None]


def test_empty_single_and_infinite(spark):
    assert found(spark, [1.0, None], []) == [None, None]
    assert found(spark, [1.0, 2.0, None], [(2.0, 2.0, 5.0, 6.0)]) == [None, 5.0, None]
    assert found(spark, [], [(1.0, 2.0, 5.0, 6.0)]) == []
    with pytest.raises(ValueError, match="finite"):
        found(spark, [1.0], [(0.0, math.inf, 1.0, 2.0)])


def test_plan_has_no_nested_loop_and_other_columns_stay(spark):
    rows = spark.range(100).select(F.col("id").cast("double").alias("a.b"), F.lit("kept").alias("low"), F.lit(0).alias("level"))
    out = band_join(rows, "a.b", spark.createDataFrame([(0.0, 50.0, 0.0, 1.0), (60.0, 61.0, 2.0, 3.0)], SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.columns == ["a.b", "low", "level", "band_index"] and out.filter("low = 'kept' AND band_index IS NOT NULL").count() == 53
