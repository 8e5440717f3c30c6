import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hazeflow.operators import ordering as O


def sample(spark, n=2000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), i, rng.choice([None, float(rng.randrange(50))])) for i in rng.sample(range(10 * n), n)]
    return spark.createDataFrame(rows, "city string, t int, v double"), pd.DataFrame(rows, columns=["city", "t", "v"])


def test_positions_are_the_sorted_order(scattered):
    df, pdf = sample(scattered)
    got = O.order_index(df, ["city", "t"]).toPandas()
    assert got[O.PART].nunique() > 1
    ordered = pdf.sort_values(["city", "t"]).reset_index(drop=True)
    got = got.sort_values(O.POS).reset_index(drop=True)
    assert got[O.POS].tolist() == list(range(len(pdf)))
    assert got["t"].tolist() == ordered["t"].tolist()


def test_many_rows_of_a_key_fill_several_partitions(scattered):
    df = scattered.range(4000).select(F.lit("a").alias("city"), F.lit(1).alias("t"), "id")
    sizes = O.order_index(df, ["city", "t"]).groupBy(O.PART).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2000


def test_blocks_smaller_than_the_offset(scattered):
    df, pdf = sample(scattered, 500)
    rows = O.row_blocks(O.order_index(df, ["city", "t"]), after=72, block=16)
    w = O.block_window(rows)
    rows = rows.withColumn("ahead", F.when(O.same_series(w, ["city"], 72), F.lead("t", 72).over(w)))
    got = O.own_rows(rows).toPandas().sort_values(["city", "t"])
    expected = pdf.sort_values(["city", "t"]).groupby("city")["t"].shift(-72)
    pd.testing.assert_series_equal(got["ahead"].reset_index(drop=True), expected.reset_index(drop=True), check_names=False, check_dtype=False)


def test_running_values_cross_partitions(scattered):
    df, pdf = sample(scattered)
    laid = O.lay_out(df, ["city", "t"])
    assert laid.select(O.PART).distinct().count() > 1
    run = O.running_with_carry(laid, ["city"], totals={"total": F.coalesce("v", F.lit(0.0))}, forward=["v"], backward=["v"])
    got = run.toPandas().sort_values(["city", "t"]).reset_index(drop=True)
    ordered = pdf.sort_values(["city", "t"]).reset_index(drop=True)
    by_city = ordered.groupby("city")["v"]
    assert got["total"].tolist() == ordered["v"].fillna(0).groupby(ordered["city"]).cumsum().tolist()
    pd.testing.assert_series_equal(got["v__prev"], by_city.ffill(), check_names=False)
    pd.testing.assert_series_equal(got["v__next"], by_city.transform(lambda s: s.bfill().shift(-1)), check_names=False)


def test_quantiles_match_numpy(scattered):
    rng = np.random.default_rng(3)
    sets = {"few": rng.integers(0, 5, 1001).astype(float), "many": rng.normal(size=2000), "one": np.array([7.0]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in sets.items() for v in vs] + [("none", None), ("few", None)]
    counts = O.value_counts(scattered.createDataFrame(rows, "g string, x double"), ["g"], "x")
    got = {r.g: (r.a, r.b, r.c) for r in O.quantiles(counts, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    assert set(got) == set(sets)
    for k, vs in sets.items():
        np.testing.assert_allclose(got[k], np.quantile(vs, [0.25, 0.5, 0.9]), rtol=1e-12)
