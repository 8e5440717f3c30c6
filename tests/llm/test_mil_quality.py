import zlib

import numpy as np
import pyarrow as pa
from conftest_llm import SF, needs_tables

from hazeflow.llm import mil_quality, queries


@needs_tables
def test_held_out_accuracy(spark):
    found = queries.all_queries()["op7_attention_quality_classifier"](spark, SF).toPandas()
    docs = queries.table(spark, SF, "documents")
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert ((found.score >= 0.3).astype(int) == found.predicted).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(found.doc_id, found.held_out))
    labelled = found.merge(queries.table(spark, SF, "labels").toPandas(), on="doc_id")
    held = labelled[labelled.held_out]
    assert (held.predicted == held.quality).mean() >= 0.9
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() >= 0.95


def test_labels_of_the_held_out_fold_are_not_read(spark, docs_of):
    docs = docs_of([(i, ("plain words here " if i % 2 else "$$$ !!! ### ") * 30) for i in range(60)])
    labels = [(i, i % 2) for i in range(60)]
    changed = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels] + [(None, 1), (3, None)]
    scores = []
    for rows in (labels, changed):
        model = mil_quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        scores.append(sorted(tuple(r) for r in mil_quality.scored(docs, model).select("doc_id", "score").collect()))
    assert scores[0] == scores[1]


def test_gradient_is_the_slope():
    draw = np.random.default_rng(1)
    x, bags, label = draw.normal(size=(9, mil_quality.FEATURES)), np.array([2, 3, 4]), np.array([1.0, 0.0, 1.0])
    model = mil_quality.fit_bags(x, bags, label, epochs=1)

    def loss():
        p = model.forward(x, bags)["p"]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    slopes = model.gradient(model.forward(x, bags), bags, label)
    for name, grad in slopes.items():
        at = tuple(n // 2 for n in model.weights[name].shape)
        before = model.weights[name][at]
        model.weights[name][at] = before + 1e-5
        high = loss()
        model.weights[name][at] = before - 1e-5
        low = loss()
        model.weights[name][at] = before
        assert np.isclose((high - low) / 2e-5, grad[at], atol=1e-6)


def test_passages_cover_the_whole_text():
    texts = [None, "", " \n", "one", "a b " * 200, "é🙂 " * 129]
    x, bags = mil_quality.encode_passages(pa.array(texts))
    assert bags.tolist() == [1, 1, 1, 1, 4, 2] and x.shape == (10, mil_quality.FEATURES) and np.isfinite(x).all()
    for text, n, end in zip(texts, bags, np.cumsum(bags)):  # a text's vectors do not depend on its neighbours
        alone, _ = mil_quality.encode_passages(pa.array([text], pa.string()))
        assert np.allclose(alone, x[end - n : end], atol=1e-6)


def test_odd_rows(spark, docs_of):
    rows = [(None, "x"), (1, None), (1, None), (2, ""), (3, "word " * 50_000)]
    one_class = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    model = mil_quality.fit(docs_of(rows), one_class)
    got = sorted((tuple(r) for r in mil_quality.scored(docs_of(rows), model).collect()), key=str)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 1.0, 1), (1, 1.0, 1), (2, 1.0, 1), (3, 1.0, 1), (None, 1.0, 1)]
    unknown = mil_quality.fit(docs_of(rows), one_class.limit(0))
    assert unknown.constant == 0.5
    assert mil_quality.keep_good(docs_of(rows), unknown).columns == docs_of(rows).columns
    assert mil_quality.scored(docs_of(rows).limit(0), model).count() == 0
