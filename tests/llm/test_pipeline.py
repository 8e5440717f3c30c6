"""The pipeline against brute force, stage by stage, each on its own input."""

import corpus_pipeline
from conftest_llm import SF, needs_tables, words
from test_decontaminate import plain as plain_passages
from test_near_copies import plain_groups
from test_suffix_dedup import plain as plain_repeats
from test_word_bpe import plain as plain_tokens, told

from hazeflow.llm import mil_quality, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@needs_tables
def test_stages_equal_brute_force(spark, folder):
    docs = queries.table(spark, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    outputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(folder(str(k)))
        outputs.append((docs, spark.read.parquet(folder(str(k)))))
        docs = outputs[-1][1]
    texts = [({r.doc_id: r.text for r in a.collect()}, b) for a, b in outputs]
    assert len(names) == 5 and all(b.columns == COLUMNS for _, b in texts[:-1])

    before, after = texts[0]
    model = mil_quality.fit(outputs[0][0], queries.table(spark, SF, "labels"))
    good = {r.doc_id for r in mil_quality.scored(outputs[0][0], model).collect() if r.predicted == 1}
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t in before.items() if i in good}

    before, after = texts[1]
    kept = set(plain_groups(list(before.items())))
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t in before.items() if i in kept}

    before, after = texts[2]
    hits = plain_repeats(list(before.items()), 50)
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(before) and hits
    for r in rows:
        assert words(r.text) == [w for k, w in enumerate(words(before[r.doc_id])) if k not in hits.get(r.doc_id, ())]
        assert r.n_chars == len(r.text) and (r.doc_id in hits or r.text == before[r.doc_id])

    before, after = texts[3]
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    found = plain_passages(list(before.items()), items, 13)
    clean = {i for i, (w, hit, _) in zip(before, found) if not (hit and 20 * len(hit) >= len(w))}
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t in before.items() if i in clean}

    before, after = texts[4]
    assert told(after) == plain_tokens(list(before.items()))


@needs_tables
def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < rows.count() < 200
