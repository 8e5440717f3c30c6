import random
from collections import defaultdict

import pytest
from conftest_llm import SF, needs_tables, words

from hazeflow.llm import queries, suffix_dedup


def plain(rows, size):
    """Words of each document in windows that a document with a smaller id has."""
    first, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    for i, text in rows:
        w = words(text)
        hit = {k for j in range(len(w) - size + 1) if i is not None and first[tuple(w[j : j + size])] < i for k in range(j, j + size)}
        if hit:
            out[i] = hit
    return out


def covered(df):
    out = defaultdict(set)
    for r in df.collect():
        assert r.n_words == r.end_word - r.begin_word and r.source_doc_ids and max(r.source_doc_ids) < r.doc_id
        out[r.doc_id].update(range(r.begin_word, r.end_word))
    return dict(out)


def small(seed=2):
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.choice("ab" if i % 2 else "abcdef") for _ in range(draw.randint(0, 80)))) for i in range(120)]
    return rows + [(900, None), (901, ""), (902, "a"), (None, "a b a b a b a b a b a b a b"), (903, "é ü\n\n" * 30), (904, "\té ü " * 30)]


@needs_tables
def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert covered(queries.all_queries()["op10_suffix_array_dedup"](spark, SF)) == plain(rows, 50)


@pytest.mark.parametrize("size,gram", [(8, 4), (6, 6), (12, 5)])
def test_small_alphabet(docs_of, size, gram):
    assert covered(suffix_dedup.repeated_passages(docs_of(small(), 5), min_words=size, gram=gram)) == plain(small(), size)


def test_beyond_the_broadcast_bound(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", 0)
    assert covered(suffix_dedup.repeated_passages(docs_of(small(), 5), min_words=8, gram=4)) == plain(small(), 8)


def test_removal_keeps_rows_and_columns(docs_of):
    docs, hits = docs_of(small(), 5), plain(small(), 8)
    out = suffix_dedup.remove_repeats(docs, min_words=8, gram=4)
    assert out.columns == docs.columns
    texts = dict(small())
    rows = out.collect()
    assert len(rows) == len(small())
    for r in rows:
        if r.text is None:
            assert texts[r.doc_id] is None
            continue
        assert words(r.text) == [w for k, w in enumerate(words(texts[r.doc_id])) if k not in hits.get(r.doc_id, ())]
        assert r.n_chars == len(r.text)


def test_repeats(docs_of):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (1, passage), (2, "x " + passage + " y"), (3, passage + "\n" + passage), (3, "another text of id three")]
    out = sorted((r.doc_id, r.text) for r in suffix_dedup.remove_repeats(docs_of(rows)).collect())
    assert out == [(1, passage), (1, passage), (2, "x y"), (3, ""), (3, "another text of id three")]
    inside = [(1, passage + " " + passage)]
    assert suffix_dedup.repeated_passages(docs_of(inside)).count() == 0
    assert suffix_dedup.repeated_passages(docs_of(inside).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(docs_of(inside), min_words=5, gram=9)


def test_runs_that_span_batches():
    """A run of equal grams is kept whole once it has two documents, wherever batches end."""
    import pyarrow as pa

    rows = [(1, 0, 7, 0), (2, 0, 1, 0), (2, 0, 1, 1), (2, 0, 1, 1), (2, 3, 5, 0), (2, 3, 6, 0), (3, 0, 4, 0), (3, 0, 4, 1), (4, 0, 1, 0), (4, 0, 2, 0), (5, 0, 9, 0)]
    names = ["gram", "around", "doc", "place"]
    for size in (1, 2, 3, 11):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        kept = [tuple(r.values()) for b in suffix_dedup._shared(iter(batches)) for r in b.to_pylist()]
        # the first and the last run may go on in the neighbouring partitions; repeated rows are one
        assert [r[:4] for r in kept] == [r for k, r in enumerate(rows) if r[0] != 3 and k != 3]
        assert [r[4] for r in kept] == [7, 1, 1, 5, 5, 1, 1, 9] and [r[6] for r in kept] == [True] + [False] * 7


def test_runs_that_span_partitions(spark, docs_of):
    """A passage that most documents share fills several range partitions; all know its first document."""
    passage = " ".join(f"w{i}" for i in range(150))
    rows = [(i, f"{passage} own {i}" if i % 5 else f"other {i}") for i in range(1, 400)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = suffix_dedup.repeated_passages(docs_of(rows, 8))
        got = covered(found)
        assert got == plain(rows, 50) and all(r.source_doc_ids[0] == 1 for r in found.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
