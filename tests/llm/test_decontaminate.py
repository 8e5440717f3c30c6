import hashlib
import random
import re

import pytest
from conftest_llm import SF, lower, needs_tables

from hazeflow.llm import decontaminate, queries


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def plain(docs, items, window):
    """(hit word numbers, item ids) of each text, window by window."""
    windows = {}
    for item, text in items:
        w = item_words(text)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k and item is not None else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(item))
    out = []
    for _, text in docs:
        w, hit, ids = item_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                found = windows.get(tuple(w[j : j + k]))
                if found:
                    ids |= found
                    hit.update(range(j, j + k))
        out.append((w, hit, ids))
    return out


@needs_tables
def test_query_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    items = queries.table(spark, SF, "benchmark").select("item_id", "text").collect()
    expected = {
        (d.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
        for d, (w, hit, ids) in zip(docs, plain(docs, items, 13))
    }
    assert {tuple(r) for r in queries.all_queries()["op9_benchmark_decontamination"](spark, SF).collect()} == expected


@pytest.mark.parametrize("block_words", [100_000, 120])
def test_blocks_and_short_items(spark, docs_of, block_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 9)
    draw = random.Random(1)
    docs = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 60)))) for i in range(80)]
    docs += [(None, None), (1, ""), (2, "É-x " * 3), (3, "x" * 100_000)]
    items = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 25)))) for i in range(30)] + [(None, "a"), (40, None), (41, "é X"), (41, "é X"), (42, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_passages(docs_of(docs), bench, window=6, name="result", block_words=block_words).collect()
    by_text = {t: (w, hit, ids) for (_, t), (w, hit, ids) in zip(docs, plain(docs, items, 6))}
    assert len(rows) == len(docs)
    for r in rows:
        w, hit, ids = by_text[r.text]
        got = {i for h in r.result["hits"] for i in range(h["first"], h["last"] + 1)}
        assert (r.result["n_words"], got, r.result["items"]) == (len(w), hit, sorted(ids))
        for h in r.result["hits"]:
            assert item_words(r.text[h["begin"] : h["end"]]) == w[h["first"] : h["last"] + 1]


def test_contaminated_documents_go(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))
    docs = docs_of([(1, item), (2, "x " * 500 + item), (3, "clean"), (4, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, max_length=15).collect()}
    assert cut == {2: "x " * 500, 3: "clean", 4: None}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()) == [1, 2, 3, 4]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
