"""Paragraph sketches against brute force."""

import hashlib
import re

import pytest
from conftest_llm import SF, needs_tables
from pyspark.sql import functions as F

from hazeflow.llm import paragraph_sketch, queries

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def cut(text, piece):
    return set(re.findall(f"[^\\n]{{1,{piece}}}", text))


def like(a, b, piece):
    a, b = cut(a, piece), cut(b, piece)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows, piece=paragraph_sketch.PIECE):
    """Results without the fingerprints of rows with distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(text, edited, piece), like(text, following, piece)))
    return sorted(out, key=repr)


def told(df):
    assert df.columns == COLUMNS
    rows = df.collect()
    # `own` is compared with `edited`: the first version's share, so both agree with brute force up to the last bit
    return rows, sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows), key=repr)


def test_odd_rows(docs_of):
    line = "the same line in every text\n"
    rows = [
        (1, None), (2, ""), (3, "x"), (4, "\n\n\n"), (5, line * 9), (6, line + "another é \U0001f600 line\r\n" * 3), (None, "no id\n" + line),
        (8, "".join(f"line {i} of a very long text\n" for i in range(6000))), (9, "".join(f"line {i} of a very long text\n" for i in range(10, 6010))),
        (10, "".join(f"line {i} of a very long text\n" for i in range(10, 6010))), (-11, line + "z" * 5000),
    ]
    found, values = told(paragraph_sketch.fingerprints(docs_of(rows), piece=16))
    assert values == plain(rows, 16)
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[9] == prints[10] and prints[1] == prints[2] and len(set(prints.values())) == 8  # 1, 2 and 4 have no piece
    assert {r.doc_id: r.near_next for r in found}[9] == 1.0


def test_repeated_rows_are_one_document(docs_of):
    rows = [(1, "first\ntext"), (2, "second\ntext"), (2, "second\ntext"), (2, "another\ntext")]
    found, values = told(paragraph_sketch.fingerprints(docs_of(rows), piece=3))
    assert len(values) == 4 and len(set(values)) == 3
    assert {v[0] for v in values} == {1, 2} and paragraph_sketch.fingerprints(docs_of([])).count() == 0


def test_a_single_document_is_its_own_next(docs_of):
    _, values = told(paragraph_sketch.fingerprints(docs_of([(7, "abcd\nefgh")])))
    assert values == plain([(7, "abcd\nefgh")])


@pytest.mark.parametrize("size", [4, 512])
def test_peeling_recovers_the_differing_digests(spark, folder, size):
    """A sketch that is too small is made again, larger, until it decodes."""
    sets = {0: (range(0, 300), range(100, 420)), 1: (range(5), range(5)), 2: (range(0), range(7)), 3: (range(1), range(0))}
    rows = [(p, 0, sign, [(v * 2654435761 * 97) % 2**61 for v in side]) for p, pair in sets.items() for sign, side in zip((1, -1), pair)]
    spark.createDataFrame(rows, "pair long, kind int, sign int, digests array<long>").write.parquet(folder("sides"))
    spark.createDataFrame([(p, 0, size) for p in sets], "pair long, kind int, size int").write.parquet(folder("sizes"))
    found = paragraph_sketch.differences(spark.read.parquet(folder("sides")), spark.read.parquet(folder("sizes")), recovered=True)
    by_pair = {r[0]: [set(), set()] for r in rows}
    for p, _, sign, digests in rows:
        by_pair[p][sign < 0] = set(digests)
    expected = {p: (a - b, b - a) for p, (a, b) in by_pair.items() if a != b}
    got = {r.pair: (set(r.a_digests), set(r.b_digests)) for r in found.collect()}
    assert got == expected
    assert all((r.a_only, r.b_only) == tuple(map(len, expected[r.pair])) for r in found.collect())


def test_attempts_are_bounded(spark, folder):
    rows = [(0, 0, 1, list(range(1, 200)))]
    spark.createDataFrame(rows, "pair long, kind int, sign int, digests array<long>").write.parquet(folder("sides"))
    spark.createDataFrame([(0, 0, 1)], "pair long, kind int, size int").write.parquet(folder("sizes"))
    with pytest.raises(RuntimeError):
        paragraph_sketch.differences(spark.read.parquet(folder("sides")), spark.read.parquet(folder("sizes")), attempts=2)


@needs_tables
def test_sample_table(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    df = queries.all_queries()["op12_paragraph_sketches"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan
    found, values = told(df)
    assert values == plain(rows)
    texts = dict(rows)
    prints = {}
    for r in found:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(r.near_edited > r.near_next for r in found) > 0.9 * len(found)


def test_pieces_are_native(spark):
    row = spark.createDataFrame([("ab\ncde\nab",)], "t string").select(F.size(paragraph_sketch.pieces(F.col("t"), 2)).alias("n")).first()
    assert row.n == 3
