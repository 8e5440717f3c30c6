"""The Merkle manifest against brute force."""

import hashlib
import zlib

import pytest
from conftest_llm import SF, lower, needs_tables
from pyspark.sql import functions as F

from hazeflow.llm import merkle, queries

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, `odd.name` int"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """The root, and for each leaf its runs from leaf to root as (siblings before, siblings after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            begin = i - i % 8
            paths[leaf].append((nodes[begin:i], nodes[i + 1 : begin + 8]))
        nodes = [sha(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def plain(rows):
    """Sorted result rows of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = sha(map(part, (doc_id, source, lang, n_chars, text)))
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        start = sha(map(part, (doc_id, source, lang, n_chars, None if text is None else lower(text)))) if tampered else leaf
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, start))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    lower_trees = []
    for lang in order:
        groups[lang].sort(key=lambda g: g[0])
        lower_trees.append(tree([g[2] for g in groups[lang]]))
    root, upper = tree([t[0] for t in lower_trees]) if order else (None, [])
    out = []
    for k, lang in enumerate(order):
        subroot, paths = lower_trees[k]
        for (_, doc_id, leaf, folded), path in zip(groups[lang], paths):
            path = path + upper[k]
            for before, after in path:
                folded = sha([*before, folded, *after])
            out.append((doc_id, leaf, subroot, root, sha(x for b, a in path for x in [*b, *a]), folded, folded == root))
    return sorted(out, key=repr)


def told(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def manifest(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, **options)


def made(sizes):
    return [(1000 * k + i, f"Text {i} É\n", lang, "web", i) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 8}, {"en": 9, "de": 1, "é": 64}, {None: 65, "": 7, "fr": 2}])
def test_sizes(spark, sizes):
    rows = made(sizes)
    expected = plain(rows)
    assert told(manifest(spark, rows)) == expected
    if sizes:
        assert told(manifest(spark, rows, height=1)) == expected


def test_many_languages_and_superblocks(spark):
    rows = made({**{f"l{i:03}": 1 for i in range(70)}, "en": 530})
    assert told(manifest(spark, rows, height=2)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (1, None, None, None, None), (1, "", "en", "", 0), (2, "A" * 300_000 + "é", "en", "s", 1),
        (2, "ties", "en", "s", 1), (2, "Ties", "en", "s", 1), *[(7, "Copy", "en", "s", 4)] * 20, (-8, "Ünder", "en", None, -1), (None, "X", "en", "s", 2),
    ]
    found = told(manifest(spark, rows, height=1))
    assert found == plain(rows) and any(r[-1] for r in found) and not all(r[-1] for r in found)


def test_untampered_rows_verify(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in made({"en": 20})], SCHEMA)
    assert merkle.manifest(docs).filter("not verified").count() == 0


@needs_tables
def test_sample_table(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert told(queries.all_queries()["op11_merkle_manifest"](spark, SF)) == plain(rows)
