"""Near copies against a comparison of all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from conftest_llm import SF, lower, needs_tables, words

from hazeflow.llm import near_copies, queries, simhash


def plain_set(text):
    w = words(lower(text))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def plain_groups(rows):
    """Smallest id reachable over pairs with a similarity of 0.8 or more."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids.setdefault(find(k), []).append(i)
    return [min(ids.get(find(k), [None])) for k in range(len(rows))]


def edited(draw, base, edits):
    """`base` with some words replaced."""
    out = list(base)
    for k in draw.sample(range(len(out)), edits):
        out[k] = f"x{draw.randrange(10**9)}"
    return " ".join(out)


def corpus():
    draw = random.Random(5)
    rows = []
    for _ in range(12):
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(20, 200))]
        rows += [edited(draw, base, draw.randrange(0, max(1, len(base) // 30) + 1)) for _ in range(6)]
    line = " ".join(f"l{i}" for i in range(12))  # a line that many dissimilar texts begin with
    rows += [f"{line} " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(3, 60))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small,common,block", [(64, 500_000, 1 << 20), (2, 500_000, 1 << 20), (2, 0, 1 << 20), (2, 0, 100)])
def test_groups_equal_brute_force(docs_of, monkeypatch, small, common, block):
    """Also with large buckets, cut into blocks, and in an order that leaves common shingles where they are."""
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = corpus()
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs_of(rows)).collect()}
    expected = plain_groups(rows)
    assert [got[i] for i, _ in rows] == expected and 72 < len(set(expected)) < 132


def test_stage_drops_edited_copies(spark, docs_of):
    """Similar by 0.8 to 0.9, and farther apart than two bits of the fingerprint."""
    draw = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, edited(draw, base, 4)), (3, edited(draw, base, 5)), (4, edited(draw, base, 40))]
    kept = corpus_pipeline.simhash_near_dedup(spark, docs_of(rows), None).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4]


def test_odd_rows(docs_of):
    rows = [(5, "A b c d"), (4, "a B c d"), (4, "a B c d"), (None, "a b c d"), (7, None), (8, ""), (9, " \t\n"), (10, "x"), (None, "only here"), (None, "only here")]
    got = near_copies.near_copies(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(zip((i for i, _ in rows), plain_groups(rows)), key=str)
    kept = near_copies.keep_one_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, "a B c d"), (7, None), (10, "x"), (None, "only here")], key=str)
    assert near_copies.keep_one_each(docs_of(rows).limit(0)).count() == 0


@needs_tables
def test_sample_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == dict(zip((i for i, _ in rows), plain_groups(rows)))


def test_sketches_rule_out_no_similar_pair():
    """Differing bits never exceed the shingles in one set only, at equal and at folded sizes."""
    draw = np.random.default_rng(3)
    for n in (1, 5, 63, 64, 65, 500, 3000):
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        for gone, new in ((0, 0), (n // 10, 0), (0, n // 10), (n // 9, n // 9), (n, n)):
            b = np.union1d(a[gone:], draw.integers(0, 1 << 63, max(new, gone == n)).astype(np.uint64))
            x, y = (np.frombuffer(near_copies._sketch(s), np.uint64) for s in (a, b))
            while len(x) != len(y):
                x, y = (near_copies._folded(s) if len(s) == max(len(x), len(y)) else s for s in (x, y))
            differing = int(np.bitwise_count(x ^ y).sum())
            assert differing <= len(np.setxor1d(a, b))
            similar = 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
            assert not (similar and near_copies._apart(len(a), len(b), differing))
            assert gone < n or n < 500 or near_copies._apart(len(a), len(b), differing)


def test_sets_travel_only_for_plausible_pairs(docs_of, monkeypatch):
    """Texts that share a line but are not similar meet, in small buckets and large ones, and need no whole sets."""
    wanted, sets_of = [], near_copies._sets_of
    monkeypatch.setattr(near_copies, "_sets_of", lambda keys, texts: wanted.append(keys.distinct().count()) or sets_of(keys, texts))
    for small in (64, 2):
        monkeypatch.setattr(near_copies, "SMALL", small)
        draw = random.Random(8)
        line = " ".join(f"l{i}" for i in range(40))
        rows = [(i, f"{line} " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(60))) for i in range(40)]
        got = near_copies.near_copies(docs_of(rows)).collect()
        assert sorted(r.component_id for r in got) == list(range(40))
    assert sum(wanted) == 0


def test_links_of_the_fingerprints_are_kept(spark, docs_of):
    """Texts within two bits of the operator's fingerprint are one group, also where their sets are less similar than 0.8."""
    draw = random.Random(3)
    rows, groups = [], 0
    while groups < 3:  # texts that repeat a passage, with a few words changed between the repeats
        passage = [f"w{draw.randrange(10**6)}" for _ in range(12)]
        pair = [" ".join(w for k in range(30) for w in [*passage, *(f"x{draw.randrange(10**6)}" for _ in range(k % 3 == 0))]) for _ in range(2)]
        a, b = (plain_set(t) for t in pair)
        if (simhash.fingerprint(pair[0].encode()) ^ simhash.fingerprint(pair[1].encode())).bit_count() <= 2 and 5 * len(a & b) < 4 * len(a | b):
            rows += [(10 * groups + k, t) for k, t in enumerate(pair)]
            groups += 1
    rows.append((99, "quite another text of a few words"))
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert linked == {0: 0, 1: 0, 10: 10, 11: 10, 20: 20, 21: 20, 99: 99}
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs_of(rows)).collect()} == linked
    kept = corpus_pipeline.simhash_near_dedup(spark, docs_of(rows), None).collect()
    assert sorted(r.doc_id for r in kept) == [0, 10, 20, 99]
