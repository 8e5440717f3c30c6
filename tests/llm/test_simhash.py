import random

import numpy as np
import pytest
import xxhash
from conftest_llm import SF, lower, needs_tables, words

from hazeflow.llm import components, queries, simhash


def plain_fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius=2):
    """Smallest id reachable, by comparing all pairs."""
    prints = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for k in range(len(prints)):
        groups.setdefault(find(k), []).append(ids[k])
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(prints))]


@needs_tables
def test_query_equals_brute_force(spark):
    rows = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    expected = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components(prints, [r.doc_id for r in rows]))}
    got = {tuple(r) for r in queries.all_queries()["op2_simhash_near_dedup"](spark, SF).collect()}
    assert got == expected


def test_odd_rows(docs_of):
    long = " ".join(str(i % 997) for i in range(200_000))
    rows = [(5, "A b c d"), (4, "a B c d"), (4, "a B c d"), (None, "a b c d"), (7, None), (8, ""), (9, " \t\n"), (10, "x"), (None, "only here"), (11, long)]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got) == sorted(
        (i or -1, f"{plain_fingerprint(t):016x}", c)
        for (i, t), c in zip(rows, plain_components([plain_fingerprint(t) for _, t in rows], [i for i, _ in rows]))
    )


def test_one_of_each_stays(docs_of):
    rows = [(5, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (7, "other words here"), (None, "bare"), (None, "bare")]
    kept = simhash.keep_one_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, "a b c d"), (7, "other words here"), (None, "bare")], key=str)


def test_empty(docs_of):
    assert simhash.near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0
    assert simhash.keep_one_each(docs_of([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("segments,block", [(4, 4096), (8, 4096), (4, 8), (8, 3)])
def test_links_connect_what_pairs_connect(spark, monkeypatch, segments, block):
    """Also with tiles cut into blocks, and with a dense ball of fingerprints."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(3)
    centre = draw.getrandbits(64)
    prints = {draw.getrandbits(64) for _ in range(200)} | {centre ^ (1 << i) for i in range(40)} | {centre ^ (7 << i) for i in range(0, 60, 5)}
    for p in list(prints)[:60]:
        prints |= {p ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)), p ^ (7 << draw.randrange(60))}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    found = {r.node: r.root for r in components.components(simhash.fingerprint_links(nodes, 2, segments)).collect()}
    expected = plain_components(prints, signed)
    assert [found.get(x, x) for x in signed] == expected


def test_long_chain(spark):
    """A path needs many steps by neighbours, few rounds by stars."""
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
