import re
import struct
import zlib

import pytest
import xxhash
from conftest_llm import SF, needs_tables

from hazeflow.llm import queries, virtual_slots as V


def checked(found, rows, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str
    )
    assert {(r.law, r.grown_shard) for r in found} <= {("bytes", None)}
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert 0 <= shard < shards and slots == list(range(len(slots)))


def plain(rows, shards, slots):
    """Shard, place in it and virtual slot of each row: hashes, sums and dealing recomputed."""

    def slot_of(i, text):
        h = 42
        if i is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", i), h)
        if text is not None:
            h = xxhash.xxh64_intdigest(text.encode(), h)
        return (h - (1 << 64) if h >> 63 else h) % slots

    made = [(slot_of(i, t), i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows]
    sizes = [sum(r[3] for r in made if r[0] == s) for s in range(slots)]
    loads, shard = [0] * shards, {}
    for s in sorted(range(slots), key=lambda s: (-sizes[s], s)):
        shard[s] = loads.index(min(loads))
        loads[shard[s]] += sizes[s]
    next_place, out = [0] * shards, []
    for s, i, crc, size in sorted(made, key=lambda r: (r[0], r[1] is not None, r[1] or 0, *r[2:])):
        out.append((i, size, crc, shard[s], next_place[shard[s]], s))
        next_place[shard[s]] += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("shards,slots", [(8, 64), (3, 4096)])
def test_every_row_equals_brute_force(docs_of, folder, shards, slots):
    rows = [(i, "t" * (i * 37 % 90)) for i in range(300)] + [(None, "a"), (None, None), (5, "x"), (5, "x"), (5, None), (-3, "é" * 500)]
    df = V.sharded(docs_of(rows), folder("map"), shards, slots=slots)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    found = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.virtual_slot) for r in df.collect()]
    assert sorted(found, key=str) == plain(rows, shards, slots)


def test_a_map_of_another_shape_is_refused(docs_of, folder):
    docs = docs_of([(i, "t") for i in range(50)])
    V.sharded(docs, folder("map"), 4, slots=64)
    for shards, slots in ((4, 128), (8, 64), (3, 64)):
        with pytest.raises(ValueError):
            V.sharded(docs, folder("map"), shards, slots=slots)


@needs_tables
def test_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = queries.all_queries()["op5_virtual_slot_sharding"](spark, SF).collect()
    checked(found, rows, 8)
    loads = [sum(r.size for r in found if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) <= max(r.size for r in found)


def test_odd_rows(docs_of, folder):
    rows = [(1, None), (1, None), (None, "a"), (None, "a"), (2, ""), (2, "é"), (3, "x" * 200_000), *[(7, "hot")] * 50]
    checked(V.sharded(docs_of(rows), folder("map")).collect(), rows, 8)
    assert V.sharded(docs_of(rows).limit(0), folder("none")).count() == 0


def test_map_is_stored_and_reused(docs_of, spark, folder):
    first = V.sharded(docs_of([(i, "t" * i) for i in range(100)]), folder("map"))
    again = V.sharded(docs_of([(i, "t" * i) for i in range(100, 300)] + [(5, "t" * 5)]), folder("map"))
    shard = {r.doc_id: r.shard for r in first.collect()}
    assert {r.doc_id: r.shard for r in again.collect()}[5] == shard[5]
    assert V.stored_map(spark, folder("map")).count() == V.SLOTS


def test_rebalancing_moves_what_no_longer_fits(docs_of, spark, folder):
    rows = V.records(docs_of([(i, "t" * (i % 90)) for i in range(1500)]), slots=256)
    sizes = V.slot_sizes(rows, 256)
    V.store_map(V.first_map(sizes, 4), folder("map"))
    V.store_map(V.rebalanced(V.stored_map(spark, folder("map")), sizes, 5), folder("map"))
    old = {r.virtual_slot: r.shard for r in V.stored_map(spark, folder("map"), 0).collect()}
    new = {r.virtual_slot: r.shard for r in V.stored_map(spark, folder("map")).collect()}
    size = {r.virtual_slot: r.bytes for r in sizes.collect()}
    assert old.keys() == new.keys() == size.keys()
    moved = [s for s in old if old[s] != new[s]]
    assert {new[s] for s in moved} == {4} and sum(size[s] for s in moved) < 0.25 * sum(size.values())
    loads = [sum(size[s] for s in new if new[s] == shard) for shard in range(5)]
    assert max(loads) - min(loads) <= 2 * max(size.values())
    # a shard taken away: its slots move, the others stay
    fewer = {r.virtual_slot: r.shard for r in V.rebalanced(V.stored_map(spark, folder("map")), sizes, 4).collect()}
    assert set(fewer.values()) == set(range(4)) and all(fewer[s] == new[s] or new[s] == 4 for s in new)
