"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are cut into equal segments; the population counts of the segments name a tile. Two
fingerprints at most `radius` bits apart have tile counts at most `radius` apart in sum, so a
fingerprint meets its own tile and the few neighbouring ones only, and all other tile pairs are
skipped without loss. Inside a tile pair numpy compares blocks by exclusive-or and bit counts.

Equal fingerprints are one node before any comparison (map-side aggregate), a tile with more than
`BLOCK` nodes is cut into blocks, and a block emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from hazeflow.llm.components import components
from hazeflow.llm.frames import col, free_name, slices, utf8
from hazeflow.scratch import materialize

SHINGLE_WORDS = 3
RADIUS = 2
BITS = 64
SEED = 42
BLOCK = 4096  # nodes of a tile that one task compares with; larger tiles are cut, not dropped
COARSE_NODES = 1_000_000  # beyond it, tiles are named by eight segment counts instead of four
HASHED_AT_ONCE = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The integer whose bit is set where over half of the hashes have it set."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for begin in range(0, n, HASHED_AT_ONCE):
        part = hashes[begin : begin + HASHED_AT_ONCE]
        lanes = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        # eight one-byte counters in each lane; 255 rows at most, so none overflows
        sums = np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = (begins + sizes)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[b:e], SEED) for b, e in zip(begins.tolist(), ends))
    return majority(np.fromiter(hashes, np.uint64, len(ends)))


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a signed long; null and wordless texts give 0."""

    @arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, shingle_words) for part in slices(texts) for t in utf8(part)]
        return pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())

    return compute.asNondeterministic()(text)


def _tile(fp: Column, segments: int) -> Column:
    """Population counts of the segments, one byte each, two added so that no neighbour is negative."""
    width = BITS // segments
    mask = (1 << width) - 1
    tile = F.lit(0).cast("long")
    for i in range(segments):
        ones = F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask).cast("long")))
        tile = tile + F.shiftleft((ones + F.lit(2)).cast("long"), 8 * i)
    return tile


def _neighbours(segments: int, radius: int) -> list[int]:
    """Offsets of the neighbouring tiles, one of each pair of opposite ones, own tile left out."""
    found = []
    for places in itertools.combinations_with_replacement(range(segments), radius):
        for signs in itertools.product((-1, 0, 1), repeat=radius):
            step = [0] * segments
            for place, sign in zip(places, signs):
                step[place] += sign
            first = next((s for s in step if s), 0)
            if first > 0 and sum(map(abs, step)) <= radius:
                found.append(sum(s << (8 * i) for i, s in enumerate(step)))
    return sorted(set(found))


def _settle(labels: np.ndarray, probe: np.ndarray, resident: np.ndarray) -> np.ndarray:
    """Lower the residents' labels until residents that share a probe have one label."""
    starts = np.flatnonzero(np.r_[True, probe[1:] != probe[:-1]])
    group = np.cumsum(np.r_[True, probe[1:] != probe[:-1]]) - 1
    while True:
        least = np.minimum.reduceat(labels[resident], starts)[group]
        lowered = labels.copy()
        np.minimum.at(lowered, labels[resident], least)  # the label's own node first, then all that bear it
        np.minimum.at(lowered, resident, least)
        while not np.array_equal(lowered, lowered[lowered]):
            lowered = lowered[lowered]
        if np.array_equal(lowered, labels):
            return labels
        labels = lowered


def _block_links(residents: np.ndarray, probes: Iterator[np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the block connects: each linked probe once, then a forest of the residents."""
    labels = np.arange(len(residents))
    for part in probes:
        for begin in range(0, len(part), 512):
            chunk = part[begin : begin + 512]
            p, r = np.nonzero(np.bitwise_count(chunk[:, None] ^ residents[None, :]) <= radius)
            if len(p):
                first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                yield chunk[p[first]], residents[r[first]]
                labels = _settle(labels, p, r)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    if len(moved):
        yield residents[moved], residents[labels[moved]]


def _compare_tiles(radius: int):
    """Rows come sorted by block with the residents first; a block may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(links):
            for a, b in links:
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], names=["a", "b"])

        key, residents, probes = None, [], []
        def finish():
            if residents:
                whole = np.concatenate(residents)
                yield from emit(_block_links(whole, iter([whole, *probes]), radius))

        for batch in batches:
            tile, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            probe, fp = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (block[1:] != block[:-1])]) if len(tile) else []
            for begin, end in zip(edges, [*edges[1:], len(tile)]):
                if key != (tile[begin], block[begin]):
                    yield from finish()
                    key, residents, probes = (tile[begin], block[begin]), [], []
                own = probe[begin:end]
                if not own.all():
                    residents.append(fp[begin:end][~own])
                if own.any() and residents:  # probes of an empty block meet nobody
                    probes.append(fp[begin:end][own])
        yield from finish()

    return run


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints at most `radius` bits apart, enough to connect them all.

    `nodes` has distinct non-null longs in `fp`.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    if segments is None:
        segments = 4 if nodes.count() <= COARSE_NODES else 8
    tiled = nodes.select("fp", _tile(F.col("fp"), segments).alias("tile"))
    crowded = (
        tiled.groupBy("tile")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > BLOCK)
        .select("tile", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    steps = F.array(F.lit(0).cast("long"), *[F.lit(s).cast("long") for s in _neighbours(segments, radius)])
    asked = tiled.select("fp", F.col("tile").alias("home"), F.explode(steps).alias("step"))
    asked = asked.select("fp", "home", (F.col("home") + F.col("step")).alias("tile"))
    asked = asked.join(crowded, "tile", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.when(F.col("home") == F.col("tile"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # a node meets every block of a neighbouring tile, and of its own tile the blocks from its own on
    placed = asked.withColumn("own", own).select(
        "tile", F.explode(F.sequence(F.coalesce("own", F.lit(0)), F.col("blocks") - 1)).alias("block"), "own", "fp"
    )
    placed = placed.select("tile", "block", (F.col("own").isNull() | (F.col("own") != F.col("block"))).alias("probe"), "fp")
    parted = placed.repartition(F.col("tile"), F.col("block")).sortWithinPartitions("tile", "block", "probe")
    return parted.mapInArrow(_compare_tiles(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per document.

    `component_id` is the smallest id reachable over links of at most `radius` differing bits. Null,
    empty and wordless texts have fingerprint 0 and are linked like any other. A null id keeps its row
    and passes links on but is never a `component_id` (null where no id is reachable). Repeated rows
    stay repeated. An empty table gives an empty result. Other columns are ignored.
    """
    source = docs.select(col(id_col).alias("doc_id"), fingerprint_column(col(text_col), shingle_words).alias("fp"))
    return named(materialize(source, "fingerprints"), lambda nodes: fingerprint_links(nodes, radius))


def named(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, fingerprint, component_id) of a stored table (doc_id, fp), with the links between its distinct `fp`."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = materialize(components(links(nodes)), "components")
    members = linked.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "least")
    roots = members.groupBy("root").agg(F.min("least").alias("component"))
    named = members.select("fp", "root").join(roots, "root").select(F.col("fp").alias("linked_fp"), "component")
    alone = nodes.join(named, F.col("fp") == F.col("linked_fp"), "left")
    # a fingerprint without links is a component of its own
    component = F.when(F.col("linked_fp").isNull(), F.col("least")).otherwise(F.col("component"))
    # a written table, one row per fingerprint, so that the join can split the rows of a very common one
    classes = materialize(alone.select(F.col("fp").alias("class_fp"), component.alias("component_id")), "classes")
    return prints.join(classes, F.col("fp") == F.col("class_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id is their component's smallest, columns unchanged.

    Of repeated rows with one id one is kept, the greatest by its columns' values; rows without an id go unless no
    document with an id is reachable.
    """
    prints = fingerprint_column(col(text_col), options.get("shingle_words", SHINGLE_WORDS))
    return keep_first(docs, near_duplicates(docs, id_col, text_col, **options), prints, id_col)


def keep_first(docs: DataFrame, components: DataFrame, prints: Column, id_col: str = "doc_id") -> DataFrame:
    """As `keep_one_each`, of the rows of `named`; `prints` gives a document's `fp`."""
    found = materialize(components, "near-duplicates")
    first = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept, again = first.filter("n = 1"), first.filter("n > 1")
    nameless = found.filter(F.col("component_id").isNull())
    key, copies = free_name(docs, "kept_id"), free_name(docs, "copies")
    flagged = docs.join(kept.select(F.col("doc_id").alias(key)), col(id_col) == F.col(key), "left_semi")
    repeated = docs.join(again.select(F.col("doc_id").alias(key), F.col("n").alias(copies)), col(id_col) == F.col(key), "left_semi")
    plain = [c for c in docs.columns if c != id_col]
    best = F.max(F.struct(*[col(c).alias(f"_{i}") for i, c in enumerate(plain)]))
    one = repeated.groupBy(col(id_col).alias(key)).agg(best.alias(copies))
    values = {id_col: F.col(key), **{c: F.col(copies)[f"_{i}"] for i, c in enumerate(plain)}}
    one = one.select(*[values[c].alias(c) for c in docs.columns])
    out = flagged.unionByName(one)
    if nameless.limit(1).count():  # texts that only rows without an id have: one row of each fingerprint
        shown = free_name(docs, "shown_fp")
        bare = docs.filter(col(id_col).isNull()).withColumn(shown, prints)
        bare = bare.withColumn(shown, F.lpad(F.lower(F.hex(shown)), 16, "0"))
        bare = bare.join(nameless.select(F.col("fingerprint").alias(key)), F.col(shown) == F.col(key), "left_semi")
        out = out.unionByName(bare.dropDuplicates([shown]).drop(shown))
    return out
