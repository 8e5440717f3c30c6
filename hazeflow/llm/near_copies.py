"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, none missed, and
documents that `simhash.near_duplicates` links, whose fingerprints of three-word shingles differ in two bits at most.

Two sets that similar share one of the first fifth of their shingles (plus one) under any order that is the same
for all, so documents meet in buckets named by those shingles only. The order puts shingles that are common in a
sample last, which keeps buckets small; the result doesn't depend on it. Sizes and places of the shared shingle rule
out most of what meets; the rest is decided on the whole sets.

Equal sets are one node before any comparison. Nodes whose SimHash fingerprints (of the same five-word shingles) lie in
tiles within the radius meet first; that finds most copies at a candidate a node, but by far not all similar
pairs, which the buckets do. A bucket of up to `SMALL` nodes compares all its pairs. In a larger one all nodes meet
a common centre. Buckets whose nodes these links do not visibly connect are compared inside tasks: the sets come to the
bucket, in blocks of bounded size, and a block pair emits a spanning forest of confirmed links, never all pairs. No bucket
is cut short; one with many nodes that are not similar costs the square of their number in comparisons, not in rows.

Before any whole set travels, what meets is compared by sketches, a 64th of a set's size: a bit tells whether an odd number of a
set's shingles falls on it. Bits that differ are at most as many as the shingles that only one of two sets has, so
a pair with more such bits than similar sets have such shingles is ruled out, and no similar pair is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from hazeflow.llm import simhash
from hazeflow.llm.components import contracted
from hazeflow.llm.frames import col, slices, utf8
from hazeflow.llm.suffix_dedup import _Hashes, _mix, _sent
from hazeflow.scratch import discard, materialize

SHINGLE_WORDS = 5
SIMILAR = (4, 5)  # least similarity as a fraction
SMALL = 64  # nodes of a bucket that are all compared at once
CONTRACTIONS = 2  # of the links that are known, before the buckets that they leave open are compared
SAMPLE_DOCS = 20_000  # texts that show which shingles are common
COMMON = 500_000  # shingles that the order puts last, at most
BLOCK_SHINGLES = 1 << 20  # of a block of a large bucket whose sets are held in memory

Batches = Iterator[pa.RecordBatch]


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's shingles: A-Z lower-cased; a shorter text is one shingle, a wordless one has none."""
    for part in slices(texts):
        h = _Hashes(pc.ascii_lower(pc.fill_null(part, "")))
        for first, last in zip(h.first[:-1].tolist(), h.first[1:].tolist()):
            k = min(SHINGLE_WORDS, last - first)
            begin = np.arange(first, last - k + 1) if k else np.zeros(0, np.int64)
            yield np.unique(h.ranges(begin, begin + k))


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def key_column(text: Column) -> Column:
    """Hash of the text's set of shingles as a signed long."""

    @arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        return _signed([_key(s) for s in _sets(texts)])

    return compute.asNondeterministic()(text)


def _shingle_rows(batches: Batches) -> Batches:
    for batch in batches:
        for shingles in _sets(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64))], names=["h"])


def _set_rows(batches: Batches) -> Batches:
    for batch in batches:
        for shingles in _sets(batch.column(0)):
            yield pa.RecordBatch.from_arrays([_signed([_key(shingles)]), pa.array([shingles.tobytes()], pa.binary())], names=["key", "shingles"])


def _sketch(shingles: np.ndarray) -> bytes:
    """A bit for each place, set where an odd number of shingles falls; as many places as shingles, rounded up to a power of two."""
    places = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    at = (_mix(shingles) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=places) & 1, bitorder="little").tobytes()


def _folded(sketch: np.ndarray) -> np.ndarray:
    """Sketches (last axis) of the same sets with half the places."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def _apart(n_a, n_b, differing):
    """Whether sets of these sizes of which at least so many shingles are in one only cannot be similar."""
    num, den = SIMILAR
    return (num + den) * differing > (den - num) * (n_a + n_b)


def _print_rows(common):
    """Per document its key, the size and sketch of its set, the shingles it may be found by, and its fingerprint."""

    def run(batches: Batches) -> Batches:
        codes, counts = common.value
        num, den = SIMILAR
        for batch in batches:
            keys, sizes, heads, sims, sketches = [], [], [], [], []
            marks = [simhash.fingerprint(t) for part in slices(batch.column(1)) for t in utf8(part)]
            for s in _sets(batch.column(1)):
                weight = np.zeros(len(s), np.int64)
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, s), len(codes) - 1)
                    weight = np.where(codes[at] == s, counts[at], 0)
                n = len(s)
                keys.append(_key(s))
                sizes.append(n)
                sketches.append(_sketch(s))
                sims.append(simhash.majority(s) if n else 0)
                heads.append(s[np.lexsort((s, weight))][: n - -(-num * n // den) + 1 if n else 0].view(np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in heads])].astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *heads])
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(keys), _signed(sims), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), found, _signed(marks)], names=["doc_id", "fp", "sim", "n", "sketch", "found", "mark"])

    return run


def _possible(n_a, at_a, n_b, at_b):
    """Whether sets of these sizes whose first shared shingle has these places can be similar."""
    num, den = SIMILAR
    fits = den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)
    return fits & ((num + den) * np.minimum(n_a - at_a, n_b - at_b) >= num * (n_a + n_b))


def _groups(batches: Batches) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by the first column, no group of equal values cut."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        cut = np.searchsorted(columns[0], columns[0][-1])
        held = [c[cut:] for c in columns]
        if cut:
            yield tuple(c[:cut] for c in columns)
    if held is not None:
        yield tuple(held)


def _meetings(batches: Batches) -> Batches:
    """(h, a, n, place, b): pairs (a, b) of small buckets; larger ones' nodes with their centre, and all of them without b."""
    names = ["h", "a", "n", "place", "b"]
    for h, key, n, place in _groups(batches):
        lead = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[lead, len(h)])
        size = np.repeat(sizes, sizes)
        large = size > SMALL
        if large.any():
            crowd = tuple(c[large] for c in (h, key, n, place))
            yield pa.RecordBatch.from_arrays([*map(pa.array, crowd), pa.nulls(len(crowd[0]), pa.int64())], names=names)
            for own in _each(crowd):
                centre, met = _centred(*own)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[met]) for c in own), pa.array(np.full(len(met), own[1][centre]))], names=names)
        keep = (size > 1) & ~large
        h, key, n, place = (c[keep] for c in (h, key, n, place))
        for lag in range(1, SMALL):
            i = np.flatnonzero(h[lag:] == h[:-lag])
            if not len(i):
                break
            i = i[_possible(n[i], place[i], n[i + lag], place[i + lag])]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[i], key[i], n[i], place[i], key[i + lag])], names=names)


def _centred(h, key, n, place) -> tuple[int, np.ndarray]:
    """The node of a bucket whose mixed key is least, and those that may be similar to it."""
    c = int(np.argmin(_mix(key.view(np.uint64))))
    may = _possible(n, place, n[c], place[c])
    may[c] = False
    return c, np.flatnonzero(may)


def _forest(key, n, place, root, own, sets) -> Iterator[tuple[int, int]]:
    """Confirmed links between nodes with different roots, at most nodes - 1; of two blocks only pairs across."""
    num, den = SIMILAR
    label = np.unique(root, return_inverse=True)[1]
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.cumsum([0, *map(len, sets)])
    across = own.min() != own.max()
    held = np.zeros(codes.max(initial=-1) + 1, np.int64)
    for i in range(len(key) - 1):
        may = _possible(n[i], place[i], n, place) & (label != label[i])
        may[: i + 1] = False
        if across:
            may &= own != own[i]
        if not may.any():
            continue
        met = np.flatnonzero(may)
        sizes = edges[met + 1] - edges[met]
        begins = np.cumsum(sizes) - sizes
        theirs = codes[np.repeat(edges[met] - begins, sizes) + np.arange(sizes.sum())]
        mine = codes[edges[i] : edges[i + 1]]
        held[mine] = 1
        shared = np.add.reduceat(held[theirs], begins)  # a node of a bucket has a shingle, so no range is empty
        held[mine] = 0
        for j in met[(num + den) * shared >= num * (n[i] + n[met])]:
            if label[j] != label[i]:
                yield int(key[i]), int(key[j])
                label[label == label[j]] = label[i]


def _block_pairs(batches: Batches) -> Iterator[pa.Table]:
    """The rows of each block pair; they come sorted by bucket and block pair, which may span batches."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
        lead = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0), True])
        for begin, end in zip(lead[:-1], lead[1:]):
            own = tuple(group[:, begin])
            if own != name and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            name = own
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _block_links(batches: Batches) -> Batches:
    """Forests of block pairs."""
    for whole in _block_pairs(batches):
        key, n, place, root, own = (whole.column(c).to_numpy() for c in ("fp", "n", "place", "root", "own"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in whole.column("shingles")]
        links = list(_forest(key, n.astype(np.int64), place.astype(np.int64), root, own, sets))
        yield _pair_rows(*(np.array([x[k] for x in links], np.int64) for k in (0, 1)))


def _partners(batches: Batches) -> Batches:
    """(h, fp) of the nodes of a block pair that may be similar to one with another root; rows come as for `_block_links`."""
    for whole in _block_pairs(batches):
        h, key, n, place, root = (whole.column(c).to_numpy() for c in ("h", "fp", "n", "place", "root"))
        n, place = n.astype(np.int64), place.astype(np.int64)
        own = whole.column("own").to_numpy()
        sketches = [np.frombuffer(x.as_buffer(), np.uint64) for x in whole.column("sketch")]
        words = np.array([len(x) for x in sketches])
        levels = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
        whole_of = {w: np.stack([sketches[i] for i in at]) for w, at in levels.items()}
        half_of = {w: _folded(x) for w, x in whole_of.items() if w > 1}
        across, found = own.min() != own.max(), np.zeros(len(key), bool)
        for i, mine in enumerate(sketches):
            w = len(mine)
            tables = [(w, whole_of.get(w), mine), (2 * w, half_of.get(2 * w), mine)]
            if w > 1:
                tables.append((w // 2, whole_of.get(w // 2), _folded(mine)))
            for level, table, sketch in tables:
                if table is None:
                    continue
                at = levels[level]
                may = _possible(n[i], place[i], n[at], place[at]) & (root[at] != root[i])
                if across:
                    may &= own[at] != own[i]
                met = np.flatnonzero(may)
                if len(met):
                    differing = np.bitwise_count(table[met] ^ sketch).sum(axis=1, dtype=np.int64)
                    met = at[met[~_apart(n[i], n[at[met]], differing)]]
                    found[met] = True
                    found[i] |= len(met) > 0
        yield pa.RecordBatch.from_arrays([pa.array(h[found]), pa.array(key[found])], names=["h", "fp"])


def _in_blocks(rows: DataFrame, carried: DataFrame, payload: str) -> DataFrame:
    """Rows of buckets with several roots, in block pairs, each with its node's payload, sorted by block pair."""
    crowds = rows.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum("n").alias("total")).filter("r0 <> r1")
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks")
    crowds = materialize(crowds.select(F.col("h").alias("open"), blocks), "crowds")  # a row per bucket, so that the join can split one
    met = rows.join(crowds, F.col("h") == F.col("open")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "n", "place", "root", "own")
    whole = met.join(carried.select("key", payload), F.col("fp") == F.col("key")).drop("key")
    return whole.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "fp")


def _unconnected(rows: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between nodes of large buckets that no link connects yet."""
    partners = _in_blocks(rows, sketches, "sketch").mapInArrow(_partners, "h long, fp long").distinct()
    partners = materialize(partners.select(F.col("h").alias("ph"), F.col("fp").alias("pfp")), "partners")
    left = materialize(rows.join(partners, (F.col("h") == F.col("ph")) & (F.col("fp") == F.col("pfp")), "left_semi"), "rooted")
    sets = _sets_of(left.select(F.col("fp").alias("w")), texts)
    links = materialize(_in_blocks(left, sets, "shingles").mapInArrow(_block_links, "a long, b long"), "links")
    for table in (partners, left, sets):
        discard(table)
    return links


def _each(columns: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    h = columns[0]
    edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
    for begin, end in zip(edges[:-1], edges[1:]):
        yield tuple(c[begin:end] for c in columns)


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


@arrow_udf(T.BooleanType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    num, den = SIMILAR
    found = []
    for x, y in zip(a, b):
        x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
        shared = len(np.intersect1d(x, y, assume_unique=True))
        found.append((num + den) * shared >= num * (len(x) + len(y)))
    return pa.array(found, pa.bool_())


@arrow_udf(T.BooleanType())
def _may_be_similar(n_a: pa.Array, a: pa.Array, n_b: pa.Array, b: pa.Array) -> pa.Array:
    num, den = SIMILAR
    n_a, n_b = (n.to_numpy(zero_copy_only=False).astype(np.int64) for n in (n_a, n_b))
    differing = np.zeros(len(n_a), np.int64)
    fits = den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)
    for i in np.flatnonzero(fits):
        x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (a, b))
        while len(x) > len(y):
            x = _folded(x)
        while len(y) > len(x):
            y = _folded(y)
        differing[i] = np.bitwise_count(x ^ y).sum(dtype=np.int64)
    return pa.array(fits & ~_apart(n_a, n_b, differing), pa.bool_())


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the pairs, each once, that sizes and sketches of the sets do not rule out."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = [nodes.select(F.col("fp").alias(f"f{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    both = pairs.join(ends[0], F.col("a") == F.col("fa")).join(ends[1], F.col("b") == F.col("fb"))
    return both.filter(_may_be_similar("na", "sa", "nb", "sb")).select("a", "b")


def _sets_of(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, shingles), a stored row per wanted node, so that the joins can split a common node."""
    wanted = materialize(keys.select(F.col("w")).distinct(), "wanted")
    # the sets of nodes that met nobody stay where they are
    found = texts.mapInArrow(_set_rows, "key long, shingles binary").join(_sent(wanted), F.col("key") == F.col("w"), "left_semi")
    return materialize(found.dropDuplicates(["key"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(s)) for k, s in (("ka", "sa"), ("kb", "sb")))
    both = pairs.join(left, F.col("a") == F.col("ka")).select("a", "b", "sa").join(right, F.col("b") == F.col("kb"))
    return materialize(both.filter(_similar("sa", "sb")).select("a", "b"), "links")


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and in how many."""
    every = max(1, texts.count() // SAMPLE_DOCS)
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = sample.mapInArrow(_shingle_rows, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    counts = materialize(counts, "counts")  # written, so that its shuffle files go
    told = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    discard(counts)
    codes, n = told.column("h").to_numpy().view(np.uint64), told.column("n").to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def _alike(nodes: DataFrame, print_col: str) -> DataFrame:
    """(a, b): every node (`fp`) with the first of its SimHash fingerprint, and the first ones of linked fingerprints."""
    first = materialize(nodes.groupBy(F.col(print_col).alias("fp")).agg(F.min(nodes["fp"]).alias("rep")), "fingerprints")
    alike = nodes.select(print_col, F.col("fp").alias("a")).join(first, F.col(print_col) == F.col("fp")).filter("a <> rep").select("a", F.col("rep").alias("b"))
    links = simhash.fingerprint_links(first.select("fp"))
    ends = [first.select(F.col("fp").alias(f"f{x}"), F.col("rep").alias(f"r{x}")) for x in "ab"]
    linked = links.join(ends[0], F.col("a") == F.col("fa")).join(ends[1], F.col("b") == F.col("fb"))
    return alike.unionByName(linked.select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def set_links(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between similar sets, enough to connect all that similar pairs connect. Drops `prints`."""
    firsts = [F.first(c).alias(c) for c in ("sim", "n", "sketch", "found")]
    nodes = materialize(prints.groupBy("fp").agg(*firsts), "set-nodes")
    discard(prints)
    found = nodes.select("fp", "n", F.posexplode("found").alias("place", "h")).select("h", "fp", "n", "place")
    by_shingle = found.repartition("h").sortWithinPartitions("h")
    met = materialize(by_shingle.mapInArrow(_meetings, "h long, a long, n int, place int, b long"), "met")
    sketches = materialize(nodes.select(F.col("fp").alias("key"), "sim", "n", "sketch"), "sketches")  # without what nodes are found by
    discard(nodes)
    nodes = sketches.withColumnRenamed("key", "fp")
    met_pairs = met.filter("b is not null").select("a", "b").unionByName(_alike(nodes.filter("n > 0"), "sim"))
    pairs = materialize(_plausible(met_pairs, nodes), "meetings")
    sets = _sets_of(pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))), texts)
    links = _confirmed(pairs, sets)
    for table in (pairs, sets):
        discard(table)
    large = met.filter("b is null").select("h", F.col("a").alias("fp"), "n", "place")
    if large.limit(1).count():
        known = materialize(contracted(links, CONTRACTIONS), "roots")
        rows = large.join(known, F.col("fp") == F.col("node"), "left")
        rooted = materialize(rows.select("h", "fp", "n", "place", F.coalesce("root", "fp").alias("root")), "rooted")
        links = links.unionByName(_unconnected(rooted, sketches, texts))
        discard(rooted)
    for table in (met, sketches):
        discard(table)
    return links


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per document.

    `fingerprint` is a hash (64 bits) of the text's set of shingles, `component_id` the smallest id reachable over pairs
    of sets with a similarity of 0.8 or more and over the links of `simhash.near_duplicates`. Texts of fewer than five words are one shingle; null, empty and
    wordless texts are alike. Null ids, repeated rows and empty tables are treated as in `simhash.near_duplicates`.
    """
    texts = docs.select(col(text_col).cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(texts))
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    prints = materialize(source.mapInArrow(_print_rows(common), f"doc_id {id_type}, fp long, sim long, n int, sketch binary, found array<long>, mark long"), "prints")
    keys = materialize(prints.select("doc_id", "fp"), "keys")  # all that is needed of a document once its node is written
    marks = materialize(prints.select("fp", "mark").distinct(), "marks")  # equal sets may have several: they don't count repeats
    return simhash.named(keys, lambda _: set_links(prints, texts).unionByName(_alike(marks, "mark")))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group of near copies, rows as in `simhash.keep_one_each`."""
    return simhash.keep_first(docs, near_copies(docs, id_col, text_col), key_column(col(text_col)), id_col)
