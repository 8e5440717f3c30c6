"""Repeated passages by a sparse suffix array.

A passage of `min_words` words always holds the same minimiser: the least of its `GRAM`-word hashes.
Only suffixes that begin at minimisers are retained (about one in eighteen words).

1. The retained suffixes are sorted by their first `GRAM` words and their surroundings, across range partitions, and
   compared with their neighbours; those that no other document shares go.
2. What is left is extended to both sides. A suffix whose whole surrounding (all windows of `min_words` words
   that it is the minimiser of) occurs in an earlier document is a copy at once: equal surroundings are neighbours in the
   order, so the run's first row names that document, and a run that goes on in the next partition carries it along.
   The rest is compared window by window, word offset by word offset, with one hash per window.

Sort keys end in the document, so a passage that a third of all documents share is spread over many
tasks; the other groupings are aggregated map-side, and the joins back have one row per key on one side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from hazeflow.llm.frames import col, free_name, slices
from hazeflow.scratch import discard, materialize

MIN_WORDS = 50
GRAM = 16
BROADCAST_IDS = 4_000_000  # ids are sent to all tasks up to this count (32 MB), joined by a shuffle beyond it

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = re.compile("[^\x20\x09-\x0d]+")
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they have inverses modulo 2^64
_TEXT_BITS = 24


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, np.uint64)])
        return self.up, self.down


_bytes_powers, _words_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


class _Hashes:
    """Hashes of all word ranges of a slice of texts."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        word = ~_SPACE[data]
        apart = np.zeros(len(data) + 1, bool)  # a text begins here
        apart[offsets] = True
        begins = np.flatnonzero(word & (apart[:-1] | ~np.r_[False, word[:-1]]))
        ends = np.flatnonzero(word & (apart[1:] | ~np.r_[word[1:], False])) + 1
        self.first = np.searchsorted(begins, offsets)  # number of each text's first word
        up, down = _bytes_powers.get(len(data) + 1)
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
        words = _mix((sums[ends] - sums[begins]) * down[begins])
        up, self.down = _words_powers.get(len(words) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value among `width` from each place on, the leftmost on ties."""
    best, place, reach = values, np.arange(len(values)), 1

    def meet(best, place, step):
        left, right = best[: len(best) - step], best[step:]
        pick = left <= right
        return np.where(pick, left, right), np.where(pick, place[: len(place) - step], place[step:])

    while 2 * reach <= width:
        best, place = meet(best, place, reach)
        reach *= 2
    if reach < width:
        best, place = meet(best, place, width - reach)
    return place


def _anchors_of(texts: pa.Array, min_words: int, gram: int):
    """(text, first window, windows, gram hash, surrounding's hash) of the retained suffixes."""
    h = _Hashes(texts)
    total = len(h.sums) - 1
    none = np.zeros(0, np.int64)
    if total < min_words:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = h.ranges(np.arange(total - gram + 1), np.arange(gram, total + 1))
    place = _least(grams, min_words - gram + 1)
    counts = np.diff(h.first)
    windows = np.maximum(counts - min_words + 1, 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + h.first[owner]
    least = place[starts]
    new = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])] if len(owner) else np.zeros(0, bool)
    lead = np.flatnonzero(new)
    n = np.diff(np.r_[lead, len(owner)])
    text, begin = owner[lead], starts[lead]
    around = _mix(h.ranges(begin, begin + n - 1 + min_words) + n.astype(np.uint64))
    return text, begin - h.first[text], n, grams[least[lead]], around


def _place(start: np.ndarray, n: np.ndarray, tx: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | (n.astype(np.int64) << _TEXT_BITS) | tx


def _anchor_rows(min_words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(2)):
                text, start, n, g, c = _anchors_of(part, min_words, gram)
                docs = batch.column(0).slice(done, len(part)).take(pa.array(text))
                tx = batch.column(1).slice(done, len(part)).to_numpy()[text]
                done += len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), docs, pa.array(_place(start, n, tx))],
                    names=["gram", "around", "doc", "place"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes those whose run of equal grams has two documents, or reaches an edge of the partition.

    Each gets the first document of its run of equal surroundings as far as this partition shows it; `open` marks the
    run that the partition begins with. Repeated rows are neighbours, one of each stays.
    """
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    last = None  # the row before: gram, surrounding, document, place
    gram_doc, several, first, is_open = None, True, None, True  # of the runs that row belongs to
    held: list[pa.RecordBatch] = []  # rows of the last run of grams while it has one document only
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in range(4)]
        if last is None and batch.num_rows:
            gram_doc, first = columns[2][0], columns[2][0]
            before = [c[:1] for c in columns]
        elif batch.num_rows:
            before = [np.array([v]) for v in last]
        else:
            continue
        shifted = [np.r_[b, c[:-1]] for b, c in zip(before, columns)]
        keep = (np.stack(columns) != np.stack(shifted)).any(axis=0)
        keep[0] |= last is None
        last = [c[-1] for c in columns]
        gram, around, doc, place = (c[keep] for c in columns)
        if not len(gram):
            continue
        new_gram = gram != shifted[0][keep]
        new_run = new_gram | (around != shifted[1][keep])
        # the document each run begins with; rows before the batch's first new run belong to the run carried in
        run, gram_run = np.cumsum(new_run), np.cumsum(new_gram)
        firsts, gram_docs = np.r_[first, doc[new_run]], np.r_[gram_doc, doc[new_gram]]
        opened = np.r_[is_open, np.zeros(new_run.sum(), bool)]
        mixed = np.zeros(len(gram_docs), bool)
        mixed[0] = several
        np.logical_or.at(mixed, gram_run, doc != gram_docs[gram_run])
        rows = pa.RecordBatch.from_arrays(
            [*(pa.array(c) for c in (gram, around, doc, place, firsts[run])), pa.array(np.full(len(gram), part, np.int32)), pa.array(opened[run])],
            names=["gram", "around", "doc", "place", "first", "part", "open"],
        )
        ends = len(mixed) - 1  # the run that may go on in the next batch
        if held and mixed[0]:
            yield from held
        if ends or mixed[0]:
            held = []
        sent = mixed[gram_run] & ((gram_run != ends) | mixed[ends])
        yield rows.filter(pa.array(sent))
        if not mixed[ends]:
            held.append(rows.filter(pa.array(gram_run == ends)))
        first, gram_doc, is_open, several = firsts[-1], gram_docs[-1], bool(opened[-1]), bool(mixed[ends])
    yield from held


def _first_documents(shared: DataFrame) -> Column:
    """The first document of each row's run over all partitions; one row per partition comes to the driver."""
    key = F.struct("gram", "around")
    edges = shared.groupBy("part").agg(F.min(key).alias("head"), F.max(key).alias("tail"), F.max_by("first", key).alias("first")).orderBy("part").collect()
    carried: dict[int, int] = {}
    for before, here in zip(edges[:-1], edges[1:]):
        if here["head"] == before["tail"]:
            whole = before["head"] == before["tail"] and before["part"] in carried  # the run fills that partition
            carried[here["part"]] = carried[before["part"]] if whole else before["first"]
    if not carried:
        return F.col("first")
    table = F.array(*[F.lit(carried.get(p)).cast("long") for p in range(max(carried) + 1)])
    return F.when(F.col("open"), F.coalesce(F.get(table, F.col("part")), F.col("first"))).otherwise(F.col("first"))


def _window_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(2)):
                h = _Hashes(part)
                docs, txs = batch.column(0).slice(done, len(part)), batch.column(1).slice(done, len(part)).to_numpy()
                places = batch.column(3).slice(done, len(part))
                done += len(part)
                text = pc.list_parent_indices(places).to_numpy()
                packed = places.flatten().to_numpy()
                n = (packed >> _TEXT_BITS) & 255
                owner = np.repeat(text, n)
                start = np.repeat(packed >> 32, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                begin = start + h.first[owner]
                keys = h.ranges(begin, begin + min_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), docs.take(pa.array(owner)), pa.array(_place(start, np.ones(len(start), np.int64), txs[owner]))],
                    names=["window", "doc", "place"],
                )

    return run


def _version(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.pmod(F.xxhash64(text), F.lit(1 << _TEXT_BITS))


def _sent(ids: DataFrame) -> DataFrame:
    """`ids`, broadcast while their counted number is below the bound."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM
) -> DataFrame:
    """(doc_id, version, begin_word, end_word, n_words, source_doc_ids): passages to remove.

    Words are runs without ASCII white space, compared as they are. A window of `min_words` words is a copy if
    a document with a smaller id has it; a document's copies that overlap or touch are one passage, and
    `source_doc_ids` are smaller ids that have its windows, in order (the smallest of equal surroundings). The first document keeps its
    text, and repeats inside one document are left alone. Null ids take no part; null, empty and shorter texts
    have no windows. Rows of one id are told apart by `version` (a hash of the text), and repeated rows count once.
    Ids are integers. An empty table gives none; other columns are ignored. `min_words - gram` is below 255.
    """
    if not 0 < gram <= min_words < gram + 255:
        raise ValueError("0 < gram <= min_words < gram + 255")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), _version(F.col(text_col)).alias("tx"), F.col(text_col).alias("text"))
    source = source.filter("doc is not null and text is not null")
    anchors = materialize(source.mapInArrow(_anchor_rows(min_words, gram), "gram bigint, around bigint, doc bigint, place bigint"), "anchors")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["gram", "around", "doc", "place"]
    ordered = anchors.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    told = "gram bigint, around bigint, doc bigint, place bigint, first bigint, part int, open boolean"
    shared = materialize(ordered.mapInArrow(_shared, told), "shared")
    discard(anchors)
    # copies with all their surroundings, and the others' windows
    marked = shared.select("doc", "place", _first_documents(shared).alias("first"))
    open_places = marked.filter(F.col("doc") == F.col("first"))
    tx = F.col("place").bitwiseAND(F.lit((1 << _TEXT_BITS) - 1).cast("long"))
    places = open_places.groupBy("doc", tx.alias("tx")).agg(F.collect_list("place").alias("places"))
    touched = _sent(open_places.select("doc").distinct())
    texts = source.join(touched, "doc", "left_semi").dropDuplicates(["doc", "tx"])
    contexts = texts.join(places, ["doc", "tx"]).select("doc", "tx", "text", "places")
    windows = materialize(contexts.mapInArrow(_window_rows(min_words), "window bigint, doc bigint, place bigint"), "windows")
    earliest = windows.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    earliest = materialize(earliest.select(F.col("window").alias("w"), "first"), "earliest")
    single = windows.join(earliest, F.col("window") == F.col("w")).select("doc", "place", "first")
    copies = marked.unionByName(single).filter(F.col("doc") > F.col("first"))
    begin, n = F.shiftright("place", 32), F.shiftright("place", _TEXT_BITS).bitwiseAND(F.lit(255).cast("long"))
    stretches = copies.select("doc", tx.alias("tx"), begin.alias("begin"), (begin + n - 1 + min_words).alias("end"), "first")
    # a document's stretches, at most one a word, become passages
    before = Window.partitionBy("doc", "tx").orderBy("begin", "end", "first")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    cut = stretches.withColumn("new", F.coalesce(F.col("begin") > reached, F.lit(True)).cast("int"))
    cut = cut.withColumn("passage", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("doc", "tx", "passage").agg(
        F.min("begin").alias("begin_word"), F.max("end").alias("end_word"), F.array_sort(F.collect_set("first")).alias("source_doc_ids")
    ).select(
        F.col("doc").alias("doc_id"),
        F.col("tx").alias("version"),
        "begin_word",
        "end_word",
        (F.col("end_word") - F.col("begin_word")).alias("n_words"),
        "source_doc_ids",
    )


def _cut_words(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
    """The texts less the words [begin, end), each with the white space behind it."""
    out = []
    for text, b, e in zip(texts.to_pylist(), begins.to_pylist(), ends.to_pylist()):
        starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
        edges = [0, *(starts[i] for pair in sorted(zip(b, e)) for i in pair), len(text)]
        out.append("".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """`docs` less the repeated passages; every row and column stays.

    `length_col`, where the table has it, gets the new length of the texts that were cut.
    """
    passages = materialize(repeated_passages(docs, id_col, text_col, **options), "passages")
    key, tx, begins, ends, version = (free_name(docs, n) for n in ("cut_id", "cut_version", "cut_begins", "cut_ends", "text_version"))
    spans = passages.groupBy(F.col("doc_id").alias(key), F.col("version").alias(tx)).agg(
        F.collect_list(F.col("begin_word").cast("int")).alias(begins), F.collect_list(F.col("end_word").cast("int")).alias(ends)
    )
    touched = _sent(passages.select(F.col("doc_id").alias(key)).distinct())
    same = col(id_col) == F.col(key)
    whole = docs.join(touched, same, "left_anti")
    parted = docs.join(touched, same, "left_semi").withColumn(version, _version(col(text_col)))
    parted = parted.join(spans, same & (F.col(version) == F.col(tx)), "left")
    has = F.col(begins).isNotNull()
    cut = arrow_udf(_cut_words, "string").asNondeterministic()
    done = parted.filter(has).withColumn(text_col, cut(col(text_col), F.col(begins), F.col(ends)))
    if length_col in docs.columns:
        done = done.withColumn(length_col, F.length(col(text_col)).cast(docs.schema[length_col].dataType))
    kept = [col(c) for c in docs.columns]
    return whole.unionByName(parted.filter(~has).select(*kept)).unionByName(done.select(*kept))
