"""Spelling variants: words one edit apart, found through an index of variable-length grams.

1. A dictionary of grams of `MIN_GRAM` to `MAX_GRAM` code points is built from all words and pruned by frequency: a gram
   is extended only where it is frequent. It is a hashed table of fixed size; a collision makes a gram longer
   or shorter for all words alike and changes no result.
2. A word is decomposed into one gram per position, the shortest that isn't frequent. Deciding it reads the gram and one
   code point behind it, so an edit affects only the grams that it lies in or directly behind. What an edit at a place
   leaves, at least `length - MAX_GRAM - 2` grams, is the same in both words.
3. For each place of an edit the lists of the `MERGED` rarest grams left are merged by a common key; two words
   one edit apart always share the key of the edit between them. Neighbouring places mostly share a key, so a word has
   about seven keys of each kind, not one for each place.
4. Words that share a key are verified by their edit distance inside the join.

Occurrences are counted map-side, so a word that very many documents have is one row per task in the shuffle; texts are
never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hazeflow.llm.frames import col
from hazeflow.scratch import discard, materialize

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
DROP_EVERY = 31
MIN_GRAM, MAX_GRAM, FREQUENT, MERGED = 2, 3, 256, 3
SLOTS = 1 << 20  # of the dictionary, one byte each
CELLS_AT_ONCE = 1 << 18

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SAME, SHORTER, LONGER = 0, 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int64(1 << 62)
_PLACE_BITS = 40

Batches = Iterator[pa.RecordBatch]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int, drop_every: int | None) -> DataFrame:
    """(word), a row per occurrence: maximal runs of letters, A-Z lower-cased, some with one code point deleted."""
    lowered = F.translate(col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(
        col(id_col).cast("string").alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("run"),
    )
    if drop_every is None:
        return runs.select(F.col("run").alias("word"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"), F.length("run").alias("size"))
    place = F.pmod("h", "size").cast("int")
    less = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.col("size")))
    return hashed.select(F.when(F.pmod("h", F.lit(drop_every)) == 0, less).otherwise(F.col("run")).alias("word"))


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, code points) of words of one length, a bounded number of code points at a time."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0, True]) if len(order) else []
    for begin, end in zip(edges[:-1], edges[1:]):
        size = int(lengths[order[begin]])
        step = max(1, CELLS_AT_ONCE // max(size, 1))
        for at in range(begin, end, step):
            rows = order[at : min(at + step, end)]
            yield rows, codes[begins[rows][:, None] + np.arange(size)]


def _gram_hashes(codes: np.ndarray, low: int, high: int) -> dict[int, np.ndarray]:
    """Hashes of the grams of each length at every place."""
    mixed, size = _mix(codes + np.uint64(7)), codes.shape[1]
    found, rolled = {}, mixed
    for q in range(1, high + 1):
        if q > size:
            break
        if q > 1:
            rolled = rolled[:, : size - q + 1] * _BASE + mixed[:, q - 1 :]
        if q >= low:
            found[q] = _mix(rolled)
    return found


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _slot_rows(low: int, high: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            counts = np.zeros(SLOTS, np.int64)
            for _, codes in _by_length(batch.column(0)):
                for hashes in _gram_hashes(codes, low, high).values():
                    counts += np.bincount(_slot(hashes).ravel(), minlength=SLOTS)
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])

    return run


def _level(counts: np.ndarray) -> np.ndarray:
    """How common a gram is, in quarters of a doubling."""
    return np.minimum(np.floor(4 * np.log2(1 + counts.astype(np.float64))), 255).astype(np.uint8)


def gram_dictionary(words: DataFrame, low: int = MIN_GRAM, high: int = MAX_GRAM) -> np.ndarray:
    """How common the grams of all words are, a byte for each slot; fixed size."""
    counts = words.select("word").mapInArrow(_slot_rows(low, high), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    told = counts.toArrow()
    levels = np.zeros(SLOTS, np.uint8)
    levels[told.column("slot").to_numpy()] = _level(told.column("n").to_numpy())
    return levels


def decompose(codes: np.ndarray, levels: np.ndarray, low: int, high: int, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, hash and commonness of the gram at each place of words of one length."""
    size, bound = codes.shape[1], _level(np.array([frequent]))[0]
    hashes = _gram_hashes(codes, low, high)
    gram = hashes[low].copy()
    lengths = np.full(gram.shape, low)
    for q in range(low, min(high, size - 1)):
        longer = hashes[q + 1]
        here = slice(0, longer.shape[1])
        extended = (lengths[:, here] == q) & (levels[_slot(hashes[q][:, here])] > bound)
        lengths[:, here] += extended
        gram[:, here] = np.where(extended, longer, gram[:, here])
    return lengths, gram, levels[_slot(gram)]


def affected_bound(lengths: np.ndarray) -> np.ndarray:
    """The most grams of each word that one edit may change."""
    n, places = lengths.shape
    steps = np.zeros((n, places + lengths.max(initial=0) + 2), np.int64)
    steps[:, :places] = 1
    rows = np.repeat(np.arange(n), places)
    np.add.at(steps, (rows, (np.arange(places) + lengths + 1).ravel()), -1)
    return steps.cumsum(axis=1).max(axis=1)


def _keep_least(best: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([best, new], axis=1), axis=1)[:, : best.shape[1]]


def _signatures(codes: np.ndarray, levels: np.ndarray, low: int, high: int, frequent: int, merged: int, shortest: int):
    """(kind, a row of keys per word): for every place of an edit the hash of the rarest grams that it leaves."""
    n, size = codes.shape
    lengths, gram, common = decompose(codes, levels, low, high, frequent)
    places = gram.shape[1]
    if n and (places - affected_bound(lengths)).min() < 1:
        raise ValueError("an edit may leave no gram to meet by")
    order = (common.astype(np.int64) << _PLACE_BITS) + np.arange(places)
    none = np.full((n, merged), _NONE)
    before, after = [none], [none] * (size + 2)  # grams wholly before a place and the code point ahead of it; from a place on
    for i in range(1, size + 1):
        ending = [np.where(lengths[:, i - 1 - q] == q, order[:, i - 1 - q], _NONE) for q in range(low, high + 1) if 0 <= i - 1 - q < places]
        before.append(_keep_least(before[-1], np.stack(ending, axis=1)) if ending else before[-1])
    for i in range(places - 1, -1, -1):
        after[i] = _keep_least(after[i + 1], order[:, i : i + 1])
    rows = np.arange(n)[:, None]

    def keys(kind: int, shorter: int, cuts: range, skipped: int, moved: int) -> np.ndarray:
        salt = _mix(np.array([2 * shorter + (kind != SAME)], np.uint64))
        found = np.zeros((n, len(cuts)), np.uint64)
        for k, i in enumerate(cuts):
            behind = after[i + skipped]
            behind = np.where(behind == _NONE, _NONE, behind - moved)
            both = _keep_least(before[i], behind)
            place = both & ((1 << _PLACE_BITS) - 1)
            own = np.where(place >= i, place + moved, place)  # where the gram lies in this word
            grams = gram[rows, np.where(both == _NONE, 0, own)]
            tokens = np.where(both == _NONE, np.uint64(0), _mix(grams * _BASE + place.astype(np.uint64)))
            key = np.broadcast_to(salt, (n,))
            for t in range(merged):
                key = _mix(key * _BASE + tokens[:, t])
            found[:, k] = key
        return found

    yield SAME, keys(SAME, size, range(size), 1, 0)
    yield SHORTER, keys(SHORTER, size, range(size + 1), 0, 0)
    if size > shortest:
        yield LONGER, keys(LONGER, size - 1, range(size), 1, 1)


def _key_rows(levels, low: int, high: int, frequent: int, merged: int, shortest: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            words = batch.column(0)
            for rows, codes in _by_length(words):
                for kind, keys in _signatures(codes, levels.value, low, high, frequent, merged, shortest):
                    keys = np.sort(keys, axis=1)
                    new = np.c_[np.ones(len(keys), bool), keys[:, 1:] != keys[:, :-1]]
                    own = np.repeat(rows, new.sum(axis=1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[new].view(np.int64)), pa.array(np.full(len(own), kind, np.int8)), words.take(pa.array(own))],
                        names=["key", "kind", "word"],
                    )

    return run


def near_words(
    words: DataFrame,
    min_chars: int = MIN_CHARS,
    min_gram: int = MIN_GRAM,
    max_gram: int = MAX_GRAM,
    frequent: int = FREQUENT,
    merged: int = MERGED,
) -> DataFrame:
    """(a, b), a < b or a one code point shorter: all pairs of distinct words that are exactly one edit apart.

    `words` has distinct words of at least `min_chars` code points in `word`, in a stored table. Every edit must leave a
    gram, so `max_gram` is at most `min_chars - 3`. Words in one very long list are compared where they meet: the join
    emits links only, and AQE splits a partition that one list fills.
    """
    if not 1 <= min_gram <= max_gram <= min_chars - 3 or merged < 1:
        raise ValueError("1 <= min_gram <= max_gram <= min_chars - 3 and merged >= 1")
    levels = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, min_gram, max_gram))
    keyed = words.select("word").mapInArrow(_key_rows(levels, min_gram, max_gram, frequent, merged, min_chars), "key long, kind byte, word string")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartition(parts, "key")
    left, right = keyed.filter(F.col("kind") != LONGER), keyed.filter(F.col("kind") != SHORTER)
    a, b = (side.select("key", F.col("kind").alias(f"{x}_kind"), F.col("word").alias(x)) for side, x in ((left, "a"), (right, "b")))
    same = (F.col("a_kind") == SAME) & (F.col("b_kind") == SAME) & (F.col("a") < F.col("b"))
    longer = (F.col("a_kind") == SHORTER) & (F.col("b_kind") == LONGER)
    met = a.hint("merge").join(b, (a["key"] == b["key"]) & (same | longer) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form: doubling hops, so rounds grow with the logarithm of the longest chain."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reached.select(F.col("word").alias("at"), F.col("root").alias("further"))
        hop = reached.join(on, F.col("root") == F.col("at"), "left")
        moved = materialize(hop.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        done = not moved.filter("moved").limit(1).count()
        discard(reached)
        reached = moved.select("word", "root")
        if done:
            return reached


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    drop_every: int | None = None,
    **index,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per distinct word of at least `min_chars` code points and `min_count` occurrences.

    Words are maximal runs of letters, A-Z lower-cased only. With `drop_every`, an occurrence loses one code point where
    that number divides its hash (see `word_occurrences`). `form` is the commonest word one edit away (ties: the
    smallest) if it is `ratio` times as common, `root` the end of the chain of forms. Null and empty texts have no
    words; an occurrence whose document has a null id is left as it is; repeated rows count as often as they stand;
    very long texts and words are processed whole; an empty table gives none. Other columns are ignored.
    """
    found = word_occurrences(docs, id_col, text_col, min_chars, drop_every)
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.filter((F.col("n") >= min_count) & (F.length("word") >= min_chars)), "words")
    links = materialize(near_words(counts, min_chars, **index), "near")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    told = both.join(counts.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = told.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near"))).alias("best"))
    rows = counts.join(best, F.col("word") == F.col("a"), "left")
    top: Column = -F.col("best")["less"]
    is_form = top >= ratio * F.col("n")
    rows = rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best")["near"]).alias("form"),
        F.when(is_form, top).alias("form_n"),
    )
    rows = materialize(rows, "variants")
    roots = _roots(rows.filter("form is not null")).select(F.col("word").alias("w"), "root")
    whole = rows.join(roots, F.col("word") == F.col("w"), "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
