"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, a stated query set, are cut into blocks of bounded size; one automaton holds a block. Each
training text is streamed through it once, and the automaton's state keeps the longest item passage
that ends at the current word. Where that length reaches the window, the window's words are hit. There
is no shuffle: documents stay where they are read. With more than one block the passes follow each
other, and what they found is written to the scratch folder in between.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from hazeflow.llm.frames import col, free_name, slices, utf8
from hazeflow.scratch import materialize

WINDOW = 13
COVERAGE = 0.05
BLOCK_WORDS = 100_000  # item words in one automaton; more items make more passes
PIECE_WORDS = 2_000  # longer items are cut into pieces that overlap by a window less one word

# A-Z to lower case, and all other ASCII but digits and a-z to a space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

FOUND = "struct<n_words:bigint,hits:array<struct<first:bigint,last:bigint,begin:bigint,end:bigint,longest:bigint>>,items:array<string>>"

_FOUND_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "begin", "end", "longest")]))),
        ("items", pa.list_(pa.string())),
    ]
)


class Automaton:
    """Suffix automaton of several word sequences; transitions are keyed by word number."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        numbered = [(item, [self.words.setdefault(w, len(self.words)) for w in words]) for item, words in pieces if words]
        for _, numbers in numbered:
            last = 0
            for w in numbers:
                last = self._extend(last, w)
        n = len(self.length)
        self.holder = [0] * n  # the state, itself or a suffix of it, that holds its window-long suffix
        whole: list[list] = [[] for _ in range(n)]  # short items that end in a state
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.holder[v] = v if self.length[up] < window else self.holder[up]
        self.items: dict[int, set[str]] = {}
        for item, numbers in numbered:
            v = 0
            for i, w in enumerate(numbers):
                v = self.next[v][w]
                if i + 1 >= window:
                    self.items.setdefault(self.holder[v], set()).add(item)
            if len(numbers) < window:
                whole[v].append((len(numbers), item))
        self.short: list[tuple] = [()] * n
        for v in order:  # a suffix's short items end here too
            self.short[v] = self.short[self.link[v]] + tuple(whole[v])
        self.shortest = min([window, *(len(x) for _, x in numbered)])

    def _add(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier item already has this
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._add(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit stretches [first, last, longest match] in order, and the items whose windows occur."""
        numbers = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        # no match crosses a word that no item has
        walls = np.r_[-1, np.flatnonzero(numbers < 0), len(words)]
        hits: list[list[int]] = []
        items: set[str] = set()
        for k in np.flatnonzero(np.diff(walls) > self.shortest):
            begin, end = int(walls[k]) + 1, int(walls[k + 1])
            self._stream(numbers[begin:end].tolist(), begin, hits, items)
        return hits, items

    def _stream(self, numbers: list[int], begin: int, hits: list, items: set) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, w in enumerate(numbers, begin):
            to = following[state].get(w)
            while to is None:
                state = link[state]
                matched = length[state]
                to = following[state].get(w)  # the root has every word of the vocabulary
            state, matched = to, matched + 1
            if matched >= window:
                items |= self.items[self.holder[state]]
                _hit(hits, i - window + 1, i, matched)
            for size, item in self.short[state]:
                if size <= matched:
                    items.add(item)
                    _hit(hits, i - size + 1, i, matched)


def _hit(hits: list[list[int]], first: int, last: int, longest: int) -> None:
    """Add a stretch that ends no earlier than the last one; stretches that touch become one."""
    while hits and first <= hits[-1][1] + 1:
        before = hits.pop()
        first, longest = min(first, before[0]), max(longest, before[2])
    hits.append([first, last, longest])


def _placed(text: bytes, folded: bytes, hits: list[list[int]]) -> list[dict]:
    """The stretches with their places in the text in code points."""
    wanted = {h[0] for h in hits} | {h[1] for h in hits}
    spans = {i: m.span() for i, m in enumerate(_WORD.finditer(folded)) if i in wanted}

    def point(at: int) -> int:
        return len(text[:at].decode("utf-8", "replace"))

    return [{"first": a, "last": b, "begin": point(spans[a][0]), "end": point(spans[b][1]), "longest": n} for a, b, n in hits]


def _joined(ours: list[dict], before: list[dict] | None) -> list[dict]:
    if not before:
        return ours
    out: list[dict] = []
    for h in sorted([*ours, *before], key=lambda x: x["first"]):
        if out and h["first"] <= out[-1]["last"] + 1:
            last = out[-1]
            tail = h if h["last"] > last["last"] else last
            out[-1] = {**last, "last": tail["last"], "end": tail["end"], "longest": max(last["longest"], h["longest"])}
        else:
            out.append(h)
    return out


def _matcher(pieces: list[tuple[str, list[str]]], window: int):
    built: list[Automaton] = []

    def one(text: bytes, hits_before, items_before) -> dict:
        if not built:
            built.append(Automaton([(i, [w.encode() for w in words]) for i, words in pieces], window))
        folded = text.translate(_FOLD)
        words = folded.split()
        hits, items = built[0].match(words)
        placed = _joined(_placed(text, folded, hits) if hits else [], hits_before)
        return {"n_words": len(words), "hits": placed, "items": sorted(items | set(items_before or ()))}

    return one


def _first_pass(match):
    @arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        found = [match(t, None, None) for part in slices(texts) for t in utf8(part)]
        return pa.array(found, type=_FOUND_TYPE)

    return run.asNondeterministic()


def _later_pass(match):
    @arrow_udf(FOUND)
    def run(texts: pa.Array, before: pa.Array) -> pa.Array:
        found = [match(t, b["hits"], b["items"]) for t, b in zip(utf8(texts), before.to_pylist())]
        return pa.array(found, type=_FOUND_TYPE)

    return run.asNondeterministic()


def item_pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words): the items' word sequences, long ones in overlapping pieces. Rows without id or words go."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("words")).filter("item is not null and size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE_WORDS - window + 1))
    cut = items.select("item", "words", F.explode(starts).alias("start"))
    return cut.select("item", F.slice("words", F.col("start") + 1, F.lit(PIECE_WORDS)).alias("words")).distinct()


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    name: str = "found",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`docs` with a struct `name`: n_words, hits (word and code point places, longest match), items.

    A-Z is lower-cased; words are runs of digits, a-z and non-ASCII characters. A window is `window`
    consecutive words of an item, or a shorter item as a whole; a word inside any occurrence of a window
    is hit. Null and empty texts have no words. Items without an id or without words are left out, equal
    ids are one item, and an empty benchmark hits nothing. Rows and other columns of `docs` are untouched;
    `name` must be free.
    """
    if name != free_name(docs, name):
        raise ValueError(f"column {name} exists")
    pieces = materialize(item_pieces(benchmark, item_id_col, item_text_col, window), "items")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    out = docs
    for block in range(blocks):
        held = [(r.item, list(r.words)) for r in placed.filter(F.col("block") == block).collect()]  # about block_words words
        match = _matcher(held, window)

        if block == 0:
            out = out.withColumn(name, _first_pass(match)(col(text_col)))
        else:
            out = materialize(out, "passages").withColumn(name, _later_pass(match)(col(text_col), col(name)))
    return out


def n_hit(found: Column) -> Column:
    return F.aggregate(found["hits"], F.lit(0).cast("long"), lambda a, h: a + h["last"] - h["first"] + 1)


def contaminated(found: Column, coverage: float = COVERAGE) -> Column:
    """At least one hit word, and at least the share `coverage` of the words."""
    hit = n_hit(found)
    return (hit > 0) & (hit >= F.lit(coverage).cast("decimal(10,6)") * found["n_words"])


def _cut_out(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for text, b, e in zip(texts.to_pylist(), begins.to_pylist(), ends.to_pylist()):
        if text is not None and b:
            edges = [0, *(x for pair in zip(b, e) for x in pair), len(text)]
            text = "".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        out.append(text)
    return pa.array(out, pa.string())


def without_spans(text: Column, spans: Column) -> Column:
    """The text less the code points [begin, end) of ordered, disjoint spans; null spans cut nothing."""
    cut = arrow_udf(_cut_out, "string").asNondeterministic()(text, spans["begin"], spans["end"])
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", coverage: float = COVERAGE, max_length: int | None = None, **options
) -> DataFrame:
    """`docs` without the documents whose hit words reach the share `coverage`.

    With `max_length`, passages of more words than that are also cut from the documents that stay.
    Columns stay as they are.
    """
    found = free_name(docs, "found")
    out = find_passages(docs, benchmark, text_col, name=found, **options).filter(~contaminated(col(found), coverage))
    if max_length is not None:
        long = F.filter(col(found)["hits"], lambda h: h["last"] - h["first"] + 1 > max_length)
        out = out.withColumn(text_col, without_spans(col(text_col), long))
    return out.drop(found)
