"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SF, lower, needs_tables
from pyspark.sql import functions as F

from hazeflow.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def occurrences(rows, drop_every):
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if drop_every and doc_id is not None and h % drop_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            yield run


def plain(rows, drop_every=31, min_chars=7, min_count=2, ratio=10):
    n = {w: c for w, c in Counter(occurrences(rows, drop_every)).items() if len(w) >= min_chars and c >= min_count}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, []) if v != w and one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= ratio * n[w] else None for w, v in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def told(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def made_rows(seed=5, docs=120):
    rng = random.Random(seed)
    syllables = ["an", "ter", "ê", "ou", "ing", "tion", "aa", "qué", "ß", "l", "÷x", "re"]
    stems = ["".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(80)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.randint(3, 80)])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "Z" + w[k + 1 :], w + "s"])
            words.append(w.capitalize() if rng.random() < 0.3 else w)
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_made_rows(docs_of, seed):
    rows = made_rows(seed)
    assert told(spelling.spelling_variants(docs_of(rows), drop_every=31)) == plain(rows)


@pytest.mark.parametrize("index", [{"frequent": 0, "max_gram": 4}, {"frequent": 3, "merged": 1}, {"min_gram": 1, "max_gram": 2, "merged": 2}])
def test_index_parameters_change_nothing(docs_of, index):
    rows = made_rows(7)
    expected = plain(rows, drop_every=None)
    assert any(v[0] for v in expected.values())
    assert told(spelling.spelling_variants(docs_of(rows), **index)) == expected


def test_odd_rows(docs_of):
    long_word = "".join(random.Random(1).choices("abcdeé", k=3000))
    rows = [
        (1, None), (2, ""), (3, "a b× \U0001f600 12345678"), (4, long_word + " " + long_word), (4, long_word + " " + long_word),
        (5, (long_word[:1500] + "z" + long_word[1500:] + " ") * 50), (None, "nullword nullword"), (6, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa " * 3),
        (7, "ÀÀÀÀÀÀÀ " * 30), (8, "exactly exactly"), (8, "exactlx exactlx"),
    ]
    assert told(spelling.spelling_variants(docs_of(rows), drop_every=31)) == plain(rows)
    assert spelling.spelling_variants(docs_of([]), drop_every=31).count() == 0


def test_chain_of_forms_and_ties(docs_of):
    rows = [(1, "lantern " * 2000 + "lanterm " * 200 + "lantrm " * 9 + "xantrerm " * 20 + "lanterme " * 19 + "lantexm " * 2)]
    assert told(spelling.spelling_variants(docs_of(rows))) == plain(rows, None)
    rows = [(1, "bananas " * 40 + "banamas " * 40 + "banafas " * 2)]
    assert told(spelling.spelling_variants(docs_of(rows)))["banafas"] == ("banamas", "banamas", 2, 2, 40)


def test_one_frequent_list_is_whole(docs_of):
    rows = [(i, f"prefixes{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}ending " * 2) for i in range(400)]
    assert told(spelling.spelling_variants(docs_of(rows))) == plain(rows, None)


def test_every_edit_leaves_a_gram():
    codes = np.array([[ord(c) for c in w] for w in ("aaaaaaa", "abcdefg")], np.uint64)
    levels = np.full(spelling.SLOTS, 255, np.uint8)
    lengths, _, _ = spelling.decompose(codes, levels, 2, 4, 0)
    assert (lengths.shape[1] - spelling.affected_bound(lengths) >= 1).all()


def test_parameters_are_checked(docs_of):
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs_of([]), max_gram=5)


@needs_tables
def test_sample_table(spark):
    docs = queries.table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    result = queries.all_queries()["op13_spelling_variants"](spark, SF)
    assert told(result) == plain(rows)
    assert result.select(F.sum("n")).first()[0] > 1000
