import hashlib

import numpy as np
import pytest
from conftest_llm import SF, needs_tables
from tokenizers import Tokenizer

from hazeflow.llm import catalog, queries, word_bpe

ODD = [
    None, "", "   ", "<|endoftext|>", "A<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>X", "İstanbul K ΑΣ ΣΑ", "é a ́b", "x\x0by\x0cz",
    "it's DON'T", "日本語 テスト", "🙂🙂 ok", "a\x85b", " line", "ǅ ß ẞ ﬁ", "1234 ½ ²", "\x00\x01 \x1c\x1d a\x1fb", "a" * 5000,
    "İ̇İ", "Å Å", "﻿bom", "a​b ᠎ c", "word " * 3000, " ".join(f"n{i}" for i in range(70_000)),
]


def plain(rows):
    tokenizer, out = Tokenizer.from_str(catalog.tokenizer_json()), []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@needs_tables
def test_query_equals_the_library(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert told(queries.all_queries()["op8_bpe_encoding_and_decoding"](spark, SF)) == plain(rows)


@pytest.mark.parametrize("block_words", [word_bpe.BLOCK_WORDS, 50])
def test_odd_texts_and_repeated_rows(docs_of, monkeypatch, block_words):
    monkeypatch.setattr(word_bpe, "BLOCK_WORDS", block_words)
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD)] + [(7, "again"), (7, "again")]
    assert told(catalog.token_digests(docs_of(rows))) == plain(rows)
    assert catalog.token_digests(docs_of(rows).limit(0)).count() == 0


def test_small_blocks(docs_of, spark):
    rows = [(i, " ".join(f"w{j * i % 13}" for j in range(i))) for i in range(60)]
    tokens = word_bpe.encode(docs_of(rows), catalog.tokenizer_json(), block_words=40)
    decoded = word_bpe.decode(tokens, catalog.tokenizer_json(), name="text").collect()
    tokenizer = Tokenizer.from_str(catalog.tokenizer_json())
    assert {r.doc_id: r.text for r in decoded} == {i: tokenizer.decode(tokenizer.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows}


def test_packed_numbers():
    numbers = np.r_[0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31, np.arange(300_000)]
    data, sizes = word_bpe._pack(numbers)
    assert int(sizes.sum()) == len(data) and np.array_equal(word_bpe._unpack(data), numbers)
    assert len(word_bpe._pack(numbers[:0])[0]) == 0 and len(word_bpe._unpack(data[:0])) == 0
