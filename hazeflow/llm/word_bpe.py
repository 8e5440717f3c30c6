"""BPE encoding through a distinct-word table, and decoding through an id-to-piece table.

Words are runs without ASCII white space, across which neither normalisation nor merges reach.

1. Blocks of documents are split in place. A document keeps the numbers of its words in its block's
   dictionary (the commonest word first, so most numbers take one or two bytes); a dictionary is cut by
   word hash into buckets. Documents are stored bucketed by block and never shuffled.
2. Only dictionaries are shuffled, by bucket. Equal words meet there, and each is encoded once.
3. The ids go back to the blocks and are joined to the documents by word position.

Every unit of work is bounded by the block size, however common a word is.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hazeflow.llm.frames import free_name, slices
from hazeflow.scratch import scratch_path

BLOCK_WORDS = 1_500_000
BUCKETS_PER_PARTITION = 4
DECODED_BYTES = 1 << 18  # of ids, joined at once
SPECIAL = "<|"  # texts with it are split but not lower-cased: special tokens are told apart by case


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the number of words of each text."""
    texts = pc.fill_null(texts, "")
    plain = pc.if_else(pc.match_substring(texts, SPECIAL), texts, pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(plain.cast(pa.large_string()))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(lists).filter(full).to_numpy(zero_copy_only=False)
    return flat.filter(full), np.bincount(owner, minlength=len(texts)).astype(np.int64)


PACKED_AT_ONCE = 1 << 18


def _pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of variable-length numbers, and how many bytes each takes."""
    parts = [_pack_some(numbers[i : i + PACKED_AT_ONCE]) for i in range(0, len(numbers), PACKED_AT_ONCE)]
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(0, np.int8)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _pack_some(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14) + (numbers >= 1 << 21) + (numbers >= 1 << 28)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]), np.uint8)
    at, rest, left = ends - sizes, numbers.astype(np.uint64), sizes.copy()
    while len(at):
        more = left > 1
        out[at] = (rest & 127) | (more.astype(np.uint64) << 7)
        at, rest, left = at[more] + 1, rest[more] >> 7, left[more] - 1
    return out, sizes.astype(np.int8)


def _unpack(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        has = first + k <= last
        out[has] |= (data[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _block_rows(block: int, ids: list[pa.Array], words: list[pa.Array], counts: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The block's dictionary, a row per bucket, then a row per document."""
    encoded = pa.chunked_array(words).dictionary_encode().chunks
    words.clear()
    codes = np.concatenate([e.indices.to_numpy(zero_copy_only=False) for e in encoded])
    dictionary = encoded[-1].dictionary
    del encoded
    used = np.bincount(codes, minlength=len(dictionary))
    rank = np.empty(len(used), np.int32)
    rank[np.argsort(-used, kind="stable")] = np.arange(len(used))
    texts = dictionary.cast(pa.large_binary()).to_pylist()
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in texts), np.int64, len(texts))
    order = np.lexsort((rank, bucket))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    own = [b for b in range(buckets) if edges[b] < edges[b + 1]]
    spelled = [_small(b" ".join(texts[i] for i in order[edges[b] : edges[b + 1]])) for b in own]
    ranks = [_pack(np.diff(rank[order[edges[b] : edges[b + 1]]], prepend=0))[0].tobytes() for b in own]
    none = pa.nulls(len(own), ids[0].type)
    yield _rows(block, pa.array(own, pa.int32()), pa.array(spelled, pa.binary()), pa.array(ranks, pa.binary()), none)
    packed, sizes = _pack(rank[codes])
    per_doc = np.concatenate(counts)
    ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)][np.r_[0, np.cumsum(per_doc)]]
    numbers = _binaries(packed, np.diff(ends)).cast(pa.binary())
    n = len(per_doc)
    yield _rows(block, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), numbers, pa.concat_arrays(ids))


def _rows(block: int, bucket: pa.Array, words: pa.Array, numbers: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    blocks = pa.array(np.full(len(bucket), block, np.int64))
    return pa.RecordBatch.from_arrays([blocks, bucket, words, numbers, ids], names=["block", "bucket", "words", "numbers", "id"])


def _splitter(buckets: int, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed blocks back at once
        place, made = TaskContext.get().partitionId(), 0
        ids, words, counts, held = [], [], [], 0
        for batch in batches:
            done = 0
            for part in slices(batch.column(1)):
                flat, sizes = _words(part)
                ids.append(batch.column(0).slice(done, len(part)))
                words.append(flat)
                counts.append(sizes)
                done, held = done + len(part), held + len(flat)
                if held >= block_words:
                    yield from _block_rows((place << 24) + made, ids, words, counts, buckets)
                    ids, words, counts, held, made = [], [], [], 0, made + 1
        if ids:
            yield from _block_rows((place << 24) + made, ids, words, counts, buckets)

    return run


def _encoder(tokenizer_json):
    """Each distinct word of a bucket is encoded once; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json.value)
        known: dict[bytes, bytes] = {}
        bucket = None
        for batch in batches:
            ids, sizes = [], []
            for own, spelled in zip(batch.column("bucket").to_pylist(), batch.column("words")):
                if own != bucket:
                    bucket, known = own, {}
                words = _whole(spelled.as_py()).split(b" ")
                new = [w for w in words if w not in known]
                for begin in range(0, len(new), 10_000):
                    part = new[begin : begin + 10_000]
                    found = tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)
                    known.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(part, found))
                pieces = [known[w] for w in words]
                flat = np.frombuffer(b"".join(pieces), np.uint32)
                ids.append(_small(_pack(flat)[0].tobytes()))
                sizes.append(_pack(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4)[0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("numbers"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())],
                names=["block", "numbers", "sizes", "ids"],
            )

    return run


def _assembler(table: list[str] | None):
    """Documents of one block with the ids of their words, and their pieces joined if there is a table of them."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        ranks, sizes, ids = [], [], []
        for r, s, i in zip(words["numbers"], words["sizes"], words["ids"]):
            ranks.append(np.cumsum(_unpack(np.frombuffer(r.as_py(), np.uint8))))
            sizes.append(_unpack(np.frombuffer(s.as_py(), np.uint8)))
            ids.append(_unpack(np.frombuffer(_whole(i.as_py()), np.uint8)).astype(np.uint32))
        rank = np.concatenate(ranks) if ranks else np.zeros(0, np.int64)
        size, begin = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        lengths = np.concatenate(sizes) if sizes else rank
        size[rank], begin[rank] = lengths, np.cumsum(lengths) - lengths
        out = []
        for numbers in docs["numbers"]:
            code = _unpack(np.frombuffer(numbers.as_py(), np.uint8))
            n = size[code]
            ends = np.cumsum(n)
            steps = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
            out.append(flat[np.repeat(begin[code], n) + steps].astype("<u4").tobytes())
        columns = {"id": docs["id"], "ids": pa.array(out, pa.binary())}
        if table is not None:
            pieces = pa.array(table, pa.large_string())
            columns["decoded"] = pa.chunked_array([_joined(p, pieces) for p in slices(columns["ids"], DECODED_BYTES)], pa.string())
        return pa.table(columns)

    return run


def encode(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, decoded: bool = False
) -> DataFrame:
    """(id_col, ids): each row's token ids as little-endian unsigned 32-bit integers; with `decoded` also what `decode` gives.

    `tokenizer_json` is the content of a tokenizers file whose normaliser and pre-tokeniser drop white
    space and fold case. Null and empty texts have no ids. Rows may repeat and ids may be null: rows are
    joined by position in their block, not by id. Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_PARTITION * parts
    kind = docs.schema[id_col].dataType
    schema = f"block bigint, bucket int, words binary, numbers binary, id {kind.simpleString()}"
    split = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_splitter(buckets, block_words), schema)
    name = f"hazeflow_words_{uuid.uuid4().hex}"
    split.write.bucketBy(parts, "block").format("parquet").option("compression", "zstd").option("path", scratch_path(spark, "words")).saveAsTable(name)
    stored = spark.table(name)
    words = stored.filter(F.col("bucket").isNotNull()).select("block", "bucket", "words", "numbers")
    told = words.repartition(parts, "bucket").sortWithinPartitions("bucket")
    spelled = told.mapInArrow(_encoder(spark.sparkContext.broadcast(tokenizer_json)), "block bigint, numbers binary, sizes binary, ids binary")
    numbered = stored.filter(F.col("bucket").isNull()).select("block", "numbers", "id")
    table = _pieces(tokenizer_json) if decoded else None
    shape = f"id {kind.simpleString()}, ids binary" + (", decoded string" if decoded else "")
    out = numbered.groupBy("block").cogroup(spelled.groupBy("block")).applyInArrow(_assembler(table), shape)
    return out.withColumnRenamed("id", id_col)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def _pieces(tokenizer_json: str) -> list[str]:
    """The tokenizer's pieces by id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    if tokenizer.decoder is not None:
        raise ValueError("the tokenizer has a decoder of its own")
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    table: list[str] = [""] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        table[number] = piece
    return table


def decode(tokens: DataFrame, tokenizer_json: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """`tokens` with the text `name`: the ids' pieces with a space between, special tokens included.

    For tokenizer files without a decoder. The table of pieces has the tokenizer's fixed size, so every task holds
    it and joins ids by position. Null ids give null; `name` must be free.
    """
    if name != free_name(tokens, name):
        raise ValueError(f"column {name} exists")
    table = _pieces(tokenizer_json)
    place = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        pieces = pa.array(table, pa.large_string())
        for batch in batches:
            done = 0
            for part in slices(batch.column(place), DECODED_BYTES):
                rows, done = batch.slice(done, len(part)), done + len(part)
                yield pa.RecordBatch.from_arrays([*rows.columns, _joined(part, pieces)], names=[*batch.schema.names, name])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(name, T.StringType())]))


def _joined(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    filled = pc.fill_null(ids, b"")
    flat = np.frombuffer(b"".join(filled.to_pylist()), "<u4")
    ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False) // 4)
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int64)), pieces.take(pa.array(flat)))
    joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
    return pc.if_else(ids.is_null(), pa.nulls(len(ids), pa.string()), joined)
