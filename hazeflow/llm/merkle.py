"""Merkle manifest of a table: a leaf per row, a tree per language, a tree over the languages' roots, and a proof per row.

Positions come from one ordered table of leaf digests (texts are hashed where they lie and never moved). A tree is cut
into superblocks of `FAN ** HEIGHT` consecutive leaves:

1. Each superblock is reduced to its top node. The tops are the leaves of the next tree up, until one root is left.
2. Coming down again, leaves and the one outer row of their superblock (digests left and right of the path, from the
   superblock to the root) are cogrouped by superblock. A task then finishes the local reduction, joins
   the local siblings with the outer ones, and folds every leaf up to the root.

A group in a task is one superblock, whatever the sizes of the languages; the number of rounds grows with the
logarithm of the rows. A lost executor costs its tasks: every table between rounds is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hazeflow.llm.frames import col, utf8
from hazeflow.operators import ordering
from hazeflow.scratch import discard, materialize

FAN, HEIGHT = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3

PATH = "array<struct<before: string, after: string>>"
_OUTER = f"tree string, top long, path {PATH}, subroot string, root string"


def _digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def _part(value: str | bytes | None) -> bytes:
    if value is None:
        return b"-"
    raw = value if isinstance(value, bytes) else value.encode()
    return b"%d:%b" % (len(raw), raw)


def _leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaf digests, and those of tampered rows with A-Z of the text lower-cased; texts one by one."""
    for batch in batches:
        heads = [batch.column(i).to_pylist() for i in range(1, 5)]
        texts, tampers = batch.column(5), batch.column(6).to_pylist()
        leaves, altered = [], []
        for k, tamper in enumerate(tampers):
            head = b"".join(_part(h[k]) for h in heads)
            raw = utf8(texts.slice(k, 1))[0] if texts[k].is_valid else None
            leaves.append(hashlib.sha256(head + _part(raw)).hexdigest())
            altered.append(hashlib.sha256(head + _part(raw.lower() if raw is not None else None)).hexdigest() if tamper else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array(leaves, pa.string()), pa.array(altered, pa.string())], names=["doc_id", "tree", "leaf", "tampered"]
        )


def _runs(level: list[str]) -> list[str]:
    return [_digest("".join(level[i : i + FAN])) for i in range(0, len(level), FAN)]


def _levels(leaves: list[str], height: int, whole: bool) -> list[list[str]]:
    """The levels of a superblock from its leaves up; one that is the whole tree ends at its single node."""
    levels = [leaves]
    while len(levels) <= height and not (whole and len(levels[-1]) == 1):
        levels.append(_runs(levels[-1]))
    return levels


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Digests left and right of the path from leaf `at` to the top, run by run."""
    path = []
    for level in levels[:-1]:
        begin = at - at % FAN
        path.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + FAN])))
        at //= FAN
    return path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and the digests beside its path give."""
    for before, after in path:
        leaf = _digest(before + leaf + after)
    return leaf


def _reduced(height: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        top = _levels(block["digest"].tolist(), height, bool(block["size"].iloc[0] <= FAN**height))[-1]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "pos": [int(block["top"].iloc[0])], "digest": top})

    return run


def _block_of(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("top", F.expr(f"pos div {FAN**height}"))


def _positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """`pos` of each row inside its `tree`, `size` of the tree; rows in order of `keys`."""
    laid = ordering.order_index(df, ["tree", *keys])
    sizes = laid.groupBy("tree").agg(F.min(ordering.POS).alias("begin"), F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes.withColumnRenamed("tree", "t"), "trees")  # a row per tree, so that the join can split a large one
    placed = laid.join(sizes, F.col("tree").eqNullSafe(F.col("t")))
    return placed.withColumn("pos", F.col(ordering.POS) - F.col("begin")).drop("t", "begin", ordering.POS, ordering.PART)


def _outer_rows(nodes: DataFrame, height: int, forest: bool) -> DataFrame:
    """(tree, top, path, subroot, root): for each superblock of the stored `nodes` what lies between its top and the root."""
    blocks = _block_of(nodes, height)
    tops = blocks.groupBy("tree", "top").applyInPandas(_reduced(height), "tree string, pos long, digest string")
    sizes = nodes.groupBy("tree").agg(F.expr(f"ceil(max(size) / {FAN**height})").cast("long").alias("size")).withColumnRenamed("tree", "t")
    tops = tops.join(materialize(sizes, "trees"), F.col("tree").eqNullSafe(F.col("t"))).drop("t")
    tops = materialize(tops, "tops")
    rows, largest = tops.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    if largest > 1:
        outer = _outer_rows(tops, height, forest)
        paths = _with_outer(tops, outer, height, _path_rows(height), _OUTER)
        return materialize(paths, "outer")
    if not forest:  # a single node, or none
        path = F.array().cast(PATH)
        return tops.select("tree", F.col("pos").alias("top"), path.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    # the trees' roots are the leaves of one more tree; what lies above a root is the outer row of the tree below it
    roots = _positions(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    roots = materialize(roots, "roots")
    above = _outer_rows(roots, height, False)
    schema = _OUTER.replace("tree string, top long", "pos long")
    paths = _with_outer(roots, above, height, _path_rows(height, "pos"), schema)
    named = paths.withColumnRenamed("pos", "p").join(roots, F.col("p") == F.col("pos"))
    return materialize(named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("top"), "path", F.col("digest").alias("subroot"), "root"), "outer")


def _with_outer(nodes: DataFrame, outer: DataFrame, height: int, finish, schema: str) -> DataFrame:
    """Superblocks of `nodes` cogrouped with their outer rows; both sides hold a whole superblock at most."""
    blocks = _block_of(nodes, height)
    return blocks.groupBy("tree", "top").cogroup(outer.groupBy("tree", "top")).applyInPandas(finish, schema)


def _joined(block: pd.DataFrame, outer: pd.DataFrame, height: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(row of the sorted block, path from leaf to root)."""
    levels = _levels(block["digest"].tolist(), height, bool(block["size"].iloc[0] <= FAN**height))
    rest = [(p["before"], p["after"]) for p in outer["path"].iloc[0]]
    for at in range(len(block)):
        yield at, _siblings(levels, at) + rest


def _path_rows(height: int, key: str = "top"):
    """Outer rows of the blocks below: the path of each of these nodes, which are those blocks' tops."""

    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        paths = [[{"before": b, "after": a} for b, a in path] for _, path in _joined(block, outer, height)]
        found = {"tree": block["tree"], "top": block["pos"]} if key == "top" else {"pos": block["pos"]}
        known = {name: outer[name].iloc[0] for name in ("subroot", "root")}
        return pd.DataFrame({**found, "path": pd.Series(paths, index=block.index), **known})

    return run


def _proof_rows(height: int):
    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        altered, leaves = block["tampered"].tolist(), block["digest"].tolist()
        proofs, folded = [], []
        for at, path in _joined(block, outer, height):
            proofs.append(_digest("".join(before + after for before, after in path)))
            folded.append(fold(altered[at] if altered[at] is not None else leaves[at], path))
        known = {name: outer[name].iloc[0] for name in ("subroot", "root")}
        return pd.DataFrame({"doc_id": block["doc_id"], "leaf": leaves, **known, "proof_sha256": proofs, "folded_root": folded}, index=block.index)

    return run


def manifest(docs: DataFrame, tamper: Column | None = None, fields: tuple[str, ...] = FIELDS, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row per row of `docs`.

    `fields` name id, source, language, length and text. A leaf is the hash of the fields, each `-` if null, else byte
    count, `:` and value. Leaves stand by language (null is a language of its own, first), then id (null first), then
    digest; repeated rows are leaves of their own. Where `tamper` (a condition on `docs`) holds, folding starts
    from the row with A-Z of its text lower-cased; null and empty texts stay as they are. Very long texts are hashed
    whole, one at a time. An empty table gives no rows. Other columns are ignored.
    """
    tampered = F.coalesce(tamper, F.lit(False)) if tamper is not None else F.lit(False)
    shown = [col(name).cast("string").alias(f"f{i}") for i, name in enumerate(fields)]
    whole = docs.select(col(fields[0]).cast("long").alias("doc_id"), *shown, tampered.alias("tampered"))
    leaves = whole.mapInArrow(_leaf_rows, "doc_id long, tree string, leaf string, tampered string")
    # written once, as ordering reads it twice; the row's number lets very many copies of one row fill several partitions
    leaves = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = _positions(leaves, ["doc_id", "leaf", "row"]).withColumnRenamed("leaf", "digest").drop("row")
    placed = materialize(placed, "placed")
    discard(leaves)
    outer = _outer_rows(placed, height, True)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    proofs = _with_outer(placed, outer, height, _proof_rows(height), schema)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
