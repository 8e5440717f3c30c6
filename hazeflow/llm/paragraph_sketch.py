"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text is the set of its paragraph pieces (lines, cut every `PIECE` code points), each named by a 64-bit digest. A sketch
has three tables of equal size; a digest lies in one cell of each. A cell holds how many digests lie in it, their
exclusive-or, and the exclusive-or of their check hashes.

Two versions' sketches are subtracted cell by cell: what both have cancels. The rest is peeled: a cell with one digest
left (its check hash tells) gives it up, and it is taken out of its other cells. Tables take turns, so no digest
is taken out twice. If cells are left, the sketch was too small for the difference, and that pair is sketched
again at twice the size.

Everything of a pair lies in one partition, so a round over the three tables is aggregates without a shuffle between them;
what is left after a round, a small part, is written and goes on. Texts move twice: once to meet their place in the order of ids, and their first half to the document before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazeflow.llm.frames import col
from hazeflow.operators import ordering
from hazeflow.scratch import discard, materialize

PIECE = 128
TABLES = 3
FIRST_SIZE = 4  # cells a table of the fingerprint, and the least of a sketch to be peeled
ROOM = 3  # cells for each digest that is expected to differ
ATTEMPTS = 32
CHECK = 101

KEY = ["id0", "no_id", "tx", "n"]


def pieces(text: Column, piece: int = PIECE) -> Column:
    """Distinct digests of a text's paragraph pieces; none for a text without any."""
    found = F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{piece}}}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _cell(digest: Column, table: int, size: Column, attempt: int) -> Column:
    place = F.pmod(F.xxhash64(digest, F.lit(attempt * TABLES + table)), size.cast("long"))
    return (F.lit(table) * size + place).cast("int")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(CHECK))


def sketch_cells(digests: DataFrame, by: list[str], size: Column, attempt: int = 0) -> DataFrame:
    """(by..., cell, n, key, chk): the cells that aren't empty, of rows (by..., digest, sign); signs subtract."""
    places = F.array(*[_cell(F.col("digest"), t, size, attempt) for t in range(TABLES)])
    rows = digests.select(*by, F.explode(places).alias("cell"), "digest", "sign", _check(F.col("digest")).alias("check"))
    cells = rows.groupBy(*by, "cell").agg(
        F.sum("sign").alias("n"), F.bit_xor("digest").alias("key"), F.bit_xor("check").alias("chk")
    )
    return cells.filter("n <> 0 or key <> 0 or chk <> 0")


def fingerprint_strings(versions: DataFrame, columns: dict[str, str], size: int = FIRST_SIZE) -> DataFrame:
    """(pos, one string per column of digests): the number of digests and the cells of a small sketch, as hex digits."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("digests")) for i, c in enumerate(columns)])
    parts = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = versions.repartition(parts, "pos").select("pos", F.explode(sides).alias("s"))
    rows = rows.select("pos", F.col("s")["side"].alias("side"), F.explode("s.digests").alias("digest"), F.lit(1).alias("sign"))
    cells = sketch_cells(rows, ["pos", "side"], F.lit(size))
    code = F.concat(F.lpad(F.hex("n"), 8, "0"), F.lpad(F.hex("key"), 16, "0"), F.lpad(F.hex("chk"), 16, "0"))
    empty = "0" * 40
    told = cells.groupBy("pos").agg(F.collect_list(F.struct((F.col("side") * TABLES * size + F.col("cell")).alias("at"), code.alias("code"))).alias("cells"))
    told = told.select(F.col("pos").alias("at"), F.map_from_entries("cells").alias("cells"))
    joined = versions.select("pos", *[F.size(c).cast("long").alias(f"n_{i}") for i, c in enumerate(columns)]).join(told, F.col("pos") == F.col("at"), "left")

    def string(i: int) -> Column:
        own = F.sequence(F.lit(i * TABLES * size), F.lit((i + 1) * TABLES * size - 1))
        found = F.transform(own, lambda k: F.coalesce(F.get(F.array(F.element_at("cells", k)), F.lit(0)), F.lit(empty)))
        return F.lower(F.concat(F.lpad(F.hex(f"n_{i}"), 8, "0"), F.array_join(found, "")))

    return joined.select("pos", *[string(i).alias(name) for i, name in enumerate(columns.values())])


def _peeled(cells: DataFrame, by: list[str], attempt: int, recovered: bool) -> DataFrame:
    """Rows after each table was peeled once: the cells that are left, and what was recovered.

    That is in rows with cell -1 (only the first version has it) and -2 (only the second), `n` counting; with `recovered`
    there is one for each digest, in `key`.
    """
    size, key, n, zero = F.col("size"), F.col("key"), F.col("n"), F.lit(0).cast("long")
    fields = ("cell", "tell", "n", "key", "chk")

    def row(*values: Column) -> Column:
        return F.struct(*[v.alias(name) for v, name in zip(values, fields)])

    rows = cells.select(*by, "cell", zero.alias("tell"), "n", "key", "chk")
    for table in range(TABLES):
        alone = (F.abs("n") == 1) & (F.col("cell") >= table * size) & (F.col("cell") < (table + 1) * size)
        alone = alone & (F.col("chk") == _check(key)) & (F.col("cell") == _cell(key, table, size, attempt))
        taken = [row(_cell(key, t, size, attempt), zero, -n, key, F.col("chk")) for t in range(TABLES)]
        told = row(F.when(n == 1, -1).otherwise(-2), key if recovered else zero, F.abs("n"), key if recovered else zero, zero)
        own = row(*[F.col(f) for f in fields])
        step = F.explode(F.when(alone, F.array(own, *taken, told)).otherwise(F.array(own)))
        rows = rows.select(*by, step.alias("s")).select(*by, "s.*").groupBy(*by, "cell", "tell")
        rows = rows.agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
        rows = rows.filter("cell < 0 or n <> 0 or key <> 0 or chk <> 0")
    return rows.drop("tell")


def differences(sides: DataFrame, sizes: DataFrame, attempts: int = ATTEMPTS, recovered: bool = False) -> DataFrame:
    """(pair, kind, a_only, b_only), a row per pair that differs: how many digests only one version has.

    With `recovered` also which, as arrays `a_digests` and `b_digests`. `sides` has rows (pair, kind, sign, digests), sign
    1 for the first version and -1 for the second, digests without repeats; `sizes` has (pair, kind, size), the
    cells a table to begin with. Both are stored tables. Pairs with equal versions have no row.
    """
    parts = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by, found = ["pair", "kind", "size"], []
    for attempt in range(attempts):
        asked = sizes.select(F.col("pair").alias("p"), F.col("kind").alias("k"), "size").repartition(parts, "p")
        met = sides.repartition(parts, "pair").join(asked, (F.col("pair") == F.col("p")) & (F.col("kind") == F.col("k")))
        rows = met.select(*by, "sign", F.explode("digests").alias("digest"))
        state = materialize(_peeled(sketch_cells(rows, by, F.col("size"), attempt), by, attempt, recovered), "peeled")
        told, cells, before = [state.filter("cell < 0")], state.filter("cell >= 0"), None
        while True:
            left = cells.count()
            if not left or left == before:
                break
            state = materialize(_peeled(cells.repartition(parts, "pair"), by, attempt, recovered), "peeled")
            told.append(state.filter("cell < 0"))
            cells, before = state.filter("cell >= 0"), left
        failed = materialize(cells.select(*by).distinct(), "failed") if left else None
        for part in told:
            if failed is not None:
                part = part.join(failed.withColumnsRenamed({"pair": "p", "kind": "k"}), (F.col("pair") == F.col("p")) & (F.col("kind") == F.col("k")), "left_anti")
            found.append(part.select("pair", "kind", "cell", "n", "key"))
        if failed is None:
            break
        sizes = failed.withColumn("size", F.col("size") * 2)
    else:
        raise RuntimeError(f"sketches not decoded in {attempts} sizes")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    first, second = F.col("cell") == -1, F.col("cell") == -2
    lists = [F.collect_list(F.when(side, F.col("key"))).alias(c) for side, c in ((first, "a_digests"), (second, "b_digests"))] if recovered else []
    counts = [F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).alias(c) for side, c in ((first, "a_only"), (second, "b_only"))]
    return every.groupBy("pair", "kind").agg(*counts, *lists)


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their key and text; a row per distinct document with its place, the one before it, and the next one's length)."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    base = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("id0"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("tx"), F.length("text").alias("n"), "text"
    )
    keys = materialize(base.groupBy("doc_id", *KEY).agg(F.count(F.lit(1)).alias("copies")), "keys")
    placed = ordering.add_positions(ordering.lay_out(keys, ["doc_id", "tx", "n"], unique=True))
    blocks = ordering.row_blocks(placed, before=1, after=1)
    window = ordering.block_window(blocks)
    before = F.struct(F.col(ordering.POS).alias("pos"), *KEY)
    moved = blocks.withColumn("before", F.lag(before).over(window)).withColumn("next_n", F.lead("n").over(window))
    order = ordering.own_rows(moved).withColumnRenamed(ordering.POS, "pos").drop(ordering.PART)
    order = materialize(order, "order")
    ends = order.agg(F.max_by(F.struct("pos", *KEY), "pos").alias("last"), F.min_by("n", "pos").alias("first_n")).first()
    if ends["last"] is not None:  # the last document's next is the first
        last = F.struct(*[F.lit(ends["last"][c]).cast(t).alias(c) for c, t in (("pos", "long"), ("id0", "long"), ("no_id", "boolean"), ("tx", "long"), ("n", "int"))])
        order = order.withColumn("before", F.coalesce("before", last)).withColumn("next_n", F.coalesce("next_n", F.lit(ends["first_n"])))
    return base.select(*KEY, "text"), order


def versions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(doc_id, copies, pos, before, next_n, n, edited_sha256, own, edited), a stored row per distinct document in order of ids.

    `edited` are the digests of the text whose last half is replaced by the beginning of the next document's.
    """
    base, order = _ordered(docs, id_col, text_col)
    again = order.filter("copies > 1").select(*[F.col(c).alias(f"{c}_") for c in KEY])
    if again.limit(1).count():  # repeated rows: one of each, gathered map-side
        same = [F.col(c) == F.col(f"{c}_") for c in KEY]
        base = base.join(again, same, "left_anti").unionByName(base.join(again, same, "left_semi").dropDuplicates(KEY))
    # both uses of `base` share one shuffle by its key
    own = base.join(order.select(*KEY, "doc_id", "copies", "pos", F.col("before")["pos"].alias("before"), "next_n"), KEY)
    given = base.join(order.select(*KEY, F.col("before").alias("to")), KEY)
    heads = given.select(
        *[F.col("to")[c].alias(f"{c}_") for c in KEY], F.substring("text", F.lit(1), F.expr("to.n div 2")).alias("head")
    )
    met = own.join(heads, [F.col(c) == F.col(f"{c}_") for c in KEY])
    kept = F.substring("text", F.lit(1), F.expr("n - n div 2"))
    texts = met.select("doc_id", "copies", "pos", "before", "next_n", "n", "text", F.concat(kept, "head").alias("new"))
    found = texts.select(
        "doc_id", "copies", "pos", "before", "next_n", "n", F.sha2("new", 256).alias("edited_sha256"),
        pieces(F.col("text"), piece).alias("own"), pieces(F.col("new"), piece).alias("edited"),
    )
    found = materialize(found, "versions")
    discard(order)
    return found


def _first_size(expected: Column) -> Column:
    """Cells a table: the least power of two times `FIRST_SIZE` with `ROOM` cells for each digest expected to differ."""
    doubled = F.ceil(F.log2(F.greatest(expected * ROOM / (TABLES * FIRST_SIZE), F.lit(1.0))))
    return (F.lit(FIRST_SIZE) * F.pow(F.lit(2.0), doubled)).cast("int")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row of `docs`.

    The likeness of two texts is the share of their distinct paragraph pieces that both have, from the difference that
    peeling recovers; 1 where neither has a piece. The next document follows in order of ids (null first),
    then of a hash of the text; repeated rows are one document and give equal rows. Null texts are empty. Very long
    texts are one row, cut and hashed whole. A single document is its own next one. An empty table gives no rows. Other
    columns are ignored. Two texts of one id with the same length and 64-bit hash count as repeated.
    """
    versions = versions_of(docs, id_col, text_col, piece)
    edited, following = F.lit(0), F.lit(1)
    own = F.array(
        F.struct(edited.alias("kind"), F.lit(1).alias("sign"), F.col("own").alias("digests")),
        F.struct(edited.alias("kind"), F.lit(-1).alias("sign"), F.col("edited").alias("digests")),
        F.struct(following.alias("kind"), F.lit(1).alias("sign"), F.col("own").alias("digests")),
    )
    sides = versions.select(F.col("pos").alias("pair"), F.explode(own).alias("s")).select("pair", "s.*").unionByName(
        versions.select(F.col("before").alias("pair"), following.alias("kind"), F.lit(-1).alias("sign"), F.col("own").alias("digests"))
    )
    n_own = F.size("own")
    # an edit leaves about half of a text; of the next text only the length is known here
    guesses = F.array(
        F.struct(edited.alias("kind"), _first_size((n_own + F.size("edited")) / 2).alias("size")),
        F.struct(following.alias("kind"), _first_size(n_own + F.col("next_n") / piece).alias("size")),
    )
    sizes = versions.select(F.col("pos").alias("pair"), F.explode(guesses).alias("s")).select("pair", "s.*")
    near = differences(sides, sizes)
    near = near.groupBy("pair").agg(*[F.max(F.when(F.col("kind") == k, F.struct("a_only", "b_only"))).alias(f"d{k}") for k in (0, 1)])
    shown = fingerprint_strings(versions, {"own": "fingerprint", "edited": "edited_fingerprint"}).withColumnRenamed("pos", "shown")
    rows = versions.select("doc_id", "copies", "pos", "n", "edited_sha256", n_own.cast("long").alias("n_own"))
    rows = rows.join(near, F.col("pos") == F.col("pair"), "left").join(shown, F.col("pos") == F.col("shown"))

    def likeness(d: str) -> Column:
        only_a, only_b = (F.coalesce(F.col(d)[c], F.lit(0)) for c in ("a_only", "b_only"))
        every = F.col("n_own") + only_b
        return F.when(every == 0, F.lit(1.0)).otherwise((F.col("n_own") - only_a) / every)

    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("d0").alias("near_edited"), likeness("d1").alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")
