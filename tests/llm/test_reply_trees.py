import itertools

from pyspark.sql import functions as F

from hazeflow.llm import reply_trees as R

SCHEMA = "conv_id long, node long, parent long, role string, text string, score double"
TREES = [
    (1, 1, None, "user", "root <| \\ \\n \\| <\\|", 1.0),
    (1, 2, 1, "assistant", "a\\<|im_end|>", 0.1),
    (1, 3, 1, "assistant", "b\n\n", 0.9),
    (1, 4, 3, "user", "", None),
    (1, 5, 4, "assi\nst\\ant", "z", 5.0),
    (1, 5, 4, "assi\nst\\ant", "z", 5.0),
    (2, 1, 9, None, None, None),
    (3, 1, 2, "x", "cycle", 1.0),
    (3, 2, 1, "x", "cycle", 1.0),
    (3, 3, 2, "x", "below a cycle", 1.0),
    (None, 7, None, "assistant", "n", 0.0),
    (4, None, None, "x", "no node", 0.0),
]


def told(trees, **options):
    rows = R.formatted_branches(trees, **options)
    rows = rows.withColumns({"turns": R.read_back(F.col("formatted")), "loss": R.loss_text(F.col("formatted"), F.col("loss_spans"))})
    return {(r.conv_id, r.leaf): (r["rank"], [tuple(t) for t in r.turns], r.loss) for r in rows.collect()}


def test_branches(spark):
    root = ("user", "root <| \\ \\n \\| <\\|")
    assert told(spark.createDataFrame(TREES, SCHEMA).repartition(3)) == {
        (1, 5): (1, [root, ("assistant", "b\n\n"), ("user", ""), ("assi\nst\\ant", "z")], "b\n\n"),
        (1, 2): (2, [root, ("assistant", "a\\<|im_end|>")], "a\\<|im_end|>"),
        (2, 1): (1, [("", "")], ""),
        (None, 7): (1, [("assistant", "n")], "n"),
    }


def test_best_branches_and_empty(spark):
    trees = spark.createDataFrame(TREES, SCHEMA)
    assert set(told(trees, branches=1)) == {(1, 5), (2, 1), (None, 7)}
    assert told(trees.limit(0)) == {}


def test_paths_equal_a_walk(spark):
    parents = {n: (n * 7919 % n if n % 11 else None) for n in range(1, 120)}
    parents |= {n: n - 1 for n in range(60, 120)}
    trees = spark.createDataFrame([(9, n, p, "user", "t", 0.0) for n, p in parents.items()], SCHEMA)
    expected = set()
    for leaf in set(parents) - set(parents.values()):
        at, distance = leaf, 0
        while at is not None and at in parents:
            expected.add((leaf, at, distance))
            at, distance = parents[at], distance + 1
    assert {(r.leaf, r.node, r.distance) for r in R.paths(trees).collect()} == expected


def test_escapes_are_reversible(spark):
    texts = ["".join(t) for n in range(6) for t in itertools.product("\\<|n\n", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    line, free = R.escaped(F.col("t"), in_line=True), R.escaped(F.col("t"))
    for r in df.select("t", line.alias("line"), R.unescaped(line).alias("a"), free.alias("free"), R.unescaped(free).alias("b")).collect():
        assert r.a == r.t == r.b and "<|" not in r.line + " " + r.free and "\n" not in r.line


def test_linear_rows(spark):
    rows = [(1, 2, "assistant", "late"), (1, None, "user", "first"), (1, 1, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 1, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {k: v[1] for k, v in told(R.turns_as_trees(turns)).items()} == {
        (1, 5): [("user", "first"), ("", "x"), ("", "x"), ("user", ""), ("assistant", "late")],
        (None, 1): [("user", "q")],
    }
