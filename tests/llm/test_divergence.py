import math
import re
from collections import Counter

from conftest_llm import SF, needs_tables, words
from pyspark.sql import functions as F

from hazeflow.llm import divergence, queries


def base(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {k for i, x in enumerate(windows) if often[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def shannon(p, q):
    def part(x, y):
        return x * math.log2(2 * x / (x + y)) if x > 0 else 0.0

    return math.sqrt(max(sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2, 0))


def classes(text):
    outside = [r"[^A-Z]", r"[^0-9]", r"[^.,;:!?'\"()\[\]{}`-]", r"[^#*$%&|<>]", "[^\x20\x09-\x0d]"]
    counts = [len(re.sub(x, "", text)) for x in outside]
    size = len(text.encode())
    counts += [size - len(text), len(text) - sum(counts)]
    return [c / size for c in counts]


def plain(rows, n=32):
    """Every column, from whole texts, by language."""
    out = {}
    for lang in {r[2] for r in rows}:
        mine = [(i, t or "") for i, t, x in rows if x == lang]
        count = Counter(w for _, t in mine for w in words(t))
        top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))[:n]]
        total = sum(count.values())
        shares = [count[w] / total for w in top]
        shares.append(1 - sum(shares))
        long = [classes(t) for _, t in mine if len(t) >= 200]
        typical = [sum(c[k] for c in long) / len(long) for k in range(7)] if long else None
        for i, t in mine:
            w = words(t)
            own = Counter(w)
            near = shannon([own[x] / len(w) for x in top] + [sum(c for x, c in own.items() if x not in top) / len(w)], shares) if len(w) >= 50 else None
            out[i] = (*base(t), shannon(classes(t), typical) if len(t) >= 200 else None, near)
    return out


def compared(found, rows):
    expected = plain(rows)
    assert len(found) == len(rows)
    for r in found:
        e = expected[r.doc_id]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == e[:6]
        for got, want in ((r.class_distance, e[6]), (r.word_distance, e[7])):
            assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-6)
        assert r.kept == (not e[5] and (e[6] or 0) <= divergence.MAX_CLASS_DISTANCE and (e[7] or 0) <= divergence.MAX_WORD_DISTANCE)


@needs_tables
def test_query_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    found = divergence.judged(docs).collect()
    compared(found, rows)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    query = queries.all_queries()["op6_distribution_divergence"](spark, SF)
    assert query.columns == names and sorted(tuple(r) for r in query.collect()) == sorted(tuple(r[c] for c in names) for r in found)


def test_clean_documents_stay_and_junk_goes(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    found = divergence.judged(queries.table(spark, sf, "documents")).toPandas().merge(queries.table(spark, sf, "labels").toPandas(), on="doc_id")
    found = found[~found.base_failed]
    assert found.kept[found.quality == 1].mean() >= 0.99 and found.kept[found.quality == 0].mean() <= 0.1


def test_odd_rows(spark):
    draw = [" ".join(f"w{i * k % 61}" for i in range(300)) for k in (7, 11, 13)]
    texts = [None, "", " \t\n", "a b c " * 40, "a b c\n" * 3 + "\n\n x \n x ", "#*$%&|<> " * 60, "x" * 50_000, "é ü ñ " * 70, *draw, "ab " * 20_000]
    texts.append(" ".join(f"u{i % 900}" for i in range(2000)))  # more repeated windows than are looked up one by one
    rows = [(i, t, None if i % 4 == 0 else "en") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, words int, counts string, language int"
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], schema).repartition(3)
    compared(divergence.judged(df).collect(), rows)
    assert divergence.judged(df.unionByName(df)).count() == 2 * len(rows)
    nameless = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert divergence.judged(nameless).count() == len(rows)
    assert divergence.judged(df.limit(0)).count() == 0


def test_no_python_on_the_path(spark):
    plan = divergence.judged(queries.table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
