"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes, and its histogram over its language's commonest words, are
compared with the language's references by Jensen-Shannon distance. References are statistics of all
documents: word counts over all words, and the mean class histogram of all long enough documents. A document
too short for a histogram is not judged by it.

Word counting is aggregated map-side; only distinct words per language are shuffled. Texts never are: the
references, a few rows per language, are joined to them, broadcast behind a check of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazeflow.llm.frames import col
from hazeflow.scratch import materialize

COMMON_WORDS = 32
MIN_WORDS, MIN_CHARS = 50, 200
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.45
BROADCAST_LANGUAGES = 10_000
FEW_REPEATS = 32  # up to it windows are looked up in the list of repeated ones, beyond it they are sorted

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
# Characters outside a class; what is left when they go is counted.
NOT_IN_CLASS = {
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "mark": r"[^.,;:!?'\"()\[\]{}`-]+",
    "symbol": r"[^#*$%&|<>]+",
    "space": r"[^\x20\x09-\x0D]+",
}
SYMBOL, WHITE = 3, 4
CLASSES = len(NOT_IN_CLASS) + 2  # and bytes beyond a character's first, and all others


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once; a plain expression inside a lambda is evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _next(items: Column, i: Column, step: int = 1) -> Column:
    return F.get(items, i + step)


def _kept(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _covered(places: Column, size: int) -> Column:
    """Words in windows of `size` words at the ordered places."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(size), F.coalesce(_next(places, i) - p, F.lit(size))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)


def _places_by_lookup(windows: Column, again: Column) -> Column:
    return _kept(F.transform(windows, lambda h, i: F.when(F.array_contains(again, h), i)))


def _places_by_sort(windows: Column) -> Column:
    def twice(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == _next(pairs, j, -1)["h"], F.lit(False)) | F.coalesce(x["h"] == _next(pairs, j)["h"], F.lit(False))
        return F.sort_array(_kept(F.transform(pairs, lambda x, j: F.when(same(x, j), x["i"]))))

    return _let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)


def _repeated_words(windows: Column) -> Column:
    """Words in three-word windows that occur more than once, from the windows' keys."""
    zero = F.lit(0).cast("long")

    def of_ordered(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda h, i: h == _next(ordered, i)))

    def of_again(again: Column) -> Column:
        few = F.size(again) <= FEW_REPEATS
        places = F.when(few, _places_by_lookup(windows, again)).otherwise(_places_by_sort(windows))
        return F.when(F.size(again) == 0, zero).otherwise(_let(places, lambda p: _covered(p, 3)))

    return _let(_let(F.sort_array(windows), of_ordered), of_again)


def _window_keys(words: Column) -> Column:
    keys = F.transform(words, lambda w, i: F.xxhash64(w, _next(words, i), _next(words, i, 2)))
    return F.slice(keys, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))


def _class_counts(text: Column) -> Column:
    return F.array(*[F.length(F.regexp_replace(text, out, "")) for out in NOT_IN_CLASS.values()])


def _word_counts(text: Column, words: Column, counts: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(text) - F.get(counts, F.lit(WHITE))).cast("long"),
        "n_symbols": F.get(counts, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _let(_window_keys(words), _repeated_words),
    }


def class_histogram(text: Column, counts: Column) -> Column:
    """Shares of a text's bytes: the classes, bytes beyond a character's first, and all others."""
    named = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    every = F.concat(counts, F.array(F.octet_length(text) - F.length(text), F.length(text) - named))
    return F.transform(every, lambda x: x / F.octet_length(text))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (square root of the divergence in bits, 0 to 1) of two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2, F.lit(0.0)))


def common_words(docs: DataFrame, text: str, lang: str, n: int = COMMON_WORDS) -> DataFrame:
    """(language, common, shares): each language's n commonest words and their shares of all its words; ties by word.

    The last share is that of all other words.
    """
    words = docs.select(F.col(lang).alias("language"), F.explode(_words(F.col(text))).alias("word"))
    counted = materialize(words.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    totals = counted.groupBy(F.col("language").alias("l")).agg(F.sum("n").alias("total"))
    first = Window.partitionBy("language").orderBy(F.desc("n"), "word")
    top = counted.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
    listed = top.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    joined = listed.join(totals, F.col("language").eqNullSafe(F.col("l")))
    shares = F.transform("top", lambda t: t["n"] / F.col("total"))
    rest = 1 - F.aggregate(shares, F.lit(0.0), lambda a, s: a + s)
    return joined.select("language", F.col("top.word").alias("common"), F.concat(shares, F.array(rest)).alias("shares"))


def word_histogram(words: Column, common: Column) -> Column:
    """Shares of the common words, then of all others."""
    none = F.expr("cast(array() as array<int>)")

    def count(state: Column, word: Column) -> Column:
        left = F.array_remove(state["left"], word)
        both = lambda x: F.struct(x.alias("left"), F.concat(state["counts"], F.array(F.size(state["left"]) - F.size(x))).alias("counts"))
        return _let(left, both)

    found = F.filter(words, lambda w: F.array_contains(common, w))
    counts = F.aggregate(common, F.struct(found.alias("left"), none.alias("counts")), count, lambda s: s["counts"])

    def shares(c: Column) -> Column:
        rest = F.size(words) - F.aggregate(c, F.lit(0), lambda a, x: a + x)
        return F.transform(F.concat(c, F.array(rest)), lambda x: x / F.size(words))

    return _let(counts, shares)


def _with_reference(rows: DataFrame, reference: DataFrame) -> DataFrame:
    small = reference.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    return rows.join(F.broadcast(reference) if small else reference, F.col("lang").eqNullSafe(F.col("language")), "left")


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept).

    Words are runs without ASCII white space. A document fails the base rules with under 50 words, or with over
    half of its words in three-word windows that occur twice or more in it. It is kept if it passes them and
    neither distance exceeds its limit; a distance is null, and not judged, under 200 characters or 50 words.
    Null and empty texts have no words and fail. A null language is a language of its own; rows may repeat, ids
    may be null, an empty table gives none, and other columns are ignored.
    """
    slim = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), col(lang_col).cast("string").alias("lang"))
    reference = materialize(common_words(slim, "text", "lang"), "common")

    text = F.col("text")

    def counted(words: Column, counts: Column) -> Column:
        near = jensen_shannon(word_histogram(words, F.col("common")), F.col("shares"))
        spoken = F.when(F.size(words) >= MIN_WORDS, near)
        classes = F.when(F.length(text) >= MIN_CHARS, class_histogram(text, counts))
        columns = [c.alias(n) for n, c in _word_counts(text, words, counts).items()]
        return F.struct(*columns, spoken.alias("word_distance"), classes.alias("classes"))

    found = _let(_words(text), lambda words: _let(_class_counts(text), lambda counts: counted(words, counts)))
    rows = _with_reference(slim, reference).select("doc_id", "lang", found.alias("found")).select("doc_id", "lang", "found.*")
    rows = materialize(rows, "histograms")
    means = [F.avg(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(CLASSES)]
    typical = rows.groupBy(F.col("lang").alias("language")).agg(*means)
    typical = typical.select("language", F.array(*[F.col(f"c{i}") for i in range(len(means))]).alias("typical"))
    distance = F.when(F.col("classes").isNotNull(), jensen_shannon(F.col("classes"), F.col("typical")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    out = _with_reference(rows, typical).withColumns({"class_distance": distance, "base_failed": failed})
    out = out.withColumn("kept", ~F.col("base_failed") & fits)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"
    )
