"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a cheap or dear expression that is true for rows to reject.  On a
hashed sample of the rows each rule's cost (seconds of evaluating it alone)
and selectivity (share of rows it rejects) are measured; the rules then stand
in one CASE in descending order of rejections per second, so a row pays for
rules up to the first that rejects it.  The order changes the cost, never the
verdict.

Words are the maximal runs without ASCII white space; null and empty texts
have none and fail ``few_words``.  Ties in the order go by the rules' given
order.  Repeated rows are judged alike; an empty table gives an empty result
and keeps the given order.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.semantics import bind

_SPACE = r"[ \t-\r]+"
#: Rows of the sample on which rules are measured, on average.
SAMPLE_ROWS = 2000
FEW_WORDS, REPEAT_PERCENT, SYMBOLS_PER_WORD, WORD_LENGTHS, DUP_LINE_PERCENT = 50, 50, 0.1, (2, 15), 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def word_chars(words: Column) -> Column:
    return F.length(F.concat_ws("", words)).cast("long")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]+", "")).cast("long")


def full_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^ \t-\r]"))


def dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of the hashes of their words, sorted with their
    places so that equal ones are neighbours; no step is quadratic in the text.
    """

    def windows(h: Column) -> Column:
        inner = F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))
        return F.sort_array(F.transform(inner, lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("g"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, j: (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"])
        return F.sort_array(F.transform(F.filter(s, same_or_false(same)), lambda x: x["i"]))

    def same_or_false(condition):
        return lambda x, j: F.coalesce(condition(x, j), F.lit(False))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, r: total + r)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return bind(bind(bind(hashed, windows), repeated), covered)


def standard_rules(n_words: Column, chars: Column, n_symbols: Column, n_dup_lines: Column, n_lines: Column, n_repeat: Column) -> dict[str, Column]:
    """Conditions to reject a text, over counts or over the expressions that compute them."""
    low, high = WORD_LENGTHS
    return {
        "few_words": n_words < FEW_WORDS,
        "symbols": n_symbols > SYMBOLS_PER_WORD * n_words,
        "word_length": (chars < low * n_words) | (chars > high * n_words),
        "dup_lines": 100 * n_dup_lines > DUP_LINE_PERCENT * n_lines,
        "repeats": 100 * n_repeat > REPEAT_PERCENT * n_words,
    }


def hashed_sample(docs: DataFrame, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the key."""
    every = max(1, docs.count() // rows)
    return docs.filter(F.pmod(F.xxhash64(F.lit("quality"), F.col(key)), F.lit(every)) == 0)


def measure(sample: DataFrame, rules: Mapping[str, Column]) -> dict[str, tuple[float, float]]:
    """Each rule's seconds on the sample, alone and beyond reading it, and its share of rejected rows."""
    sample = sample.persist()
    try:
        total = sample.count()
        if not total:
            return {name: (1.0, 0.0) for name in rules}
        rejected = sample.agg(*[F.count_if(r).alias(name) for name, r in rules.items()]).first()

        def seconds(columns: list[Column]) -> float:
            start = time.perf_counter()
            sample.select(*columns).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        alone = min(seconds([F.lit(1)]) for _ in range(2))
        return {name: (max(seconds([r]) - alone, 1e-4), rejected[name] / total) for name, r in rules.items()}
    finally:
        sample.unpersist()


def cascade_order(measured: Mapping[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per second, most first."""
    names = list(measured)
    return sorted(names, key=lambda r: (-measured[r][1] / measured[r][0], names.index(r)))


def first_rejection(rules: Mapping[str, Column], order: list[str]) -> Column:
    """The first rule in the order that rejects the row, else null; later rules are not evaluated."""
    chain = F
    for name in order:
        chain = chain.when(rules[name], F.lit(name))
    return chain


def text_rules(text: str = "text", words: str = "words_") -> dict[str, Column]:
    """The standard rules over a text and a column of its words, each computing what it needs."""
    t, w = F.col(text), F.col(words)
    n = F.size(w)
    lines = full_lines(t)
    return standard_rules(n, word_chars(w), symbols(t), bind(lines, dup_lines), F.size(lines), repeat_words(w))


def cascade(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The columns of ``docs`` as c0, c1 and so on, the words, and ``verdict``: the rule that ended the cascade (null: kept)."""
    names = docs.columns
    listed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[text].alias("text_"), words_of(docs[text]).alias("words_"))
    sample = hashed_sample(docs.select(docs[key].alias("key_"), docs[text].alias("text_")), "key_").select("text_", words_of(F.col("text_")).alias("words_"))
    rules = text_rules("text_")
    return listed.withColumn("verdict_", first_rejection(rules, cascade_order(measure(sample, rules))))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", verdict: str = "rejected_by") -> DataFrame:
    """All rows and columns of ``docs`` and the rule that rejects the row first (null: kept)."""
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != verdict]
    return cascade(docs, key, text).select(*named, F.col("verdict_").alias(verdict))


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    return cascade(docs, key, text).filter("verdict_ IS NULL").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def measured_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept."""
    listed = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"), words_of(F.col(text)).alias("words_"), full_lines(F.col(text)).alias("lines_"))
    counts = listed.select(
        F.col("key_").alias(key), F.size("words_").cast("long").alias("n_words"), word_chars(F.col("words_")).alias("word_chars"),
        symbols(F.col("text_")).alias("n_symbols"), F.size("lines_").cast("long").alias("n_lines"),
        dup_lines(F.col("lines_")).alias("n_dup_lines"), repeat_words(F.col("words_")).alias("n_repeat_words"),
    )
    sample = hashed_sample(docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")), "key_").select("text_", words_of(F.col("text_")).alias("words_"))
    order = cascade_order(measure(sample, text_rules("text_")))
    c = {name: F.col(name) for name in counts.columns}
    rules = standard_rules(c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_lines"], c["n_repeat_words"])
    base = rules["few_words"] | rules["repeats"]
    return counts.select(*counts.columns, base.alias("base_failed"), first_rejection(rules, order).isNull().alias("kept"))
