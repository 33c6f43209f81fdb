"""Language identification by Bayesian evidence fusion.

P(language | page) is proportional to
    P(text | language) ** temper * P(declared markup language | language) * P(language | host).

* Text: byte trigrams of the visible article text, under one multinomial per
  language with add-half smoothing over 65,536 hashed trigrams.  It is fitted
  to a hashed sample of about ``per_language`` labelled documents of each
  language (default 400).  Letters of a text hang together, so its
  log-likelihood is tempered: divided by 1 + trigrams / 50.
* Markup: how often each declared language goes with each language, counted
  over all pages with the text's probabilities as weights, smoothed towards
  the declaration being right in ``trust`` of the pages.
* Host: languages of the host's other pages, smoothed towards those of its
  address suffix (last label), which are smoothed towards those of all pages.
  All are sums of the text's probabilities from one grouped aggregation; the
  page's own share is taken out.

Pages whose text is empty are judged by markup and address alone; an address
or markup that is missing (null, malformed) forms a group of its own.
Repeated rows are pages of their own.  Without labelled documents the language
is null; an empty table gives an empty result.  Of equally probable languages
the first in the alphabet is given.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import key_type, saved

BUCKETS = 1 << 16
PER_LANGUAGE, TEMPER, TRUST = 400, 50.0, 0.9
HOST_WEIGHT, SUFFIX_WEIGHT, MARKUP_WEIGHT = 5.0, 20.0, 20.0

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|nav|header|footer|aside|noscript|template)\b.*?</\1\s*>|<div class=\"ad\">.*?</div>", re.S | re.I)
_TITLE = re.compile(r"<title\b.*?</title\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"\s+")


def visible_text(page: str | None) -> str:
    """The article text: no comments, scripts, styles, menus, advertisements, footers or tags."""
    if not page:
        return ""
    kept = _TITLE.sub(" ", _HIDDEN.sub(" ", page))
    return _SPACE.sub(" ", entities.unescape(_TAG.sub(" ", kept))).strip()


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a lower-cased text with a space on either side."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def fit_text(docs: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages and the log-probability of every hashed trigram in each."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("body"), F.col(lang).alias("lang"))
    sizes = labelled.groupBy("lang").count()
    chance = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")).alias("chance"))
    spread = (F.pmod(F.xxhash64(F.lit("lang"), "key"), F.lit(1_000_003)) / 1_000_003.0)
    sample = labelled.join(F.broadcast(chance), "lang").filter(spread < F.col("chance")).select("lang", "body")  # one row per language

    def count(batches):
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = seen.setdefault(name, np.zeros(BUCKETS, np.int64))
                total += np.bincount(trigrams(body), minlength=BUCKETS)
            for name, total in seen.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.int32()), pa.array(total[some])], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows per language at most
    names = sorted(set(counted.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(names)}
    table = np.full((len(names), BUCKETS), 0.5)
    table[[number[x] for x in counted.column("lang").to_pylist()], counted.column("bucket").to_numpy()] += counted.column("n").to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True)) if names else table


def text_log_likelihoods(text: str, table: np.ndarray) -> np.ndarray:
    """Tempered, with the best language at 0."""
    if not text:
        return np.zeros(len(table))
    found = trigrams(text)
    total = table[:, found].sum(axis=1) / (1 + len(found) / TEMPER)
    return total - total.max()


def evidence(pages: DataFrame, names: list[str], table: np.ndarray, key: str, url: str, markup: str) -> DataFrame:
    """key, host, suffix, declared, loglik (of the text per language), post (the text's probabilities)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(markup), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"), declared.alias("declared"), F.col(markup).alias("page"))
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def read(batches):
        model = shared.value
        for batch in batches:
            logs = [text_log_likelihoods(visible_text(p), model) for p in batch.column(4).to_pylist()]
            grid = np.array(logs).reshape(len(logs), len(model))
            post = np.exp(grid)
            post /= post.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *(pa.array(list(x), pa.list_(pa.float64())) for x in (grid, post))], names=["key", "host", "suffix", "declared", "loglik", "post"]
            )

    kind = key_type(rows).simpleString()
    return saved(rows.mapInArrow(read, f"key {kind}, host string, suffix string, declared string, loglik array<double>, post array<double>"), "evidence")


def sums(names: list[str], *group: str):
    def of(frame: DataFrame) -> DataFrame:
        return frame.groupBy(*group).agg(F.array(*[F.sum(F.element_at("post", i + 1)) for i in range(len(names))]).alias("post"))

    return of


def smoothed(counts: Column, prior: Column, weight: float) -> Column:
    """(counts + weight * prior) / (total + weight), per language."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + F.lit(weight)
    return F.zip_with(counts, prior, lambda c, p: (c + F.lit(weight) * p) / total)


def identify(
    pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html", doc_key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE
) -> DataFrame:
    """One row per row of ``pages``: key, host, declared (null: none), text_lang, lang, confidence."""
    names, table = fit_text(docs, per_language, doc_key, text, lang)
    n = len(names)
    if not n:
        none = F.lit(None).cast("string")
        return pages.select(F.col(key).alias(key), none.alias("host"), none.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    rows = evidence(pages, names, table, key, url, markup)
    cube = saved(sums(names, "host", "suffix", "declared")(rows), "cube")
    languages = F.array(*[F.lit(x) for x in names])
    everything = cube.agg(F.array(*[F.sum(F.element_at("post", i + 1)) for i in range(n)]).alias("post"), F.count_distinct("declared").alias("kinds")).first()
    post = np.array(everything["post"] or [0.0] * n, float)  # one number per language
    overall = F.array(*[F.lit(float(x)) for x in (post + 1) / (post.sum() + n)])
    suffixes = sums(names, "suffix")(cube).select("suffix", smoothed(F.col("post"), overall, SUFFIX_WEIGHT).alias("p_suffix"))
    hosts = sums(names, "host", "suffix")(cube).join(suffixes, "suffix").select("host", F.col("post").alias("host_post"), "p_suffix")
    # P(declared | language): towards ``trust`` for the language's own name, the rest even over what else is declared
    rest = (1 - TRUST) / max(everything["kinds"] - 1, 1)
    expected = F.transform(languages, lambda x: F.when(x == F.col("declared"), F.lit(TRUST)).otherwise(F.lit(rest)))
    totals = F.array(*[F.lit(float(x + MARKUP_WEIGHT)) for x in post])
    weighed = F.zip_with(F.zip_with("post", expected, lambda c, e: c + F.lit(MARKUP_WEIGHT) * e), totals, lambda c, t: c / t)
    declared = sums(names, "declared")(cube).select("declared", F.when(F.col("declared") == "", F.array_repeat(F.lit(1.0), n)).otherwise(weighed).alias("p_declared"))
    joined = rows.join(hosts, "host").join(declared, "declared")
    others = F.zip_with("host_post", "post", lambda h, p: F.greatest(h - p, F.lit(0.0)))
    prior = smoothed(others, F.col("p_suffix"), HOST_WEIGHT)
    fused = joined.select("*", prior.alias("prior")).select(
        "*", F.zip_with(F.zip_with("loglik", "prior", lambda x, p: x + F.log(p)), "p_declared", lambda x, d: x + F.log(d)).alias("logs")
    )
    top = F.array_max("logs")
    weight = F.transform("logs", lambda x: F.exp(x - top))
    return fused.select(
        F.col("key").alias(key), F.col("host"), F.nullif("declared", F.lit("")).alias("declared"),
        F.element_at(languages, F.array_position("post", F.array_max("post")).cast("int")).alias("text_lang"),
        F.element_at(languages, F.array_position("logs", top).cast("int")).alias("lang"),
        (F.lit(1.0) / F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)).alias("confidence"),
    )
