import re
from collections import Counter

import pytest
from compare import database, of_spark, of_sql
from pyspark.sql import functions as F

from sluice.llm import quality
from sluice.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def brute(key, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dups = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    kept = not (failed or 10 * symbols > n or chars < 2 * n or chars > 15 * n or 100 * dups > 50 * len(lines))
    return key, n, chars, symbols, len(lines), dups, len(covered), failed, kept


TEXTS = [
    (20, "a b c a b c a b"), (21, "same same same same"), (22, "one\none\n one\n\n\t\none"), (23, " ".join(f"w{i}" for i in range(60))),
    (24, " ".join(f"w{i % 25}" for i in range(60))), (25, " ".join(f"w{i}#" for i in range(60))), (26, " ".join("x" * 40 for _ in range(3)) + " é" * 70),
    (27, "\n".join(f"line {i // 4} of the text with words" for i in range(40))), (28, "a b c x y a b c a b"),
]


def test_counts_equal_brute_force(spark, documents, odd):
    rows = TEXTS + odd
    found = Counter(tuple(r) for r in quality.measured_text(documents(rows)).collect())
    assert found == Counter(brute(*r) for r in rows)


def test_query_equals_sql(spark):
    assert of_spark(QUERIES["op4_quality_rules"](spark, FOLDER)) == of_sql(database(FOLDER), SQL["op4_quality_rules"])


def test_kept_rows_are_those_of_the_query(spark, documents, odd):
    rows = TEXTS + odd
    docs = documents(rows)
    stayed = quality.kept(docs)
    assert stayed.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in stayed.collect()) == Counter(r for r in rows if brute(*r)[-1])
    named = quality.judged(docs).collect()
    assert all((r["rejected_by"] is None) == brute(r["doc_id"], r["text"])[-1] for r in named)


def test_order_is_by_rejections_per_second():
    measured = {"dear": (4.0, 0.8), "cheap": (0.1, 0.1), "useless": (0.1, 0.0), "tie": (0.2, 0.2)}
    assert quality.cascade_order(measured) == ["cheap", "tie", "dear", "useless"]


def test_later_rules_are_not_evaluated(spark, documents):
    fails = F.raise_error(F.lit("evaluated")).cast("boolean")
    rules = {"first": F.col("doc_id") > 0, "second": fails}
    df = documents([(1, "a"), (2, "b")])
    assert [r[0] for r in df.select(quality.first_rejection(rules, ["first", "second"])).collect()] == ["first", "first"]
    with pytest.raises(Exception, match="evaluated"):
        df.select(quality.first_rejection(rules, ["second", "first"])).collect()


def test_measures_and_empty_tables(spark, documents):
    rules = {"all": F.col("doc_id") > 0, "half": F.col("doc_id") > 2}
    measured = quality.measure(documents([(i, "t") for i in range(1, 5)]), rules)
    assert measured["all"][1] == 1 and measured["half"][1] == 0.5 and min(s for s, _ in measured.values()) > 0
    empty = documents([])
    assert quality.measured_text(empty).collect() == [] and quality.kept(empty).collect() == []


def test_plan_has_no_python(spark):
    plan = QUERIES["op4_quality_rules"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
