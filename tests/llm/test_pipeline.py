"""The pipeline against brute force, and the entry without the subpackage."""

import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from sluice.llm.pieces import load_pieces
from test_decontaminate import windows, words
from test_jaccard import brute as components
from test_quality import brute as judged
from test_repeats import marks

ROOT = Path(__file__).resolve().parent.parent.parent


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randrange(2, 9)))
    return lambda n: " ".join(word() for _ in range(n))


def fixture():
    some = passages(11)
    benchmark = [(1, some(30)), (2, some(14)), (3, some(6)), (4, None)]
    shared = some(120)
    rows = [(i, some(80 + 7 * i)) for i in range(25)]
    rows += [(100 + i, some(60) + "\n" + shared + "\n" + some(60)) for i in range(4)]
    rows += [(200 + i, some(70) + " " + b + " " + some(70)) for i, (_, b) in enumerate(benchmark[:3])]
    copy = some(200)
    rows += [(300, copy), (301, copy), (302, copy + " and more"), (303, " ".join(["junk line with words"] * 40)), (304, "short"), (305, None), (306, "")]
    rows += [(307, " ".join(w + "###" for w in some(100).split())), (400, some(300)), (400, None)]
    rows.append(rows[0])
    return rows, benchmark


def brute(rows, benchmark):
    rows = [r for r in rows if judged(*r)[-1]]
    least = {(k, t): None for k, t in rows}
    pairs = list(least)
    for k, t in pairs:
        alone = components(pairs)
        least[k, t] = {c[0]: c[2] for c in alone}[k]
    rows = [p for p in pairs if p[0] == least[p]]
    out = []
    for (key, text), mark in zip(rows, marks([t.encode() for _, t in rows], 400)):
        raw = bytes(b for b, m in zip(text.encode(), mark) if not m)
        out.append((key, raw.decode()))
    wins = {w for _, b in benchmark for w in windows(b)}
    for i, (key, text) in enumerate(out):
        places = [m.span() for m in re.finditer(r"[a-z0-9]+", text)]
        w, hit = words(text), set()
        for size in {len(x) for x in wins}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in wins:
                    hit |= set(range(at, at + size))
        kept, behind = "", 0
        for at in sorted(hit):
            if at - 1 not in hit:
                kept += text[behind : places[at][0]]
            behind = places[at][1]
        out[i] = (key, kept + text[behind:])
    return out


def test_equal_to_brute_force(spark, tmp_path):
    rows, benchmark = fixture()
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = brute(rows, benchmark)
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(expected)
    surface = load_pieces().surface
    for r in found:
        assert b"".join(surface[i] for i in r["piece_ids"]).decode() == r["text"] and r["lossless"] and r["n_chars"] == len(r["text"])
    assert {k for k, _ in rows} - {k for k, _ in expected} >= {301, 302, 303, 304, 305, 306, 307}


def test_stages_keep_the_columns(spark, tmp_path, documents, odd):
    spark.createDataFrame([(1, "benchmark words")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents(odd), documents([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns
            assert after.count() <= docs.count()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(last) == docs.count() and all(r["lossless"] for r in last)


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_the_whole_run_over_an_empty_table(spark, tmp_path, empty):
    some = passages(3)
    rows = [] if empty == "documents" else [(1, some(80), "en", "s", 1), (2, some(90), None, None, None)]
    items = [] if empty == "benchmark" else [(1, some(30))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted(r[:2] for r in rows) and all(r["lossless"] for r in found)


def test_entry_works_without_the_subpackage():
    script = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "sluice.llm") or name.startswith("sluice.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 300 and not any(q.startswith("op") and q[2].isdigit() for q in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", script], cwd=ROOT, check=True)


def test_entry_lists_the_dealt_queries():
    import __spark_entry__ as e

    names = e.queries()
    assert [sum(bool(re.match(rf"op{n}_", q)) for q in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names


def test_rows_of_one_id_are_judged_apart(spark, documents):
    some = passages(5)
    a, b, c = some(80), some(90), some(100)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c + " more"), (3, c), (None, a), (2, None), (4, b)]
    kept = corpus_pipeline.jaccard_join(spark, documents(rows).repartition(3), "").collect()
    found = Counter((r["doc_id"], r["text"]) for r in kept)
    for k, texts in ((1, {a}), (2, {b}), (3, {c, c + " more"})):
        assert sum(n for (i, t), n in found.items() if i == k and t in texts) == 1
    assert found[None, a] == 1 and found[2, None] == 1
    assert sum(found.values()) == 5


def test_only_likely_copies_are_joined(spark, documents):
    some = passages(6)
    rows = [(i, some(60)) for i in range(40)]
    rows.append((50, rows[0][1]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.jaccard_join(spark, documents(rows), "")
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(rows[:40])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joined = plan[plan.index("Join LeftAnti") :]
    assert "Union" in plan and re.search(r"Filter \w*pythonUDF|ArrowEvalPython", joined)


def test_passages_of_over_50_words_are_cut(spark, documents):
    some = passages(9)
    short, under = " ".join(w[:4] for w in some(51).split()), some(50)
    rows = [(i, some(60) + "\n" + short + "\n" + some(60)) for i in range(3)] + [(10 + i, some(60) + "\n" + under + "\n" + some(60)) for i in range(3)]
    assert len(short) < 400 and len(under) < 400
    cut = corpus_pipeline.suffix_array_dedup(spark, documents(rows), "").collect()
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in cut) == Counter((k, t.replace(short, ""), len(t.replace(short, ""))) for k, t in rows)
