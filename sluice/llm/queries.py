"""The dealt queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import (
    conversations, decontaminate, filter_audit, jaccard, language, lm_scores, quality, repeats, sampled_pieces, shards, token_counts, topk, toxicity,
)
from sluice.llm.common import small_batches, table
from sluice.llm.pieces import load_pieces
from sluice.semantics import pin_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def pinned(spark: SparkSession, folder: str) -> DataFrame:
        return run(small_batches(pin_session(spark)), folder)

    QUERIES[run.__name__] = pinned
    return run


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), load_pieces())


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measured_text(table(spark, folder, "documents"))


SQL["op4_quality_rules"] = r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
        FROM documents
    ), wins AS (
        SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]})) AS x FROM d
    ), found AS (
        SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.g) AS c FROM wins
    ), covered AS (
        SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM found WHERE c >= 2) GROUP BY r
    ), counts AS (
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
               CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
        FROM d LEFT JOIN covered USING (r)
    )
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
                OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
    FROM counts
"""


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.component_ids(table(spark, folder, "documents"))


@query
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs, pieces = table(spark, folder, "documents").select("doc_id", "text"), load_pieces()
    decoded = sampled_pieces.decode_pieces(sampled_pieces.encode_sampled(docs, pieces), pieces)
    return decoded.select(
        "doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless")
    )


@query
def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    target = table(spark, folder, "labels").filter("quality = 1")
    return lm_scores.cross_entropy_difference(table(spark, folder, "documents"), target)


@query
def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removal_digest(table(spark, folder, "documents"))


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = shards.shuffle_into_shards(table(spark, folder, "documents"), shards=8)
    return dealt.select(
        "doc_id", shards.size_of(F.col("text")).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), "vec_id % 50 = 0", k=5)


SQL["op11_topk_search"] = """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
    )
    SELECT query_id, CAST(k AS INT) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s) WHERE k <= 5
"""


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.damaged(table(spark, folder, "conversations"))
    return conversations.audited(rows, F.col("here")).withColumnRenamed("conv", "conv_id")


SQL["op12_conversation_repair"] = r"""
    WITH RECURSIVE named AS (
        SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
    ), hits AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
            list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS hit
        FROM named
    ), copies AS (
        SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
               CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM hits
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
        FROM copies
    ), judged AS (
        SELECT *, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1 WHEN again THEN 2
                  WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 3 ELSE 0 END AS fault
        FROM placed
    ), ids AS (
        SELECT conv_id, coalesce(max(pos), 0) AS n, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
               count(*) FILTER (WHERE fault = 3) AS truncated, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM judged) j USING (conv_id) GROUP BY conv_id
    ), steps AS (
        SELECT conv_id, n AS pos, {'c': 0, 'a': '', 't': ''} AS s0, {'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s1,
               {'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'} AS su, {'c': 0, 'a': '', 't': ''} AS sa
        FROM ids
        UNION ALL
        SELECT conv_id, pos - 1,
            list_min([o0, {'c': ou.c + 5, 'a': 'I' || ou.a, 't': chr(10) || 'user:' || ou.t}, {'c': oa.c + 10, 'a': 'II' || oa.a, 't': chr(10) || 'user:' || chr(10) || 'assistant:' || oa.t}]),
            list_min([o1, {'c': ou.c + 5, 'a': 'I' || ou.a, 't': chr(10) || 'user:' || ou.t}, {'c': oa.c + 10, 'a': 'II' || oa.a, 't': chr(10) || 'user:' || chr(10) || 'assistant:' || oa.t}]),
            list_min([ou, {'c': oa.c + 5, 'a': 'I' || oa.a, 't': chr(10) || 'assistant:' || oa.t}]),
            list_min([oa, {'c': ou.c + 5, 'a': 'I' || ou.a, 't': chr(10) || 'user:' || ou.t}])
        FROM (
            SELECT s.conv_id, s.pos,
                list_min(list_filter([{'c': s0.c + 2, 'a': 'D' || s0.a, 't': s0.t},
                    CASE WHEN fault IN (0, 3) AND i = 's' THEN {'c': s1.c + e, 'a': 'K' || s1.a, 't': chr(10) || role || ':' || text || s1.t} END,
                    CASE WHEN fault IN (0, 3) AND i = 'u' THEN {'c': su.c + e, 'a': 'K' || su.a, 't': chr(10) || role || ':' || text || su.t} END,
                    CASE WHEN fault IN (0, 3) THEN {'c': su.c + e + 1, 'a': 'R' || su.a, 't': chr(10) || 'user:' || text || su.t} END], lambda x: x IS NOT NULL)) AS o0,
                list_min(list_filter([{'c': s1.c + 2, 'a': 'D' || s1.a, 't': s1.t},
                    CASE WHEN fault IN (0, 3) AND i = 'u' THEN {'c': su.c + e, 'a': 'K' || su.a, 't': chr(10) || role || ':' || text || su.t} END,
                    CASE WHEN fault IN (0, 3) THEN {'c': su.c + e + 1, 'a': 'R' || su.a, 't': chr(10) || 'user:' || text || su.t} END], lambda x: x IS NOT NULL)) AS o1,
                list_min(list_filter([{'c': su.c + 2, 'a': 'D' || su.a, 't': su.t},
                    CASE WHEN fault IN (0, 3) AND i = 'a' THEN {'c': sa.c + e, 'a': 'K' || sa.a, 't': chr(10) || role || ':' || text || sa.t} END,
                    CASE WHEN fault IN (0, 3) THEN {'c': sa.c + e + 1, 'a': 'R' || sa.a, 't': chr(10) || 'assistant:' || text || sa.t} END], lambda x: x IS NOT NULL)) AS ou,
                list_min(list_filter([{'c': sa.c + 2, 'a': 'D' || sa.a, 't': sa.t},
                    CASE WHEN fault IN (0, 3) AND i = 'u' THEN {'c': su.c + e, 'a': 'K' || su.a, 't': chr(10) || role || ':' || text || su.t} END,
                    CASE WHEN fault IN (0, 3) THEN {'c': su.c + e + 1, 'a': 'R' || su.a, 't': chr(10) || 'user:' || text || su.t} END], lambda x: x IS NOT NULL)) AS oa
            FROM (SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS e FROM judged) j JOIN steps s ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.pos = s.pos
        )
    )
    SELECT ids.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(s0.c AS BIGINT) AS cost, s0.a AS audit,
           sha256(substr(s0.t, 2)) AS repaired_sha256
    FROM ids JOIN steps ON ids.conv_id IS NOT DISTINCT FROM steps.conv_id AND steps.pos = 0
"""


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL["op13_filter_audit"] = r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents
    ), m AS (
        SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
               + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
               + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
        FROM d
    ), l AS (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
    ), cells AS (
        SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
    ), f AS (
        SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)
    ), o AS (
        SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
    ), s AS (
        SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS prior
        FROM o, (SELECT unnest(range(1, 6)) AS step)
    ), lines AS (
        SELECT part, filter_order, step, own,
               sum(CASE WHEN mask & CAST(own + prior AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN mask & own <> 0 AND mask & CAST(prior AS BIGINT) = 0 THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN mask & own <> 0 AND mask & CAST(prior AS BIGINT) <> 0 THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN mask & own <> 0 AND mask & CAST(prior AS BIGINT) = 0 THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN mask & own <> 0 AND mask & CAST(prior AS BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM cells, s GROUP BY part, filter_order, step, own
    )
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM lines
"""
