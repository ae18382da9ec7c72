"""Queries of this subpackage for the driver, each an operator with production settings on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chat, decontaminate, exactdedup, licenses, packing, pii, quality, repair, repetition, simhash, tokencount, toxicity, trie
from textloom.runtime import table


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files lie on every machine; other files can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS v(conv_id, turn, role, text)")
    return chat.chat_digests(rows.unionByName(fixed))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat", "n_repeats")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_reports(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), trie.hundreds)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_chat_formatting, op3_token_counts, op4_simhash_near_dedup, op5_exact_dedup, op6_license_scan, op7_quality_classifier, op8_pii, op9_toxicity, op10_decontamination, op11_quality_rules, op12_structure_repair, op13_prefix_trie, pipeline)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _crc32_sql(text: str) -> str:
    """The unsigned CRC of an ASCII text, bit by bit."""
    bits = f"list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])"
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten({bits}), lambda a, x: {step}), 4294967295)"


ORACLES: dict[str, str] = {
    "op2_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
                replace(text, '\', '\\') AS d
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        ), n AS (
            SELECT *, length(d) + (SELECT coalesce(sum(len(regexp_extract_all(d, m))), 0) FROM
                (VALUES ('<s>'), ('</s>'), ('\[INST\]'), ('\[/INST\]'), ('<<SYS>>'), ('<</SYS>>'), ('<ans>'), ('\[ROLE\]'), ('\[TEXT\]'), ('\[/ROLE\]')) v(m)) AS body,
                CASE WHEN before IS NULL THEN role IN ('system', 'user')
                     WHEN role = 'user' THEN before IN ('system', 'assistant')
                     WHEN role = 'assistant' THEN before = 'user' ELSE false END AS ok
            FROM e
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(body + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 18 WHEN 'assistant' THEN 11 ELSE 19 + length(replace(role, '\', '\\')) END) AS BIGINT) AS formatted_chars,
            bool_and(ok) AND bool_or(role = 'assistant' AND after IS NULL) AS valid
        FROM n GROUP BY conv_id""",
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_license_scan": licenses.oracle_sql(licenses.catalogue(), _words_sql("text")),
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
        b AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
        wins AS (
            SELECT DISTINCT item_id, len(win) AS k, array_to_string(win, ' ') AS win
            FROM (SELECT item_id, w[i:i + 12] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0))
        ),
        grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
        hit AS (SELECT doc_id, i, grams.k AS k, item_id FROM grams JOIN wins USING (win) WHERE grams.k = wins.k),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_quality_rules": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS u, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT u, k, i, md5(array_to_string(w[i:i + k - 1], ' ')) AS h FROM (SELECT u, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (3), (8), (201)) v(k) WHERE len(w) >= k)),
        r AS (SELECT u, k, i FROM g QUALIFY count(*) OVER (PARTITION BY u, k, h) > 1),
        c AS (SELECT u, count(DISTINCT p) FILTER (WHERE k = 3) AS three, count(DISTINCT p) FILTER (WHERE k = 8) AS eight, count(*) FILTER (WHERE k = 201) AS long
              FROM (SELECT u, k, unnest(range(i, i + k)) AS p FROM r) GROUP BY u),
        l AS (SELECT u, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        n AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(three, 0) AS n_repeat_words, coalesce(eight, 0) AS n_covered_words, coalesce(long, 0) AS long
            FROM d JOIN l USING (u) LEFT JOIN c USING (u)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= 30 * n_words AND long = 0 AS kept, n_covered_words
        FROM n""",
    "op12_structure_repair": rf"""
        WITH RECURSIVE k AS (SELECT *, {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind, row_number() OVER () AS u FROM conversations),
        d AS (
            SELECT conv_id, turn, u, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
            FROM k
        ),
        o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, u, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_one
              FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, u, copy)),
        f AS (SELECT *, CASE WHEN last_one = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last_one NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  before IS NOT NULL AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
        -- edits by state of the order (0 nothing, 1 system, 2 user, 3 assistant): a row's own edits, after one, two or no inserted turns before it
        ins AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:' || chr(10)), (1, 2, 2, 'I', 'user:' || chr(10)), (2, 3, 2, 'I', 'assistant:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)),
                (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))) v(q, q2, cost, edits, lines)),
        paths AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS edits, '' AS lines FROM c
            UNION ALL
            SELECT conv_id, i, q, cost, edits, lines FROM (
                SELECT p.conv_id, p.i + 1 AS i, e.q, p.cost + s.cost + e.cost AS cost, p.edits || s.edits || e.edit AS edits, p.lines || s.lines || CASE e.edit WHEN 'D' THEN '' ELSE e.role || ':' || f.text || chr(10) END AS lines
                FROM paths p JOIN ins s ON p.q = s.q JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1,
                LATERAL (
                    SELECT 'D' AS edit, s.q2 AS q, 3 AS cost, '' AS role
                    UNION ALL SELECT 'K', CASE WHEN substr(f.role, 1, 1) = 's' THEN 1 WHEN substr(f.role, 1, 1) = 'u' THEN 2 ELSE 3 END, CAST(f.fault = 'truncated' AS INT), f.role
                        WHERE f.fault NOT IN ('blank', 'duplicate') AND (substr(f.role, 1, 1) = 's' AND s.q2 = 0 OR substr(f.role, 1, 1) = 'u' AND s.q2 <> 2 OR substr(f.role, 1, 1) = 'a' AND s.q2 = 2)
                    UNION ALL SELECT 'R', CASE s.q2 WHEN 2 THEN 3 ELSE 2 END, 2 + CAST(f.fault = 'truncated' AS INT), CASE s.q2 WHEN 2 THEN 'assistant' ELSE 'user' END
                        WHERE f.fault NOT IN ('blank', 'duplicate')
                ) e
            ) QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, edits) = 1
        ),
        ends AS (
            SELECT c.conv_id, p.cost + s.cost AS cost, p.edits || s.edits AS edits, p.lines || s.lines AS lines
            FROM c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n JOIN ins s ON p.q = s.q WHERE s.q2 IN (0, 3)
            QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY p.cost + s.cost, p.edits || s.edits) = 1
        )
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(edits, '') AS audit, sha256(CASE WHEN coalesce(lines, '') = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op13_prefix_trie": rf"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS r, role, text FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
        c AS (SELECT conv_id, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h, count(*) AS n FROM t GROUP BY conv_id),
        b AS (
            SELECT c.conv_id, 0 AS own, t.r, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.r < c.h
            UNION ALL SELECT c.conv_id, 1, t.r, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.r >= c.h
        ),
        s AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS node
              FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, r)),
        p AS (SELECT conv_id, depth, chars, node, lag(node) OVER w AS up, lead(depth) OVER w IS NULL AS ends FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
        e AS (SELECT conv_id, depth, chars, node, coalesce(up, 'root') AS up, ends FROM p UNION ALL SELECT conv_id, 0, 0, 'root', NULL, conv_id NOT IN (SELECT conv_id FROM s) FROM c),
        n AS (SELECT node, min(up) AS up, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM e GROUP BY node),
        k AS (SELECT up AS node, count(*) AS n_children FROM n GROUP BY up),
        -- a node's own figures count once, for its first member: a subtree is what lies at or below it in its members' own columns
        x AS (SELECT e.conv_id, e.depth, e.node, CASE WHEN n.conv_id = e.conv_id THEN n.saved ELSE 0 END AS saved, CASE WHEN n.conv_id = e.conv_id AND k.node IS NULL THEN 1 ELSE 0 END AS leaf FROM e JOIN n USING (node) LEFT JOIN k USING (node)),
        y AS (SELECT node, sum(saved) OVER w AS saved, sum(leaf) OVER w AS leaf FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY depth DESC)),
        z AS (SELECT node, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM y GROUP BY node)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, z.n_leaves, z.saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
        FROM n JOIN z USING (node) LEFT JOIN k USING (node) LEFT JOIN n u ON n.up = u.node""",
}
