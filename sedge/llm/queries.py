"""The operators' queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sedge.llm import licences as licence_rules
from sedge.llm.bpe import bpe_digests
from sedge.llm.common import table
from sedge.llm.decontaminate import contaminated
from sedge.llm.exact_dedup import exact_dedup
from sedge.llm.jaccard_join import jaccard_join
from sedge.llm.language_id import language_id
from sedge.llm.quotes import in_order, quote_links, with_quoting_replies
from sedge.llm.secrets import secret_spans
from sedge.llm.token_store import store_digests
from sedge.llm.warc import archive_digests


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_digests(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and for each message a reply that quotes it."""
    return in_order(quote_links(with_quoting_replies(table(spark, sf_dir, "conversations")))).select(
        "conv_id", "turn", "role", "reply_to", "root", "depth", "seq", "n_quoted", F.sha2("text", 256).alias("text_sha256")
    )


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_rules.licences(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontaminate, op2_exact_dedup, op3_language_id, op4_bpe, op5_secrets, op6_token_store, op7_warc, op8_quotes, op9_licences, op10_jaccard_join, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    found = {
        "op2_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY norm)""",
        "op7_warc": """
            WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
            h AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS holder FROM p)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN holder <> page_id THEN holder END AS refers_to, true AS verified FROM h""",
        "op8_quotes": r"""
            WITH RECURSIVE told AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
            every AS (SELECT * FROM told UNION ALL SELECT conv_id, turn + 1000000, 'reader', 'On that, the ' || coalesce(role, 'other') || ' wrote:' || chr(10) || '> ' ||
                regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), '((?:[^ ]+ ){6}[^ ]+) ', '\1' || chr(10) || '> ', 'g') || chr(10) || chr(10) || 'Noted as point ' || turn || '.'
                FROM told WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
            src AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM every),
            ls AS (SELECT rid, conv_id, turn, string_split(text, chr(10)) AS parts FROM src),
            ln AS (SELECT rid, conv_id, turn, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM ls),
            mk AS (SELECT *, regexp_extract(raw, '^((?:[ \t]*>)+)(.*)$', 1) AS marks, regexp_extract(raw, '^((?:[ \t]*>)+)(.*)$', 2) AS rest FROM ln),
            lv AS (SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, trim(regexp_replace(lower(CASE WHEN marks <> '' THEN rest ELSE raw END), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM mk),
            nx AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY rid ORDER BY pos), 0) AS after, coalesce(lag(level) OVER (PARTITION BY rid ORDER BY pos) <> level, true) AS fresh FROM lv),
            pn AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY rid ORDER BY pos) AS passage FROM nx),
            own AS (SELECT * FROM pn WHERE level = 0 AND NOT (after > 0 AND regexp_matches(rtrim(raw), '(wrote|writes|said|schrieb|a écrit|escribió)\s*:$'))),
            clean AS (SELECT rid, string_agg(raw, chr(10) ORDER BY pos) AS t FROM own GROUP BY rid),
            nq AS (SELECT rid, count(*) AS n FROM lv WHERE level > 0 AND words <> '' GROUP BY rid),
            ps AS (SELECT conv_id, turn, level, passage, string_agg(words, ' ' ORDER BY pos) AS words FROM pn WHERE level > 0 AND words <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY rid, conv_id, turn, level, passage),
            os AS (SELECT conv_id, turn, string_agg(words, ' ' ORDER BY pos) AS words FROM own WHERE words <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY rid, conv_id, turn
                   UNION ALL SELECT conv_id, turn, words FROM own WHERE words <> '' AND len(string_split(words, ' ')) < 4 AND conv_id IS NOT NULL AND turn IS NOT NULL),
            q AS (SELECT DISTINCT conv_id, turn, level, passage, unnest(CASE WHEN len(string_split(words, ' ')) < 4 THEN ['= ' || words] ELSE list_transform(range(1, len(string_split(words, ' ')) - 2), lambda i: array_to_string(string_split(words, ' ')[i : i + 3], ' ')) END) AS gram FROM ps),
            o AS (SELECT DISTINCT conv_id, turn, unnest(CASE WHEN len(string_split(words, ' ')) < 4 THEN ['= ' || words] ELSE list_transform(range(1, len(string_split(words, ' ')) - 2), lambda i: array_to_string(string_split(words, ' ')[i : i + 3], ' ')) END) AS gram FROM os),
            f AS (SELECT q.conv_id, q.turn, q.level, q.passage, q.gram, max(o.turn) AS source FROM q LEFT JOIN o ON o.conv_id = q.conv_id AND o.gram = q.gram AND o.turn < q.turn GROUP BY ALL),
            c AS (SELECT conv_id, turn, level, passage, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY conv_id, turn, level, passage) AS windows FROM f GROUP BY conv_id, turn, level, passage, source),
            v AS (SELECT conv_id, turn, level, source, sum(n) AS n FROM c WHERE source IS NOT NULL AND 2 * n >= windows GROUP BY ALL),
            b AS (SELECT conv_id, turn, source AS up FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) = 1),
            r AS (SELECT conv_id, turn, up AS root, CAST(1 AS BIGINT) AS depth FROM b UNION ALL SELECT r.conv_id, r.turn, b.up, depth + 1 FROM r JOIN b ON b.conv_id = r.conv_id AND b.turn = r.root),
            top AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(root, depth) AS root FROM r GROUP BY ALL),
            whole AS (SELECT s.conv_id, s.turn, s.role, b.up AS reply_to, coalesce(top.root, s.turn) AS root, coalesce(top.depth, CAST(0 AS BIGINT)) AS depth, coalesce(nq.n, 0) AS n_quoted,
                   regexp_replace(coalesce(clean.t, ''), '^\n+|\n+$', '', 'g') AS text
                   FROM src s LEFT JOIN clean USING (rid) LEFT JOIN nq USING (rid) LEFT JOIN b ON b.conv_id = s.conv_id AND b.turn = s.turn LEFT JOIN top ON top.conv_id = s.conv_id AND top.turn = s.turn)
            SELECT conv_id, turn, role, reply_to, root, depth, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY conv_id, root ORDER BY depth, turn, role NULLS FIRST, text) - 1 END AS seq,
                   n_quoted, sha256(text) AS text_sha256 FROM whole""",
        "op9_licences": licence_rules.oracle(),
        "op10_jaccard_join": r"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w WHERE len(ws) > 0),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            l AS (SELECT x, y, i = a.n AND i = b.n AS same FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 9 * i >= 4 * (a.n + b.n)),
            r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
            c AS (SELECT x, min(y) AS class_id FROM r GROUP BY 1),
            k AS (SELECT x, count(*) AS n_links, min(y) FILTER (WHERE same) AS rep FROM l GROUP BY 1)
            SELECT doc_id, least(doc_id, coalesce(rep, doc_id)) AS rep_id, class_id, coalesce(n_links, 0) AS n_links
            FROM documents JOIN c ON c.x = doc_id LEFT JOIN k ON k.x = doc_id""",
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
