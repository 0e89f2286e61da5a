"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_report
from .chat_format import conversations_of, paired_with_neighbour, preference_pairs
from .common import table
from .divergence import DIVERGENCE_SQL, source_divergence
from .embedding_dedup import near_duplicates
from .fingerprints import fingerprint_documents
from .jaccard_join import jaccard_join
from .license_scan import license_sql, scan_licenses
from .mixing import mix_sources
from .prefix_trie import TRIE_SQL, conversation_trie
from .secret_scan import secret_report
from .suffix_dedup import remove_repeats
from .toxicity import label_categories, score_toxicity, train_chain
from .warc import archive_round_trip


def vocabulary() -> str:
    """Where the byte-level vocabulary file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 8))::BIGINT AS h, text
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sources
), sums AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM ranked WINDOW o AS (ORDER BY cap::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - cap_before)::DOUBLE / (all_w - w_before)::DOUBLE AS lvl,
         cap < (total - cap_before)::DOUBLE / (all_w - w_before)::DOUBLE * w AS stops FROM sums
), targets AS (
  SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE
         (SELECT arg_min(lvl, cap::DOUBLE / w * 1e6 + i) FROM levels WHERE NOT stops) * w END AS target FROM levels
), rows_ AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5(coalesce('s' || d.source, 'null') || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size + 8)), (size + 8) >> (length(bin(size + 8)) - 4), h % b, size, h, doc_id) AS r
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
  CROSS JOIN (SELECT greatest(1, (floor(sqrt(greatest(0, count(*) - 1)))::BIGINT + 1) // 32) AS b FROM documents)
), taken_ AS (
  SELECT *, least(floor(u + r * rate) - floor(u + (r - 1) * rate), 3)::BIGINT AS copies FROM rows_
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM taken_
"""


def op2_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_report(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op7_preference_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(paired_with_neighbour(conversations_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return pairs.select("conv_id", "n_prompt", "prompt", "chosen_completion", "rejected_completion", spans(F.col("chosen_mask")).alias("chosen_mask"), spans(F.col("rejected_mask")).alias("rejected_mask"))


OP7_SQL = r"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), last_ AS (
  SELECT conv_id, max(i) AS at, arg_max(text, i) AS said FROM ordered WHERE role = 'assistant' GROUP BY conv_id
), sides AS (
  SELECT o.conv_id, i, role, text AS chosen, CASE WHEN i = a.at THEN b.said ELSE text END AS rejected, a.at IS NOT NULL AND b.at IS NOT NULL AS paired
  FROM ordered o LEFT JOIN last_ a USING (conv_id) LEFT JOIN last_ b ON b.conv_id = xor(o.conv_id, 1)
), firsts AS (
  SELECT conv_id, CASE WHEN bool_and(paired) THEN coalesce(min(i) FILTER (WHERE chosen <> rejected), max(i) + 1) ELSE 0 END AS n_prompt FROM sides GROUP BY conv_id
), lens AS (
  SELECT s.*, n_prompt, '<|' || role || '|>' || chr(10) AS head FROM sides s JOIN firsts USING (conv_id)
), ends AS (
  SELECT *, sum(CASE WHEN i >= n_prompt THEN length(head) + length(chosen) + 1 ELSE 0 END) OVER w AS c_end,
            sum(CASE WHEN i >= n_prompt THEN length(head) + length(rejected) + 1 ELSE 0 END) OVER w AS r_end
  FROM lens WINDOW w AS (PARTITION BY conv_id ORDER BY i)
)
SELECT conv_id, any_value(n_prompt)::INT AS n_prompt,
       coalesce(string_agg(head || chosen || chr(10), '' ORDER BY i) FILTER (WHERE i < n_prompt), '') AS prompt,
       coalesce(string_agg(head || chosen || chr(10), '' ORDER BY i) FILTER (WHERE i >= n_prompt), '') AS chosen_completion,
       coalesce(string_agg(head || rejected || chr(10), '' ORDER BY i) FILTER (WHERE i >= n_prompt AND paired), '') AS rejected_completion,
       coalesce(string_agg((c_end - length(chosen) - 1)::BIGINT || ':' || c_end::BIGINT, ',' ORDER BY i) FILTER (WHERE i >= n_prompt AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((r_end - length(rejected) - 1)::BIGINT || ':' || r_end::BIGINT, ',' ORDER BY i) FILTER (WHERE i >= n_prompt AND paired AND role = 'assistant'), '') AS rejected_mask
FROM ends GROUP BY conv_id
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("payload", "url")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages
), best AS (
  SELECT d, max(page_id) AS best FROM p GROUP BY d
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (('0x' || substr(p.d, (k * 5 + 1)::INT, 5))::BIGINT // (32 ** (3 - j))::BIGINT % 32 + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM p JOIN best USING (d)
"""


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train_chain(docs, label_categories(table(spark, sf_dir, "labels")), ("low_quality", "toxic"))
    return score_toxicity(docs, chain).drop("text")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_mix_sources,
        op2_remove_repeats,
        op3_fingerprints,
        op4_embedding_near_duplicates,
        op5_secret_scan,
        op6_bpe,
        op7_preference_chats,
        op8_jaccard_join,
        op9_warc_round_trip,
        op10_toxicity_chain,
        op11_license_scan,
        op12_source_divergence,
        op13_conversation_trie,
        pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op7_preference_chats": OP7_SQL, "op9_warc_round_trip": OP9_SQL, "op11_license_scan": license_sql(), "op12_source_divergence": DIVERGENCE_SQL, "op13_conversation_trie": TRIE_SQL}
