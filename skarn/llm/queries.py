"""One query per training-data operator, over its whole table, and the SQL of those that SQL can express."""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, hnsw, importance, licenses, packing, periodic, quality, simhash, token_counts, token_output, toxicity, webp
from .common import prepare, shared_dir, table
from .scan_sql import importance_sql, license_sql, periodic_sql


def op1_token_output(spark, sf_dir):
    path = shared_dir(prepare(spark))
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_output.with_checksum(token_output.read_tokens(spark, path))


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_packing(spark, sf_dir):
    return packing.pack_documents(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.read_back(chat.format_trees(chat.turns_as_trees(rows), null_tree=True))


def op6_embedding_dedup(spark, sf_dir):
    return hnsw.near_duplicates(table(prepare(spark), sf_dir, "embeddings"))


def op7_simhash_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_quality(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_media(spark, sf_dir):
    return webp.features(webp.store(table(prepare(spark), sf_dir, "documents")))


def op11_periodic_runs(spark, sf_dir):
    return periodic.digests(periodic.find_runs(periodic.with_tails(table(prepare(spark), sf_dir, "documents"))))


def op12_license_scan(spark, sf_dir):
    return licenses.digests(licenses.scan(table(prepare(spark), sf_dir, "documents")))


def op13_importance_resampling(spark, sf_dir):
    return importance.resample(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    own = (op1_token_output, op2_token_counts, op3_packing, op4_toxicity, op5_chat_format, op6_embedding_dedup, op7_simhash_dedup, op8_quality, op9_byte_bpe, op10_media, op11_periodic_runs, op12_license_scan, op13_importance_resampling)
    return {f.__name__: f for f in own}


def _controls() -> str:
    """The control strings as one pattern with any number of backslashes after the first character."""
    sign = lambda c: f"[{c}]" if c in ".*+?()|{}^$" else f"\\{c}" if c in "[]\\" else c
    return "|".join(f"{sign(c[0])}\\\\*{''.join(map(sign, c[1:]))}" for c in chat.CONTROLS)


def oracle_sql():
    chat_sql = f"""
    WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length('<|turn:' || role || '|><|end|>') + length(text) + len(regexp_extract_all(text, '{_controls()}'))) AS BIGINT) AS formatted_chars
    FROM rows_ GROUP BY conv_id"""
    near_sql = """
    WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
    u AS (SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS n FROM v
        WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
        WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), d AS (SELECT a, count(*) AS n FROM link GROUP BY a)
    SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
    FROM v JOIN c ON c.a = v.vec_id LEFT JOIN d ON d.a = v.vec_id"""
    return {"op5_chat_format": chat_sql, "op6_embedding_dedup": near_sql, "op11_periodic_runs": periodic_sql(), "op12_license_scan": license_sql(licenses.TEMPLATES, licenses.SHARE), "op13_importance_resampling": importance_sql()}
