"""The subpackage's queries over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences
from .storage import new_path


#: Scores from which a document counts as good, and as toxic.
QUALITY_THRESHOLD, TOXIC_THRESHOLD = 0.3, 0.5


def tokenizer_path(name: str) -> str:
    """A public vocabulary's file on this machine; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_orc import read_token_orc, token_digests, write_token_orc

    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "op1-tokens")
    write_token_orc(docs, path, tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_digests(read_token_orc(spark, path))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and the texts that they decode to, as digests."""
    from .piece_transducer import decode_pieces, encode_pieces

    model = tokenizer_path("piece_bpe_32k.model")
    encoded = encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
    digests = ["(length(piece_ids) / 4)::long AS n_pieces", "crc32(piece_ids) AS ids_crc32"]
    texts = ["length(text)::long AS decoded_chars", "crc32(text::binary) AS decoded_crc32"]
    kept = decode_pieces(encoded, model, keep_ids=True)
    return kept.selectExpr("doc_id", *digests, *texts)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op5_pivot_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_lists import near_duplicate_vectors

    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents, piece_digests

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_digests(pack_documents(docs, tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=1))


def op6_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .noisy_or import fit, score_toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_THRESHOLD).cast("int"))


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_cnn import fit, score_quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(more)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_licences": op2_licences,
    "op3_topk": op3_topk,
    "op4_packing": op4_packing,
    "op5_pivot_lists": op5_pivot_lists,
    "op6_noisy_or": op6_noisy_or,
    "op7_pieces": op7_pieces,
    "op8_byte_cnn": op8_byte_cnn,
    "op9_simhash": op9_simhash,
    "op10_chat": op10_chat,
}

#: DuckDB knows neither the tokenizers nor the models nor XXH64: those queries are tested against plain Python instead.
ORACLE_SQL: dict[str, str] = {
    "op2_licences": licences.oracle_sql(),
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op5_pivot_lists": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN counts USING (vec_id)""",
    "op10_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        turns AS (
            SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 0 END
                + length(text) + length(text) - length(replace(text, '\', ''))
                + len(regexp_extract_all(text, '<</?SYS>>|\[/?INST\]|</?s>|<</?ROLE>>|<</TEXT>>')) AS n
            FROM rows
        ),
        summed AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, turn = max(turn) OVER (PARTITION BY conv_id) AS final FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(CASE WHEN role = 'assistant' OR final THEN upto ELSE 0 END)::BIGINT AS formatted_chars
        FROM summed GROUP BY conv_id""",
}
