"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingle sets have Jaccard >= 0.9, directly or in steps."""
    from .ngram_join import jaccard_groups

    found = jaccard_groups(table(spark, sf_dir, "documents"), "doc_id", "text", k=3, num=90, den=100)
    return found.selectExpr("id as doc_id", "n_shingles", "component_id")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    from .mixing import allocate, words

    took = allocate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", ["doc_id"], words("text"))
    return took.select("doc_id", "size", "source_size", "target", "taken", F.col("shard_copies").cast("string").alias("shards"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    from .token_files import token_digests

    return token_digests(table(spark, sf_dir, "documents"), "doc_id", "text", end_id=2)


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", capacity=1024, end_id=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    from .toxicity import label_toxicity

    return label_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    from .edit_fingerprint import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, folded, rendered and read back."""
    from .chat import digest_chats, reconstruct

    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
    return digest_chats(reconstruct(turn_events(logs.unionByName(extra))))


def turn_events(turns: DataFrame) -> DataFrame:
    """A message event for each row (conv_id, turn, role, text). Rows that share a turn are messages of their own, by role, then text."""
    tie = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    msg = F.struct(F.col("turn"), F.row_number().over(tie).alias("tie"))
    return turns.select("conv_id", msg.alias("msg"), F.col("turn").alias("seq"), F.lit("message").alias("op"), "role", "text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without near-duplicate lines."""
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back."""
    from .warc_writer import archive

    return archive(table(spark, sf_dir, "pages")).selectExpr("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "checked")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    from .embedding_dedup import embedding_groups

    found = embedding_groups(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.selectExpr("id as vec_id", "n_links", "component_id", "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents as prefix, suffix and middle, and of the texts rebuilt from them."""
    from .fill_middle import digest, fill_in_middle

    return digest(fill_in_middle(table(spark, sf_dir, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the features of the benchmark, and the ranks of those drawn."""
    from .importance import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    from .collision_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (op1_source_mixing, op2_token_files, op3_bestfit_packing, op4_toxicity, op5_edit_fingerprints, op6_chat_formatting, op7_line_dedup, op8_warc_archives, op9_ngram_jaccard_join, op10_embedding_near_dedup, op11_fill_in_middle, op12_importance_resampling, op13_collision_search)
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


_DRAWS = ", ".join(f"('0x' || substr(sha256('1:' || doc_id), {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
_FORM = "CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END"
_OUTPUT = "CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END"
FILL_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {_DRAWS} FROM documents),
f AS (SELECT *, {_FORM} AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256({_OUTPUT}) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""


def oracle_sql() -> dict[str, str]:
    """SQL of the one operator here that SQL can express: the others need checksums, classifiers, tokenizers or approximate searches."""
    return {"op11_fill_in_middle": FILL_SQL}
