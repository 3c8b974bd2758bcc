"""The registered queries of the ten operators: opN_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import chat, wavelet
from lanewise.llm.common import table
from lanewise.llm.decontam import leaks
from lanewise.llm.embeddings import near_embeddings
from lanewise.llm.licenses import scan_licenses
from lanewise.llm.minhash import near_duplicates
from lanewise.llm.packing import pack_documents
from lanewise.llm.secrets import scan_documents
from lanewise.llm.toxicity import score_documents
from lanewise.llm.warc import archived

#: A conversation whose texts hold the template's control strings.
TRICKY = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_back(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations"))
    return chat.read_back(turns.union(spark.createDataFrame(TRICKY, turns.schema)))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"), least=0.9)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_licenses, op3_secrets, op4_packing, op5_wavelet, op6_chat, op7_minhash, op8_warc, op9_embeddings, op10_decontamination)}

_TURN = TRICKY[0][3]


def _broken(x: str, *more: str) -> str:
    """SQL: characters that escaping adds to x."""
    starts = " OR ".join([f"starts_with(substr({x}, i, 7), '{c}')" for c in ("<turn>", "</turn>", "###", "\\", *more)])
    return f"len(list_filter(range(1, len({x}) + 1), lambda i: {starts}))"


#: The others learn a model, tokenize, run hundreds of patterns or need a test battery, or are too slow as joins of whole tables; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_chat": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_TURN}'), (-7, 1, 'assistant', '{_TURN}')) x(conv_id, turn, role, text)),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
            sum({len(chat.OPEN + chat.HEAD + chat.COLON + chat.CLOSE)} + len(role) + len(text) + {_broken("role", ": ")} + {_broken("text")}) AS formatted_chars FROM t GROUP BY conv_id)
        SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(whole) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g""",
    "op8_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
        d AS (SELECT page_id, payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM d""",
}
