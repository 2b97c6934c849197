"""The thin opN queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontam, html_text, importance, langid, licenses, line_dedup, media, mixing, ngram_join, sharding, suffix_dedup, tokens, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards.  A null text has no bytes: size 1 and the CRC of nothing, 0."""
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    narrow = docs.select("doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = sharding.assign_shards(narrow, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    from .common import settled

    m = mixing.mix(settled(narrow), size_col="size")
    return m.select("row.doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of /source/lang/hundred/; every tenth lies in /source/lang, every hundredth in /source.

    A document that opens with a licence stands for its directory's licence file.
    """
    hundred = F.concat(F.lit("/"), F.expr("cast(doc_id div 100 as string)"))
    lang = F.concat(F.lit("/"), F.coalesce("lang", F.lit("none")), F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(hundred))
    folder = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.when(F.col("doc_id") % 100 == 0, F.lit("")).otherwise(lang))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return licenses.scan(files, is_licence_file=F.col("first"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = langid.training_sample(learnable(docs))
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), sample).select("doc_id", held, "lang_pred", F.col("lang_score").alias("score"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_media": op2_media,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_line_dedup": op8_line_dedup,
    "op9_language": op9_language,
    "op10_ngram_join": op10_ngram_join,
    "op11_html_text": op11_html_text,
    "op12_whitening": op12_whitening,
    "op13_importance": op13_importance,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"[^\x20\x09-\x0D]+"

#: Shingles, links by counting common shingles of all pairs, components by reachability.
_OP10 = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}') AS w FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM t),
 x AS (SELECT doc_id, unnest(g) AS s FROM g), n AS (SELECT doc_id, len(g) AS n FROM g),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * common >= 85 * (p.n + q.n - common)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
 SELECT n.doc_id, n.n AS n_shingles, (SELECT min(b) FROM r WHERE r.a = n.doc_id) AS component_id FROM n"""

_M = "(('0x' || substr(md5({}), 1, 15))::BIGINT)"
#: Water filling, the ranking of all seats, blocks in seeded order, and each document's part of every block.
_OP3 = rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS size, coalesce('=' || source, '-') AS g, {_M.format("'42:' || doc_id")} AS h FROM documents),
 s0 AS (SELECT g, source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY g, source),
 s1 AS (SELECT *, [1.0, 2.0, 3.0][place % 3 + 1]::DOUBLE AS weight, size * 3.0::DOUBLE AS cap, sum(size) OVER ()::BIGINT AS whole FROM s0),
 s2 AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
 s3 AS (SELECT *, cap / weight <= level AS full_ FROM s2),
 s4 AS (SELECT *, least(cap, CASE WHEN full_ THEN cap ELSE weight * ((whole - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (), 0)) END) AS target, greatest(1, (whole + 32767) // 32768) AS block FROM s3),
 k AS (SELECT g, place, target, unnest(range(3 * size)) AS k FROM s4 WHERE target > 0), o AS (SELECT g, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS r FROM k),
 q AS (SELECT g, count(*) AS quota FROM o WHERE r <= (SELECT sum(size) FROM d) GROUP BY g),
 b0 AS (SELECT s4.g, block, size, quota, unnest(range((size + block - 1) // block)) AS j FROM s4 JOIN q USING (g)), b1 AS (SELECT *, least(block, size - j * block) AS tokens FROM b0),
 b2 AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY g ORDER BY tokens < block, {_M.format("'42:' || g || ':' || j")}, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM b1),
 b AS (SELECT g, j, j * block AS a, j * block + tokens AS z, quota // size AS turns, least(tokens, greatest(0, quota % size - ahead)) AS part FROM b2),
 p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY g ORDER BY h % greatest(16, least(65536, ((SELECT count(*) FROM documents) + 255) // 256)), h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM d),
 u AS (SELECT p.doc_id, sum(turns * (least(z, x + size) - greatest(a, x)) + greatest(0, least(a + part, x + size) - greatest(a, x))) AS taken FROM p JOIN b ON b.g = p.g AND a < x + size AND z > x GROUP BY p.doc_id)
 SELECT p.doc_id, p.size, s4.size AS source_size, s4.target, coalesce(taken, 0)::BIGINT AS taken FROM p JOIN s4 USING (g) LEFT JOIN u ON u.doc_id = p.doc_id"""

#: Every window of 200 bytes, the bytes that repeated ones cover, and what is left.
_OP5 = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), n AS (SELECT doc_id, x, len(x) // 2 AS n FROM t),
 w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 400)) AS v FROM n, LATERAL (SELECT unnest(range(n.n - 199)) AS p)), c AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1),
 f AS (SELECT doc_id, p, coalesce(p - lag(p) OVER o > 200, true) AS new FROM w SEMI JOIN c USING (v) WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
 i AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f), s AS (SELECT doc_id, k, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY ALL),
 h AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a, a AS z FROM s UNION ALL SELECT doc_id, max(z), 1000000000 FROM s GROUP BY doc_id),
 r AS (SELECT n.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM h JOIN n USING (doc_id) GROUP BY n.doc_id), m AS (SELECT doc_id, sum(z - a)::BIGINT AS gone, count(*) AS spans FROM s GROUP BY doc_id)
 SELECT n.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM n LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id)"""

#: The others have no SQL: checksums (1, 9), media and parses (2, 4, 6, 9), hashes of Spark's own (7, 8); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op3_mixing": _OP3, "op5_suffix_dedup": _OP5, "op10_ngram_join": _OP10}
