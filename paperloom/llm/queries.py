"""Queries over the driver's tables for the operators of this package, and their SQL counterparts."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, codes, jaccard, licenses, lines, packing, pages, pieces, ppm, quality, substrings, topk, turns


@cache
def vocabulary(name: str) -> bytes:
    """A public vocabulary file; operators take its content, so its place is the caller's."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@cache
def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(read(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(read(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op8_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json").decode())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return quality.assess(documents, quality.fit(documents, read(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col("lines.n_lines").alias("n_lines"), F.col("lines.n_removed").alias("n_removed"), "text")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired_conversations(read(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings")).drop("label")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_html_text": op2_html_text,
    "op3_ppm_score": op3_ppm_score,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_exact_topk": op7_exact_topk,
    "op8_sum_of_squares": op8_sum_of_squares,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLES: dict[str, str] = {}

ORACLES["op7_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

ORACLES["op10_line_dedup"] = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
    SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS key
    FROM (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) AS i FROM l)
),
worded AS (SELECT * FROM w WHERE regexp_matches(key, '[^\x20\x09-\x0D]')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM worded),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM ranked, (SELECT unnest(range(0, 3)) AS k) WHERE n > 1),
line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS at FROM l),
kept AS (
    SELECT line.doc_id, count(gone.at) AS n_removed,
           coalesce(string_agg(CASE WHEN gone.at IS NULL THEN line END, chr(10) ORDER BY line.at), '') AS text
    FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.at = line.at
    GROUP BY line.doc_id
)
SELECT l.doc_id, CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(kept.n_removed, 0) AS BIGINT) AS n_removed,
       kept.text AS text
FROM l LEFT JOIN kept ON kept.doc_id = l.doc_id
"""

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op4_ngram_jaccard"] = (
    """
WITH RECURSIVE d AS (
    SELECT doc_id, """
    + _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """ AS ws FROM documents
),
s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
),
link AS (
    SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
    WHERE 100 * o >= 75 * (nx.n + ny.n - o)
),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.doc, e.y FROM reach JOIN e ON e.x = reach.other
),
least AS (SELECT doc, min(other) AS component_id FROM reach GROUP BY doc)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON least.doc = d.doc_id
"""
)

ORACLES["op5_substring_dedup"] = (
    """
WITH d AS (SELECT doc_id, """
    + _WORDS.format(text="coalesce(text, '')")
    + """ AS ws FROM documents),
w AS (
    SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) AS k
    FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 49, 0))) AS i FROM d)
),
low AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (
    SELECT DISTINCT doc_id, i + j AS at
    FROM (SELECT w.doc_id, w.i FROM w JOIN low ON low.k = w.k WHERE low.least < w.doc_id), (SELECT unnest(range(0, 50)) AS j)
),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS at FROM d),
kept AS (
    SELECT word.doc_id, count(gone.at) AS n_removed,
           string_agg(CASE WHEN gone.at IS NULL THEN word.word END, ' ' ORDER BY word.at) AS rest
    FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.at = word.at GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(kept.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.rest, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
)
