"""The corpus operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import table


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers as public

    return {"json_path": public.path("byte_bpe_50k.json"), "ranks_path": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that occur again or nearly again: counts and the kept text's hash.

    Null and empty texts have no lines; a tie of place goes to the earlier line of the smaller doc_id.  See line_dedup for
    repeated rows and null ids.
    """
    from tessera.llm.line_dedup import line_duplicates

    out = line_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text; a null text is the empty one, and every row gives a row, repeated ones too."""
    from tessera.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), **tokenizer_files())


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds; null or wordless texts and items match nothing."""
    from tessera.llm.tiling import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents; texts without words and rows with a null doc_id are in no group."""
    from tessera.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and the text decoded from them, as hashes; a null text is the empty one."""
    from tessera.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), **tokenizer_files())


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all rows for every row whose vec_id is divisible by 20; ties to the smaller vec_id.

    Null, zero and non-finite vectors take no part, neither do rows with a null vec_id; repeated query rows are one query.
    """
    from tessera.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned outside the held-out fold; null and empty texts are scored as any other."""
    from tessera.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that a window of 50 covers which also starts in a smaller doc_id; null texts have none."""
    from tessera.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned outside the held-out fold; null, empty and blank texts score 0."""
    from tessera.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a string of 100 covers which also starts earlier; a null text is the empty one."""
    from tessera.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_benchmark_decontamination, op4_minhash_near_dedup, op5_bpe_codec, op6_nearest_neighbours, op7_quality_classifier, op8_substring_dedup, op9_toxicity, op10_suffix_array_dedup)}

SQL: dict[str, str] = {
    "op1_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text <> '')),
f AS (
  SELECT line, min((doc_id, pos)) AS first, strlen(line) AS n FROM l WHERE trim(line) <> '' GROUP BY line),
k AS (
  SELECT a.line, b.first AS other FROM f a JOIN f b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= least(2, least(a.n, b.n) // 20)),
j AS (
  SELECT f.line, f.first, count(k.other) AS links, coalesce(min(k.other) < f.first, false) AS near
  FROM f LEFT JOIN k ON k.line = f.line GROUP BY f.line, f.first),
o AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(j.links, 0) AS links,
    coalesce(j.near OR (l.doc_id, l.pos) <> j.first, false) AS gone
  FROM l LEFT JOIN j ON l.line = j.line),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sum(links) AS n_links,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
  coalesce(g.n_links, 0)::BIGINT AS n_links, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
""",
    "op6_nearest_neighbours": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p)
WHERE r <= 20
""",
}
