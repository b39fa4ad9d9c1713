"""The registered queries of the operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm import contextmix, lines, mixing, packing, phrases, postings, quality, simhash, tokenfiles, tokens, topk, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_CACHE = 256 << 20  # bytes of words and their ids in a Python worker that does little else


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.token_pieces(table(spark, sf_dir, "documents"), VOCABULARY, length=2048, cache_bytes=WORD_CACHE)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, capacity=2048)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokenfiles.token_round_trip(table(spark, sf_dir, "documents"), VOCABULARY, cache_bytes=WORD_CACHE)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024.0)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = contextmix.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"), with_payload=False, least_bytes=1000)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return postings.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality", "accepted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
    each = found.select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
        F.col("value").alias("whitened"), F.col("explained")[F.col("at")].alias("explained"), "identity_error",
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"), least=30, top=2000, share=80)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out)))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_files": op3_token_files,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_context_mixing": op6_context_mixing,
    "op7_warc": op7_warc,
    "op8_posting_lists": op8_posting_lists,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_toxicity": op13_toxicity,
}

_WORDS = r"""coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"""

# The mix in closed form: whole readings of a source, and of the rest the part that a document has.
_OP1 = f"""
WITH sizes AS (
    SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS shuffle
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sizes GROUP BY source
), levels AS (
    SELECT *, 3 * source_size / weight AS stop,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))
            / sum(weight) OVER following AS level
    FROM totals
    WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        following AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
    SELECT source, source_size,
        CASE WHEN stop <= level THEN (3 * source_size)::DOUBLE
            ELSE max(CASE WHEN stop > level THEN level END) OVER () * weight END AS target
    FROM levels
), placed AS (
    SELECT s.*, t.source_size, t.target, round(t.target)::BIGINT AS want,
        coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY shuffle, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
    CASE WHEN size = 0 THEN 0 ELSE
        (want // source_size) * size + least(size, greatest(want % source_size - start, 0)) END::BIGINT AS taken
FROM placed
"""

_OP4 = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keys AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM keyed
), first AS (
    SELECT key, min(doc_id) AS holder FROM keys WHERE length(key) >= 10 GROUP BY key
), marked AS (
    SELECT k.*, coalesce(f.holder <> k.doc_id, false) AS gone
    FROM keys k LEFT JOIN first f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP5 = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_OP7 = """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digests AS (
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM payloads
), latest AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM latest
"""

# Occurrences of one to four words, by their place in a piece.
_OP12 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces
), starts AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS start FROM worded
), grams AS (
    SELECT lang, size, words[start : start + size - 1] AS phrase, count(*) AS a
    FROM starts CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS size)
    WHERE start + size - 1 <= len(words) GROUP BY ALL
), totals AS (
    SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang
), known AS (
    SELECT * FROM grams WHERE a >= 30
), inside AS (
    SELECT DISTINCT x.lang, x.part FROM (
        SELECT k.lang, k.a AS longer, unnest(flatten(list_transform(range(2, k.size),
            lambda s: list_transform(range(1, k.size - s + 2), lambda b: k.phrase[b : b + s - 1])))) AS part
        FROM known k WHERE k.size > 2
    ) x JOIN known c ON c.lang = x.lang AND c.phrase = x.part WHERE 100 * longer >= 80 * c.a
), cuts AS (
    SELECT k.*, unnest(range(1, k.size)) AS k FROM known k
    WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = k.lang AND i.part = k.phrase)
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, h.a AS l, t.a AS r, ((2000000 * c.a::HUGEINT) // (h.a + t.a))::BIGINT AS score
    FROM cuts c JOIN known h ON h.lang = c.lang AND h.phrase = c.phrase[1 : c.k]
        JOIN known t ON t.lang = c.lang AND t.phrase = c.phrase[c.k + 1 : c.size]
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, array_to_string(phrase, ' ') AS shown, (row_number() OVER (PARTITION BY lang
        ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')))::BIGINT AS rank
    FROM lowest
)
SELECT lang, rank, shown AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {
    "op1_mixing": _OP1, "op4_line_dedup": _OP4, "op5_exact_top_k": _OP5, "op7_warc": _OP7, "op12_collocations": _OP12,
}
