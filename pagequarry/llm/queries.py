"""The registered queries of this subpackage and, where SQL can say it, equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import (
    collocations,
    decontamination,
    embedding_dedup,
    html_extraction,
    language_id,
    license_scan,
    mixing,
    packing,
    pii,
    shingle_join,
    token_counts,
    toxicity,
    whitening,
)

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
PACKING_TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, folder, "documents")))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.severity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.dedupe(table(spark, folder, "embeddings"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT
    )


def op8_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.groups(table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, folder, "documents")))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_shingle_join": op8_shingle_join,
    "op9_license_scan": op9_license_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_collocations": op11_collocations,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_embedding_whitening": op13_embedding_whitening,
}

OP2_SQL = """
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
           ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[:12])::BIGINT AS hash
    FROM documents
), sized AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
    FROM d GROUP BY source
), fill AS (
    SELECT 0 AS round, (SELECT sum(source_size) FROM sized)::HUGEINT AS left_words,
           (SELECT sum(weight) FROM sized)::HUGEINT AS left_weight
    UNION ALL
    SELECT round + 1,
           (SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size * left_weight <= weight * left_words), 0) FROM sized)::HUGEINT,
           (SELECT coalesce(sum(weight) FILTER (3 * source_size * left_weight > weight * left_words), 0) FROM sized)::HUGEINT
    FROM fill WHERE left_weight > 0 AND round < 100
), final AS (
    SELECT left_words, left_weight FROM fill WHERE left_weight > 0 ORDER BY round DESC LIMIT 1
), targets AS (
    SELECT source, source_size,
           CASE WHEN 3 * source_size * left_weight <= weight * left_words THEN (3 * source_size)::DOUBLE
                ELSE (weight * left_words)::DOUBLE / left_weight::DOUBLE END AS target
    FROM sized, final
), plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies
    FROM targets
), grouped AS (
    SELECT source, hash, sum(size) AS words FROM d GROUP BY source, hash
), running AS (
    SELECT source, hash, words,
           coalesce(sum(words) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM grouped
), edge AS (
    SELECT p.source, p.target - p.copies * p.source_size AS budget, max_by(r.hash, r.before) FILTER (true) AS hash
    FROM plan p JOIN running r ON r.source IS NOT DISTINCT FROM p.source
    WHERE r.before <= p.target - p.copies * p.source_size
    GROUP BY ALL
), edges AS (
    SELECT e.source, max(r.hash) AS hash, max(e.budget) AS budget
    FROM edge e JOIN running r ON r.source IS NOT DISTINCT FROM e.source AND r.before <= e.budget
    GROUP BY e.source
), cut AS (
    SELECT e.source, e.hash + CASE WHEN r.before + r.words - e.budget < e.budget - r.before THEN 1 ELSE 0 END AS threshold
    FROM edges e JOIN running r ON r.source IS NOT DISTINCT FROM e.source AND r.hash = e.hash
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       least(3, p.copies + CASE WHEN d.hash < c.threshold THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source
JOIN cut c ON c.source IS NOT DISTINCT FROM d.source
"""

OP11_SQL = """
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), sized AS (
    SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM worded
), grams AS (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized WHERE len(w) >= k
), f AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, k, phrase, f AS a FROM f WHERE k >= 2 AND f >= 100
), free AS (
    SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a
        AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
    SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM free
), scores AS (
    SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, n.n,
           ((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN n ON n.lang = c.lang
    JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
    JOIN f y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), lowest AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n, score
    FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

SQL = {"op2_mixing": OP2_SQL, "op11_collocations": OP11_SQL}
