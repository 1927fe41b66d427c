"""One query for each operator of this subpackage, over its whole table, and SQL where there is some."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postscreen.llm import (
    ann, jaccard, langid, licenses, mixing, negatives, packing, phrases, sharding, topk, toxicity, warc, windows,
)
from postscreen.llm.common import table, word_count
from postscreen.session import new_table_path

SHARD_BYTES = 1 << 20
LINK_RULE = jaccard.Rule(words=3, num=90, den=100)
ASK_EVERY = 20
# The file of the public word vocabulary; the library that holds it is installed beside the others.
TOKENIZER = "word_bpe_49k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, written and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    payload = F.col("html").cast("binary")
    dictionary = warc.train_dictionary(pages, "page_id", payload)
    marked = warc.mark_revisits(pages, "page_id", payload)
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    records = marked.select(
        name.alias("record_id"),
        F.concat(F.lit("urn:page:"), F.col("refers_to").cast("string")).alias("refers_to"),
        F.col("url").alias("address"),
        "payload",
        "payload_bytes",
        "payload_digest",
    )
    path = new_table_path(spark, "archives")
    warc.write_archives(records, path, dictionary)

    def number(urn: str):
        return F.nullif(F.substring_index(urn, ":", -1), F.lit("")).cast("long")

    read = warc.valid(warc.read_archives(spark, path, payloads=False))
    return read.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = licenses.build_index(documents, "text")
    return licenses.digest(licenses.scan(documents, "text", index).drop("text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sized = documents.select("doc_id", word_count(F.col("text")).alias("size"))
    return packing.pack_rows(sized, "doc_id", "size")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % ASK_EVERY == 0), "vec_id", "embedding")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), rule=LINK_RULE)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sized = documents.select("doc_id", F.octet_length("text").alias("n_bytes"))
    return sharding.shard(sized, "doc_id", "n_bytes", SHARD_BYTES)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % ASK_EVERY == 0), "vec_id", "embedding")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    mixed = mixing.mix(documents, "doc_id", word_count(F.col("text")), "source")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as token ids with an end token, cut into sequences of at most 4096."""
    path = importlib.import_module("public_tokenizers").path(TOKENIZER)
    pieces = windows.pack(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"), "text", "lang")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is divisible by 7 count under the next label; anchors are those divisible by 100."""
    key = F.col("vec_id")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", key % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_licenses, op3_packing, op4_toxicity, op5_ann, op6_jaccard, op7_sharding,
        op8_langid, op9_topk, op10_mixing, op11_packing, op12_phrases, op13_negatives, pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH rows AS (
            SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest
            FROM pages
        ), firsts AS (
            SELECT digest, min(page_id) AS first_id FROM rows
            WHERE octet_length(encode(html)) >= 100 GROUP BY digest HAVING count(*) > 1
        )
        SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest,
            CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
                THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM rows LEFT JOIN firsts USING (digest)
    """,
    "op7_sharding": f"""
        WITH rows AS (
            SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
                ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
            FROM documents
        ), deep AS (
            SELECT doc_id, n_bytes, h, d, h >> (32 - d) AS part FROM rows, range(33) r(d)
        ), sizes AS (
            SELECT d, part, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
            FROM deep GROUP BY d, part
        ), fitting AS (
            SELECT doc_id, n_bytes, h, min(d) AS depth FROM deep JOIN sizes USING (d, part)
            WHERE shard_bytes <= {SHARD_BYTES} GROUP BY doc_id, n_bytes, h
        )
        SELECT doc_id, n_bytes,
            CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), 32, '0'), 1, depth::INTEGER) END AS shard,
            depth, shard_bytes, shard_rows, false AS oversized
        FROM fitting JOIN sizes ON d = depth AND part = h >> (32 - depth)
    """,
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), lists AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS words FROM pieces
        ), grams AS (
            SELECT lang, k, gram, count(*) AS f FROM (
                SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2),
                    lambda i: array_to_string(list_slice(words, i, i + k - 1), ' '))) AS gram
                FROM lists, range(1, 5) ks(k) WHERE len(words) >= k
            ) GROUP BY lang, k, gram
        ), totals AS (
            SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
        ), frequent AS (
            SELECT lang, k, gram, f, string_split(gram, ' ') AS words FROM grams WHERE f >= 30
        ), sides AS (
            SELECT lang, k, gram, f AS a, unnest(range(1, k)) AS j, words FROM frequent WHERE k >= 2
        ), named_sides AS (
            SELECT lang, gram, a, j, array_to_string(list_slice(words, 1, j), ' ') AS lefts,
                array_to_string(list_slice(words, j + 1, k), ' ') AS rights
            FROM sides
        ), cut AS (
            SELECT s.lang, s.gram, a, j, l.f AS l, r.f AS r,
                (2000000::HUGEINT * a // (l.f::HUGEINT + r.f)) AS score
            FROM named_sides s JOIN frequent l ON l.lang = s.lang AND l.gram = lefts
            JOIN frequent r ON r.lang = s.lang AND r.gram = rights
        ), lowest AS (
            SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, j) = 1
        ), inner_starts AS (
            SELECT lang, k, f, words, m, unnest(range(1, k - m + 2)) AS s
            FROM frequent, range(2, 4) ms(m) WHERE m < k
        ), longer AS (
            SELECT lang, array_to_string(list_slice(words, s, s + m - 1), ' ') AS gram, max(f) AS f
            FROM inner_starts GROUP BY ALL
        ), kept AS (
            SELECT w.* FROM lowest w LEFT JOIN longer g ON g.lang = w.lang AND g.gram = w.gram
            WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * w.a
        ), named AS (
            SELECT lang, gram AS phrase, a, l, r, score::BIGINT AS score FROM kept
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
            phrase, a, l, r, n, score
        FROM named JOIN totals USING (lang)
        QUALIFY rank <= 2000
    """,
    "op13_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
            row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN pairs USING (anchor_id)
        WHERE NOT same AND 80::HUGEINT * positive_score <= 100::HUGEINT * score
            AND 100::HUGEINT * score <= 100::HUGEINT * positive_score
        QUALIFY rank <= 5
    """,
}
