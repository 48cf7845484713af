"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonescope.llm import (
    bpe, embeddings, language, lines, minhash, mixing, negatives, quality, tries,
    unigram, urls, warc, wordbpe,
)
from zonescope.plans.workspace import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.with_token_counts(docs, spark.sparkContext.broadcast(pieces)).drop("text")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    keyed = written(mixing.sized(docs).drop("text", "source"), "mix-sizes")
    return mixing.mix(keyed, mixing.mix_plan(keyed))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = language.held_out(F.col("doc_id"))
    model = language.fit(language.bin_counts(docs.filter(F.col("doc_id").isNotNull() & ~rest)))
    scored = language.with_language(docs, spark.sparkContext.broadcast(model))
    return scored.select("doc_id", rest.alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = written(quality.with_values(quality.measured(docs), keep=["doc_id"]), "measures")
    fences = written(quality.thresholds(written(quality.sketches(values), "sketch")), "fences")
    return quality.judged(values, fences)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return embeddings.near_vectors(vectors).withColumnRenamed("id", "vec_id")


def captures(pages: DataFrame) -> DataFrame:
    """Four captures of each page: a response, and visits that were answered in different ways.

    The second visit sends the entity tag, the third the modification time (for every fourth page
    it is a new response), the fourth the first entity tag (for every seventh page no validator).
    Urls come in different spellings.
    """
    visits = pages.withColumn("visit", F.explode(F.array(*map(F.lit, range(4)))))
    return visits.selectExpr(
        "concat(page_id, '-', visit) AS record_id",
        "1700000000 + page_id * 10 + visit * 86400 AS captured_at",
        "CASE visit WHEN 1 THEN replace(replace(url, 'http', 'HTTP'), 'example', 'Example') "
        "WHEN 2 THEN regexp_replace(regexp_replace(url, '^(http://[^/?#]*)', '$1:80'), "
        "'^(https://[^/?#]*)', '$1:443') WHEN 3 THEN concat(split_part(url, '#', 1), '#visit') "
        "ELSE url END AS url",
        "CASE WHEN visit = 0 OR visit = 2 AND page_id % 4 = 0 THEN 'response' ELSE 'revisit' END "
        "AS warc_type",
        "CASE WHEN visit = 0 OR visit = 2 AND page_id % 4 = 0 THEN 200 ELSE 304 END AS status",
        "CASE WHEN visit = 0 THEN map('ETag', md5(html), 'Last-Modified', concat('t', page_id), "
        "'Content-Length', string(length(html)), 'Date', 'd0') "
        "WHEN visit = 1 THEN map('etag', concat('W/', md5(html)), 'Content-Length', '0', "
        "'Date', 'd1') "
        "WHEN visit = 2 AND page_id % 4 = 0 THEN map('ETag', md5(concat(html, '2')), "
        "'Content-Length', string(length(html) + 1), 'Date', 'd2') "
        "WHEN visit = 2 THEN map('Last-Modified', concat('t', page_id), 'Cache-Control', 'c2') "
        "WHEN page_id % 7 = 0 THEN map('Date', 'd3') "
        "ELSE map('ETag', md5(html), 'Date', 'd3') END AS headers")


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolved_revisits(captures(table(spark, sf_dir, "pages")))
    listed = F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "canonical_url", "resolution", "refers_to",
                        F.array_join(listed, ";").alias("merged_headers"))


def bpe_vocabulary(spark: SparkSession):
    """The rank file is read on the driver; its few megabytes are broadcast."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.shared(spark, bpe.read_ranks(path, public_tokenizers.PATTERN))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, bpe_vocabulary(spark)).select("doc_id", "digest.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dropped = written(lines.dropped_lines(docs, max_edits=lines.MAX_EDITS).groupBy("id").agg(
        F.count("*").alias("n_dropped"), F.count_if("near").alias("n_near")), "dropped")
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    counted = docs.select("doc_id", F.coalesce(ends + 1, F.lit(0)).alias("n_lines"))
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return counted.join(dropped, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        count("n_dropped"), count("n_near"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, width=2).withColumnRenamed("id", "doc_id")


#: The production rules on urls: verdict, host, path.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged_urls(pages, urls.rule_table(spark, URL_RULES)).drop("url")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op12_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = wordbpe.fitted(docs, public_tokenizers.path("byte_bpe_50k.json"))
    found = wordbpe.decode(wordbpe.encode(docs, lexicon), lexicon)
    digest = lambda column: F.sha2(column, 256)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_source_mixing": op2_source_mixing,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_revisit_resolution": op6_revisit_resolution,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_transducer_bpe": op12_transducer_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}
