"""The registered queries of the corpus operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm import collocations, decontaminate, htmlmain, langid, licenses, mixing, neardup, periodic, substring_dedup, tokencount, tokenfile, topk, urlfilter
from evalgrid.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents")).drop("sign")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


#: Rules of the URL query.
RULES = [
    urlfilter.Rule("com", "/en/", "block"),
    urlfilter.Rule("example.com", "/en/7", "allow"),
    urlfilter.Rule("net", "/de/", "allow"),
    urlfilter.Rule("example.net", "/de/8", "block"),
    urlfilter.Rule("org", "/es/", "block"),
]
#: Named domains that are listed. Besides them the query lists the hosts of the corpus whose md5 begins with these digits (1 in 16), so the list grows with the corpus as a real one does.
LISTED = ["ads-track.example.org", "casino-win.example.org", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org"]
LISTED_MD5 = "0"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(urlfilter.host_and_path(F.col("url"))[0].alias("key")).where(F.col("key") != "").distinct()
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string").unionByName(hosts.where(F.startswith(F.md5(F.col("key")), F.lit(LISTED_MD5))))
    return urlfilter.judge(pages, RULES, listed)


#: Shares of all tokens that the mixture's domains are to have, far from the corpus's own (some 0.8, 0.1, 0.1): a mixture for training a quality filter.
SHARES = {"plain": 0.6, "poor": 0.2, "toxic": 0.2}
#: Tokens of the mixture for each token of the corpus; at these shares no plain document has to go.
BUDGET = 2.0


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mixed(docs, _table(spark, sf_dir, "labels"), SHARES, BUDGET, with_text=False)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.component_table(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_texts(_table(spark, sf_dir, "pages"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = tokenfile.write_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_documents(spark, files)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(_table(spark, sf_dir, "documents"), planted=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filters": op2_url_filters,
    "op3_mixing": op3_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_collocations": op11_collocations,
    "op12_token_files": op12_token_files,
    "op13_periodic_runs": op13_periodic_runs,
}
