"""The ``opN_<name>`` queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import common, language_mixture, maxscore, mixture_packing, periodic_runs, pii_crf, simhash_pivot, string_tiling, suffix_columns, trie_counts, url_digest, weak_labels, window_panes
from lodestone.llm.compression_bands import compression_bands


def op1_simhash_pivot(spark, sf_dir):
    return simhash_pivot.near_duplicates(common.table(spark, sf_dir, "documents"), shingle=simhash_pivot.SHINGLE, radius=simhash_pivot.RADIUS)


def op2_suffix_columns(spark, sf_dir):
    found = suffix_columns.remove_repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_compression_bands(spark, sf_dir):
    return compression_bands(common.table(spark, sf_dir, "documents"))


def op4_url_digest(spark, sf_dir):
    return url_digest.url_filter(common.table(spark, sf_dir, "pages"))


def op5_language_mixture(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    model = language_mixture.train(docs.where(~language_mixture.is_held_out(F.col("doc_id"))))
    found = language_mixture.identify(docs, model)
    return found.select("doc_id", language_mixture.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_string_tiling(spark, sf_dir):
    found = string_tiling.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles", "longest")


def op7_weak_labels(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    _, scorer = weak_labels.train(docs, common.table(spark, sf_dir, "labels"))
    found = weak_labels.score(docs, scorer)
    return found.select("doc_id", F.round("quality", 6).alias("quality"), F.round("toxicity", 6).alias("toxicity"), "kept")


def op8_mixture_packing(spark, sf_dir):
    return mixture_packing.pack(common.table(spark, sf_dir, "documents"), weights=mixture_packing.EVEN)


def op9_trie_counts(spark, sf_dir):
    return trie_counts.token_counts(common.table(spark, sf_dir, "documents"))


def op10_pii_crf(spark, sf_dir):
    return pii_crf.digest(pii_crf.find_pii(common.table(spark, sf_dir, "documents")))


def op11_window_panes(spark, sf_dir):
    return window_panes.revisions(common.table(spark, sf_dir, "clicks"))


def op12_periodic_runs(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    woven = docs.select("doc_id", periodic_runs.woven(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic_runs.digest(periodic_runs.find_runs(woven))


def op13_maxscore(spark, sf_dir):
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", maxscore.weights(F.col("embedding")).alias("weights"))
    return maxscore.search(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_simhash_pivot": op1_simhash_pivot,
    "op2_suffix_columns": op2_suffix_columns,
    "op3_compression_bands": op3_compression_bands,
    "op4_url_digest": op4_url_digest,
    "op5_language_mixture": op5_language_mixture,
    "op6_string_tiling": op6_string_tiling,
    "op7_weak_labels": op7_weak_labels,
    "op8_mixture_packing": op8_mixture_packing,
    "op9_trie_counts": op9_trie_counts,
    "op10_pii_crf": op10_pii_crf,
    "op11_window_panes": op11_window_panes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_maxscore": op13_maxscore,
}
ORACLES = {"op4_url_digest": url_digest.oracle(), "op11_window_panes": window_panes.oracle(), "op13_maxscore": maxscore.oracle()}
