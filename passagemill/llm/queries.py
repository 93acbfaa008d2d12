"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import centroids, linededup, merkle, ngramjoin, secrets, substrings
from passagemill.llm.centroids import op11_centroid_clustering
from passagemill.llm.common import table
from passagemill.llm.linededup import op3_line_dedup
from passagemill.llm.decontaminate import op2_benchmark_decontamination
from passagemill.llm.fingerprints import op8_document_fingerprints
from passagemill.llm.htmltext import op5_html_extraction
from passagemill.llm.merkle import op12_merkle_manifest
from passagemill.llm.ngramjoin import op13_ngram_jaccard_join
from passagemill.llm.packing import op4_best_fit_packing
from passagemill.llm.quality import op7_quality_classifier
from passagemill.llm.secrets import op6_secret_scan
from passagemill.llm.simhash import near_duplicates
from passagemill.llm.substrings import dedup_passages
from passagemill.llm.toxicity import op10_toxicity


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document that stay when repeated passages go."""
    return dedup_passages(table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

ORACLES = {
    "op3_line_dedup": linededup.SQL,
    "op6_secret_scan": secrets.SQL,
    "op9_substring_dedup": substrings.SQL,
    "op11_centroid_clustering": centroids.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_ngram_jaccard_join": ngramjoin.SQL,
}
