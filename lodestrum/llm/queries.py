"""Queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import bpe, decontaminate, langid, lattice, licenses, linededup, quality, secrets, simhash, surrogates


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(C.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(C.read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(C.read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(C.read(spark, sf_dir, "documents")).drop("matches")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.delete_repeated_runs(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(C.read(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(C.read(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(C.read(spark, sf_dir, "documents"), outputs=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(C.read(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_rules,
    op2_lattice_scoring,
    op3_language_id,
    op4_license_scan,
    op5_line_dedup,
    op6_secret_scan,
    op7_pii_surrogates,
    op8_benchmark_decontamination,
    op9_bpe_encoding,
    op10_simhash,
)
QUERIES = {f.__name__: f for f in _ALL}
#: Digest and table lookups by hash (XXH64, CRC-32), automata and merges have no SQL form; those are tested against brute force.
ORACLES: dict[str, str] = {}
