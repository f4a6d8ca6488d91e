"""A text corpus put through five stages; each reads what the one before has written."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrum.llm import bpe, decontaminate, linededup, quality, simhash
from lodestrum.llm import common as C

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """work, before which the tables that the stage before it left in the shared folder are removed: its result has been written by then."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.release(_left.pop(threading.get_ident(), []), docs)
        with C.noted() as made:
            out = work(spark, docs, sf_dir)
        _left[threading.get_ident()] = made
        return out

    return run_stage


_left: dict[int, list[str]] = {}


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    d, names = C.renamed(docs)
    looked_at = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "lang", "source", "text")}
    kept = quality.quality_rules(d.withColumns(looked_at), names).where("kept")
    return kept.select(*names).toDF(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; a text of nothing else goes. n_chars follows the text."""
    out = linededup.delete_repeated_runs(docs, drop_emptied=True)
    chars = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns(chars).select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near copies."""
    return simhash.keep_one(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose own text no benchmark item occurs within the edit budget, whatever ids are null or repeat."""
    # The verdict is a function of the text alone, so its hash is the key.
    hit = decontaminate.contaminated(docs.select(F.xxhash64("text").alias("doc_id"), "text"), C.read(spark, sf_dir, "benchmark"))
    hit = hit.select(F.col("doc_id").alias("hit")).distinct()
    return docs.join(hit, F.xxhash64(docs["text"]) == hit["hit"], "left_anti")


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and decoded text."""
    return bpe.encode_decode(docs).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encode),
]

#: Suffix arrays, fingerprints, edit distances and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = C.table(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
