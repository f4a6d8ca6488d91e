"""Delete later copies of repeated runs of lines, by a suffix array over line ids.

The sequence is every text's lines that hold a word, text after text in the order
of doc_id. Distributed prefix doubling ranks the suffixes: rank 0 orders them by
their first line, and each round ranks pairs (rank here, rank 2^k lines on), the
rank being the place where the class begins in the suffix array. Only classes of
two or more suffixes go on. All suffixes that share a prefix of n lines form one
LCP interval, which two overlapping ranks of 2^k <= n name exactly. The runs
looked up are, for each line, the shortest ones of MIN_WORDS words that begin or
end there; the union of those that occurred before is the union of all maximal
repeated runs of so many words, so no maximal run is lost or cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Least words of a run that counts as a repeat.
MIN_WORDS = 50
#: Rows whose texts are taken apart at once.
SLICE = 500
LINE = "rid long, doc_id long, seq int, h1 long, h2 long, fore int, back int"


def runs_of(counts: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """From the words of each line: the lines of the shortest run of min_words that begins there, and that ends there (0: none)."""
    n = len(counts)
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=upto[1:])
    end = np.searchsorted(upto, upto[:-1] + min_words)
    start = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    at = np.arange(n)
    return np.where(end <= n, end - at, 0), np.where(start >= 0, at + 1 - start, 0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, SLICE at a time, so that a worker holds the objects of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with a word; the table is built once for many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in _slices(batches):
            sizes, digests, fore, back, seq = [], [], [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                counts = []
                for x in t.split(b"\n") if t else ():
                    if w := len(x.split()):
                        counts.append(w)
                        digests.append(xxh3_128_digest(x))
                sizes.append(len(counts))
                if counts:
                    f, e = runs_of(counts, min_words)
                    fore.append(f)
                    back.append(e)
                    seq.append(np.arange(len(counts)))
            if digests:
                h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                own = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                ints = [np.concatenate(x).astype(np.int32) for x in (seq, fore, back)]
                columns = [b.column("rid").take(own), b.column("doc_id").take(own), ints[0], np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), ints[1], ints[2]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=LINE.replace(",", "").split()[::2])

    return docs.mapInArrow(run, LINE)


def suffix_ranks(rows: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Rank the classes (a, b) that hold two rows or more: columns a, b, rank; and the table to drop when that has been read.

    rank is the number of suffixes in lesser classes, the start of the class's
    interval. The classes are range-partitioned and sorted; each task adds up
    its own, and the tasks' totals (a number each) shift the rest.
    """
    n = rows.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for x in batches:
            size = x.column("n").to_numpy()
            upto = np.cumsum(size) + before
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(upto - size)], names=[*x.schema.names, "rank"])
            before = int(upto[-1]) if len(upto) else before

    d = n.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn("part", F.spark_partition_id())
    held = C.table(d.mapInArrow(place, f"{a} long, {b} long, n long, part int, rank long"), "ranks")
    shift, total = {}, 0
    for r in held.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each task
        shift[r["part"]], total = total, total + r["n"]
    d = held
    if len(shift) > 1:
        add = d.sparkSession.createDataFrame(list(shift.items()), "part int, shift long")
        d = d.join(F.broadcast(add), "part").withColumn("rank", F.col("rank") + F.col("shift"))
    return d.select(a, b, "rank"), held


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (rid, seq, size): runs of lines that occurred before, by (doc_id, rid, line).

    docs: rid (long, distinct), doc_id, text. Runs may overlap; in a text that
    repeats one run back to back, each copy after the first is a later one.
    """
    lines = C.table(_lines(docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words), "lines")
    ranks, held = suffix_ranks(lines, "h1", "h2")
    step = C.table(lines.join(ranks, ["h1", "h2"]).select("rid", "seq", "rank"), "suffixes")
    C.drop(held)
    read = [lines, step]
    want = lines.select("rid", "doc_id", F.explode(F.array_distinct(F.array(F.struct(F.col("seq"), F.col("fore").alias("size")), F.struct((F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("size"))))).alias("x"))
    want = want.select("rid", "doc_id", "x.seq", "x.size").where("size > 0").distinct()
    found, k = None, 0
    while True:
        wide = 1 << k
        w = want.where((F.col("size") >= wide) & (F.col("size") < 2 * wide))
        w = w.join(step, ["rid", "seq"]).withColumn("next", F.col("seq") + F.col("size") - wide)
        w = w.join(step.select("rid", F.col("seq").alias("next"), F.col("rank").alias("tail")), ["rid", "next"])
        w = w.select("rid", "doc_id", "seq", "size", "rank", "tail")
        found = w if found is None else found.unionByName(w)
        if 2 * wide > min_words:
            break
        pair = step.join(step.select("rid", (F.col("seq") - wide).alias("seq"), F.col("rank").alias("tail")), ["rid", "seq"])
        pair = C.table(pair.select("rid", "seq", F.col("rank").alias("head"), "tail"), "pairs")
        ranks, held = suffix_ranks(pair, "head", "tail")
        step = C.table(pair.join(ranks, ["head", "tail"]).select("rid", "seq", "rank"), "suffixes")
        read.append(step)
        C.drop(held)
        C.drop(pair)
        k += 1
        if step.isEmpty():
            break
    found = C.table(found, "runs")
    for t in read:
        C.drop(t)
    place = F.struct("doc_id", "rid", "seq")
    # A table of its own, so that a class of very many runs can be split in the join.
    first = found.groupBy("size", "rank", "tail").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = C.table(first, "first-runs")
    return found.join(first, ["size", "rank", "tail"]).where(place != F.col("first")).select("rid", "seq", F.col("size").cast("int").alias("size"))


def delete_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """docs with later copies of repeated runs deleted from text, plus n_lines and n_deleted.

    Columns of docs are kept, whatever their names; where docs has an n_lines or n_deleted
    of its own, ours gets as many "_" before it as make it new. n_lines counts
    lines with a word. Lines that stay, blank ones too, stay as they were. A null
    text stays null. Texts are taken by doc_id, so a repeated row is a later copy
    and loses its runs; runs under min_words words stay. A text whose lines
    were all deleted stays with no line, or its row goes if drop_emptied.
    """
    own = docs.columns
    d, names = C.renamed(docs)
    text, doc_id = names[own.index("text")], names[own.index("doc_id")]
    d = C.table(d.withColumn("rid", F.monotonically_increasing_id()), "texts")
    runs = repeated_runs(d.select("rid", F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), min_words)
    # Groups of one row of docs: at most two runs for each of its lines.
    runs = runs.groupBy("rid").agg(F.collect_list(F.struct("seq", "size")).alias("runs"))
    j = d.join(runs, "rid", "left")
    out = d.drop("rid").schema.add("n_lines", "integer").add("n_deleted", "integer")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts, n, gone = [], [], []
            for t, runs in zip(b.column(text).cast(pa.binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                held = [i for i, x in enumerate(lines) if x and (x[0] > 32 or x.split())]
                dead: set[int] = set()
                for r in runs or ():
                    dead.update(held[r["seq"] : r["seq"] + r["size"]])
                texts.append(b"\n".join([x for i, x in enumerate(lines) if i not in dead]) if dead else t)
                n.append(len(held))
                gone.append(len(dead))
            n, gone = np.array(n, np.int32), np.array(gone, np.int32)
            made = {text: pa.array(texts, pa.binary()).view(pa.string()), "n_lines": pa.array(n), "n_deleted": pa.array(gone)}
            b = pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in out.names], names=out.names)
            yield b.filter(pa.array((gone == 0) | (gone < n))) if drop_emptied else b

    counts = []
    for c in ("n_lines", "n_deleted"):
        while c in {x.lower() for x in own}:
            c = f"_{c}"
        counts.append(c)
    return j.mapInArrow(cut, out).toDF(*own, *counts)
