"""Likelihood of texts under a subword lattice.

The pieces of an existing vocabulary cover every word in many ways; the model gives
a word the sum over all of them, by a forward recursion in log space. Piece
weights start from the vocabulary's own scores and take one round of
expectation-maximisation over all distinct words of the training documents,
each weighted by its count. Words and ends are independent, so the probability
of a text is the product of its words' and of one end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Share of training: documents whose crc32 of the id leaves another remainder than HELD by FOLDS.
FOLDS, HELD = 5, 1
#: The most frequent words, shipped to every task; all others are looked up by a join.
HEAD_WORDS = 200_000
#: Probability that the prior gives to all byte pieces together, which any character can fall back on.
BYTE_MASS = 1e-4
#: Weight of the prior, in pieces, against the counts expected from the corpus.
PRIOR_PIECES = 1e5
#: Zipf-Mandelbrot shift by which the vocabulary's rank scores become weights.
SHIFT = 10.0
#: Characters with a column in the transition table; words with others, or longer than LONG, take the plain path.
COLUMNS, LONG = 192, 40
MARK = "▁"
#: Stands for the end of a text among the words; no word holds a space.
END = " "


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Pieces and the log weights that their scores give (natural log, summing to 1); bytes come first, in order."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
    pieces, score = [], []
    for i in range(p.get_piece_size()):
        if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)) and MARK not in p.id_to_piece(i)[1:]:
            pieces.append(p.id_to_piece(i))
            score.append(p.get_score(i))
    # The scores are ranks below zero; weight falls as the inverse of the rank.
    w = 1 / (SHIFT - np.maximum(np.array(score), -1e6))
    w = (1 - BYTE_MASS) * w / w.sum()
    return [f"<0x{b:02X}>" for b in range(256)] + pieces, np.log(np.r_[np.full(256, BYTE_MASS / 256), w])


class Lattice:
    """Forward and backward recursion over all segmentations of words into pieces."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.logp = logp
        own = {}
        for n, p in enumerate(pieces[256:], 256):
            own[p] = n
        count: dict[str, int] = {}
        for p in own:
            for c in p:
                count[c] = count.get(c, 0) + 1
        chars = sorted(count, key=lambda c: (-count[c], c))[:COLUMNS]
        self.column = {c: i for i, c in enumerate(chars)}
        # Trie as a dense table: node 0 is dead, node 1 the root.
        child: list[dict[str, int]] = [{}, {}]
        piece = [-1, -1]
        for p, n in own.items():
            at = 1
            for c in p:
                if c not in child[at]:
                    child[at][c] = len(child)
                    child.append({})
                    piece.append(-1)
                at = child[at][c]
            piece[at] = n
        self.child, self.piece = child, np.array(piece)
        self.table = np.zeros((len(child), len(chars)), np.int32)
        for at, kids in enumerate(child):
            for c, to in kids.items():
                if c in self.column:
                    self.table[at, self.column[c]] = to
        self.weight = np.where(self.piece >= 0, logp[self.piece], -np.inf)
        self.bytes = {c: self._bytes(c) for c in chars}
        self.fall = np.array([self.bytes[c] for c in chars])

    def _bytes(self, c: str) -> float:
        return float(sum(self.logp[b] for b in c.encode("utf-8", "surrogatepass")))

    def _arcs(self, w: str) -> Iterator[tuple[int, int, float, int]]:
        """(from, to, log weight, piece or -1 for bytes), from left to right."""
        for i in range(len(w)):
            yield i, i + 1, self._bytes(w[i]), -1
            at = 1
            for j in range(i, len(w)):
                at = self.child[at].get(w[j], 0)
                if not at:
                    break
                if self.piece[at] >= 0:
                    yield i, j + 1, self.weight[at], int(self.piece[at])

    def plain(self, word: str) -> float:
        """Natural log probability of one word, by the plain recursion."""
        w = MARK + word
        a = [-math.inf] * (len(w) + 1)
        a[0] = 0.0
        for i, j, lp, _ in self._arcs(w):
            x, y = a[j], a[i] + lp
            hi = max(x, y)
            a[j] = hi if hi == -math.inf else hi + math.log1p(math.exp(min(x, y) - hi))
        return a[-1]

    def _plain_expected(self, word: str, weight: float, into: np.ndarray) -> None:
        w = MARK + word
        arcs = list(self._arcs(w))
        a, b = [-math.inf] * (len(w) + 1), [-math.inf] * (len(w) + 1)
        a[0], b[-1] = 0.0, 0.0
        for i, j, lp, _ in arcs:
            a[j] = float(np.logaddexp(a[j], a[i] + lp))
        for i, j, lp, _ in sorted(arcs, key=lambda x: -x[0]):
            b[i] = float(np.logaddexp(b[i], b[j] + lp))
        for i, j, lp, n in arcs:
            if n >= 0:
                into[n] += weight * math.exp(a[i] + lp + b[j] - a[-1])

    def _arcs_of(self, cols: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """From place i of words of one length: (to, rows, log weights, pieces)."""
        n, size = cols.shape
        yield i + 1, np.arange(n), self.fall[cols[:, i]], np.full(n, -1)
        rows, node = np.arange(n), np.ones(n, np.int64)
        for j in range(i, size):
            node = self.table[node, cols[rows, j]]
            alive = node > 0
            rows, node = rows[alive], node[alive]
            if not len(rows):
                return
            held = self.piece[node] >= 0
            if held.any():
                yield j + 1, rows[held], self.weight[node[held]], self.piece[node[held]]

    def words(self, words: list[str], weights: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """Natural log probabilities; with weights, expected counts of pieces are added to into."""
        out = np.empty(len(words))
        groups: dict[int, list[int]] = {}
        column = self.column
        codes: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            size = len(w) + 1
            c = [column.get(x, -1) for x in MARK + w] if size <= LONG else [-1]
            if min(c) < 0:
                out[n] = self.plain(w)
                if into is not None:
                    self._plain_expected(w, float(weights[n]), into)
            else:
                groups.setdefault(size, []).append(n)
                codes.setdefault(size, []).append(c)
        for size, own in groups.items():
            cols, at = np.array(codes[size]), np.array(own)
            a = np.full((len(own), size + 1), -np.inf)
            a[:, 0] = 0
            arcs = []
            for i in range(size):
                for j, rows, lp, pc in self._arcs_of(cols, i):
                    a[rows, j] = np.logaddexp(a[rows, j], a[rows, i] + lp)
                    if into is not None:
                        arcs.append((i, j, rows, lp, pc))
            out[at] = a[:, size]
            if into is not None:
                b = np.full((len(own), size + 1), -np.inf)
                b[:, size] = 0
                for i, j, rows, lp, pc in reversed(arcs):
                    b[rows, i] = np.logaddexp(b[rows, i], b[rows, j] + lp)
                for i, j, rows, lp, pc in arcs:
                    if pc[0] >= 0:
                        mass = np.exp(a[rows, i] + lp + b[rows, j] - a[rows, size]) * weights[at[rows]]
                        into += np.bincount(pc, mass, len(into))
        return out


def lower(text):
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, c): every word of all rows of docs, with its count in training rows (0: only held out)."""
    w = docs.select(F.explode(C.words(lower(F.col("text")))).alias("word"), (C.crc_mod(F.col("doc_id"), FOLDS) != HELD).alias("train"))
    return w.groupBy("word").agg(F.sum(F.col("train").cast("long")).alias("c"))


def fit(counts: DataFrame, ends: int, path: str | None = None) -> tuple[list[str], np.ndarray, float]:
    """Pieces, their log weights after one round over all training words, and the log weight of an end.

    What comes to the driver is one number for each piece of the vocabulary.
    """
    pieces, prior = vocabulary(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, into = Lattice(*vocabulary(path)), np.zeros(len(pieces))
        for b in batches:
            for at in range(0, len(b), 20_000):
                lattice.words(list(b["word"].iloc[at : at + 20_000]), b["c"].to_numpy(float)[at : at + 20_000], into)
        n = np.flatnonzero(into)
        yield pd.DataFrame({"piece": n.astype(np.int32), "n": into[n]})

    rows = counts.where("c > 0").mapInPandas(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(len(pieces))
    for r in rows:
        seen[r["piece"]] = r["n"]
    seen += PRIOR_PIECES * np.exp(prior)
    total = seen.sum() + ends + 0.5
    return pieces, np.log(seen / total), math.log((ends + 0.5) / total)


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Words are lowered (A-Z) and taken whole from the whole text; a null text is
    empty and has the end as its one token. The HEAD_WORDS most frequent words are
    sent to the tasks, all others joined by word, so no vocabulary is held whole
    anywhere. Without training rows all counts are zero. Repeated rows count, and are
    scored, as often as they occur.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = C.table(word_counts(docs), "words")
    held = C.crc_mod(F.col("doc_id"), FOLDS) == HELD
    ends = docs.select((~held).cast("long").alias("t")).agg(F.sum("t")).first()[0] or 0
    n, v = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    total, distinct = (n or 0) + ends, (v or 0) + (ends > 0)
    pieces, logp, end = fit(counts, ends, path)
    model = spark.sparkContext.broadcast((pieces, logp))  # as large as the vocabulary file
    floor = math.log10(total + 0.5 * (distinct + 1))
    base = lambda c: np.log10(c + 0.5) - floor

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*model.value)
        for b in batches:
            for at in range(0, len(b), 20_000):
                x = b.iloc[at : at + 20_000]
                yield pd.DataFrame({"word": x["word"], "base": base(x["c"].to_numpy(float)), "lp": lattice.words(list(x["word"])) / math.log(10), "known": (x["c"] > 0).astype(np.int32)})

    weighed = C.table(counts.select("word", "c").mapInPandas(weigh, "word string, base double, lp double, known int"), "weighed")
    least, above = 0, 0
    for r in counts.where("c > 0").groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():  # distinct counts: few
        least, above = r["c"], above + r["count"]
        if above >= HEAD_WORDS:
            break
    else:
        least = 0
    # At most HEAD_WORDS have a count above the least; ties at it are left to the join.
    most_base = float(base(np.array(float(least))))
    top = {r["word"]: (r["base"], r["lp"]) for r in weighed.where(F.col("base") > most_base + 1e-12).toLocalIterator()}
    head = spark.sparkContext.broadcast(top)
    e = (float(base(np.array(float(ends)))), end / math.log(10), int(ends > 0))
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, lp double, rest array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = head.value.get
        for b in batches:
            rows = []
            for row, i, t in zip(b["row"], b["doc_id"], b["text"], strict=True):
                w = (t or "").encode("utf-8").lower().decode("utf-8")
                w = w.translate(ODD).split(" ") if t else []
                found, rest = [], []
                n = 0
                for x in w:
                    if x:
                        n += 1
                        if (y := get(x)) is None:
                            rest.append(x)
                        else:
                            found.append(y)
                a = np.array(found, float).reshape(-1, 2).sum(axis=0)
                rows.append((row, i, n + 1, len(found) + e[2], a[0] + e[0], a[1] + e[1], rest))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "n_tokens", "n_known", "base", "lp", "rest"]).astype({"doc_id": "Int64"})

    part = C.table(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInPandas(run, schema), "scored")
    rest = part.select("row", F.explode("rest").alias("word")).join(weighed, "word").groupBy("row").agg(F.sum("base").alias("b"), F.sum("lp").alias("l"), F.sum("known").alias("k"))
    out = part.drop("rest").join(rest, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("lp") + zero("l")).alias("score"),
    )


#: White space of the contract other than the space.
ODD = {i: " " for i in range(9, 14)}
