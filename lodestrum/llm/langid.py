"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3, the
blended spectrum) present in both, over the root of the product of their own
numbers. N-grams of whole code points, of any script, are told apart by a hash of
SLOTS values. LANDMARKS texts span the Nyström feature space, in which one ridge
regression for each language is solved; scoring a batch is three matrix products.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Training rows leave another remainder than HELD by FOLDS.
FOLDS, HELD = 4, 2
#: Bound on the labelled texts the classifier is fitted on, all languages together.
FIT_ROWS = 2000
LANDMARKS = 192
#: Values of the hash of an n-gram.
SLOTS = 1 << 17
RIDGE = 1e-3
#: N-grams of fewer sampled texts are left out of the feature space.
LEAST_TEXTS = 2
#: Texts scored in one matrix product, and characters of a text taken apart at once.
BATCH, PIECE = 64, 1 << 18
#: Texts that pass the first cut of the sample, as a multiple of those wanted.
SPARE = 1.5
UNKNOWN = "und"


def _grams(text: str) -> Iterator[np.ndarray]:
    """Slots of the 1-, 2- and 3-grams of the whole text, piece by piece."""
    text = text.lower()
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in (1, 2, 3):
            if len(c) >= n:
                g = np.full(len(c) - n + 1, n, np.uint64)
                for k in range(n):
                    g = (g << np.uint64(21)) | c[k : len(c) - n + 1 + k]
                yield ((g * np.uint64(0x9E3779B97F4A7C15) ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Classifier:
    """grams: slots in the feature space; the rest is what fit() solved."""

    def __init__(self, grams: np.ndarray, marks: np.ndarray, norms: np.ndarray, weights: np.ndarray, langs: list[str]):
        self.grams, self.marks, self.norms, self.weights, self.langs = grams, marks, norms, weights, langs
        self.slot = np.full(SLOTS, len(grams), np.int32)
        self.slot[grams] = np.arange(len(grams), dtype=np.int32)

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        for row, t in zip(out, texts, strict=True):
            for g in _grams(t):
                row[self.slot[g]] = 1
        return out[:, :-1]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share of the best response among softened responses."""
        x = self.presence(texts)
        k = (x @ self.marks.T) / (np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * self.norms)
        r = k @ self.weights
        e = np.exp(4 * (r - r.max(axis=1, keepdims=True)))
        best = r.argmax(axis=1)
        return [self.langs[i] for i in best], (e[np.arange(len(r)), best] / e.sum(axis=1)).astype(float)


def sample(docs: DataFrame) -> DataFrame:
    """Rows (lang, text): of each language's distinct training texts those of smallest hash, FIT_ROWS at most in all.

    The languages share FIT_ROWS equally; beyond FIT_ROWS languages the commonest count. A
    cut by hash, set from an estimate of how many distinct texts there are, comes
    before any grouping, so no language, text or id that fills the table gathers in one task.
    """
    top = (1 << 63) - 1
    train = docs.where((C.crc_mod(F.col("doc_id"), FOLDS) != HELD) & F.col("lang").isNotNull() & F.coalesce(F.length("text") > 0, F.lit(False)))
    train = train.select("lang", "text", F.xxhash64("lang", "text").bitwiseAND(F.lit(top)).alias("h"))
    n = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(FIT_ROWS).collect()}
    if not n:
        return train.limit(0).select("lang", "text")
    each = max(1, FIT_ROWS // len(n))
    # A few texts of a language are all taken; of many, SPARE times as many as wanted pass.
    cut = {lang: top if m <= 8 * each else int(SPARE * each / m * top) for lang, m in n.items()}
    below = F.element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), F.col("lang"))
    few = train.where(F.col("h") <= F.coalesce(below, F.lit(-1))).groupBy("lang", "h").agg(F.first("text").alias("text"))
    return few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= each).select("lang", "text")


def fit(docs: DataFrame) -> Classifier | None:
    """Fit on the sample; None if no labelled text has a letter.

    Executors turn the sampled texts into sets of n-grams, SLOTS bits each, and those are what the driver gathers.
    """

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[has_letter(t) for t in b["text"]]]
            yield pd.DataFrame({"lang": b["lang"], "g": [packed(t) for t in b["text"]]})

    rows = [(r["lang"], bytes(r["g"])) for r in sample(docs).mapInPandas(sets, "lang string, g binary").collect()]
    return solve(sorted(rows)) if rows else None


def packed(text: str) -> bytes:
    """Presence of every slot, a bit each."""
    held = np.zeros(SLOTS, bool)
    for g in _grams(text):
        held[g] = True
    return np.packbits(held).tobytes()


def solve(rows: list[tuple[str, bytes]]) -> Classifier:
    """Ridge regression of rows (lang, presence) over the landmarks' feature space."""
    bits = np.frombuffer(b"".join(g for _, g in rows), np.uint8).reshape(len(rows), -1)
    langs = sorted({lang for lang, _ in rows})
    # The presence matrix is unpacked a few rows at a time.
    unpacked = lambda at: np.unpackbits(bits[at : at + BATCH], axis=1)
    n = sum(unpacked(at).sum(axis=0, dtype=np.int32) for at in range(0, len(rows), BATCH))
    grams = np.flatnonzero(n >= LEAST_TEXTS) if (n >= LEAST_TEXTS).any() else np.flatnonzero(n)
    # Landmarks in turn from each language, in order of the rows.
    seen: Counter = Counter()
    turn = []
    for i, (lang, _) in enumerate(rows):
        turn.append((seen[lang], lang, i))
        seen[lang] += 1
    marks = sorted(i for *_, i in sorted(turn)[:LANDMARKS])
    m = np.unpackbits(bits[marks], axis=1)[:, grams].astype(np.float32)
    mn = np.sqrt(np.maximum(m.sum(axis=1), 1))
    kernel, norm = [], []
    for at in range(0, len(rows), BATCH):
        x = unpacked(at)[:, grams].astype(np.float32)
        norm.append(np.sqrt(np.maximum(x.sum(axis=1), 1)))
        kernel.append(x @ m.T / np.outer(norm[-1], mn))
    own, vec = np.linalg.eigh((m @ m.T / np.outer(mn, mn)).astype(float))
    keep = own > 1e-6 * own.max()
    root = vec[:, keep] / np.sqrt(own[keep])
    z = np.concatenate(kernel) @ root
    y = np.array([[1.0 if own_lang == lang else -1.0 for lang in langs] for own_lang, _ in rows])
    w = np.linalg.solve(z.T @ z + RIDGE * len(rows) * np.eye(z.shape[1]), z.T @ y)
    return Classifier(grams, m, mn, (root @ w).astype(np.float32), langs)


def identify(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score.

    Without a model one is fitted on docs' own training rows. A null text, or one
    with no letter, is `und` with score 0, as is every text if there is nothing to
    learn from. Only the text enters a prediction. Repeated rows each get a row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["lang"] if "lang" in docs.columns else []))
    model = model or fit(docs)
    parts = model and (model.grams, np.packbits(model.marks.astype(bool), axis=1), model.norms, model.weights, model.langs)
    sent = docs.sparkSession.sparkContext.broadcast(parts)  # LANDMARKS bits for each n-gram of the bounded sample
    out = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = None
        if sent.value:
            p = list(sent.value)
            p[1] = np.unpackbits(p[1], axis=1, count=len(p[0])).astype(np.float32)
            m = Classifier(*p)
        for b in batches:
            lang, score = [UNKNOWN] * len(b), np.zeros(len(b))
            own = [i for i, t in enumerate(b["text"]) if m and has_letter(t)]
            for at in range(0, len(own), BATCH):
                part = own[at : at + BATCH]
                names, s = m.predict([b["text"].iloc[i] for i in part])
                score[part] = s
                for i, x in zip(part, names, strict=True):
                    lang[i] = x
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": lang, "score": score})

    return docs.select("doc_id", (C.crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "text").mapInPandas(run, out)
