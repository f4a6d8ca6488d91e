"""Find benchmark items in texts within an edit budget.

Pigeonhole: an item of m characters with at most k edits, cut into k + 1 pieces,
has a piece that occurs unchanged. All pieces go into an Aho-Corasick automaton;
each piece hit gives a window of the text, which Myers' bit-parallel algorithm
searches for the item at distance k or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item.
RATE = 0.08
#: No more edits than this share would leave pieces of this length.
LEAST_PIECE = 12
#: Characters of benchmark text in one automaton; a larger benchmark is worked through in blocks of this size.
BLOCK_CHARS = 4_000_000

OUT = "doc_id long, item_id long, distance int, start int, end int"


def normalise(text: str | None) -> str:
    """Lower case, words joined by single spaces."""
    return " ".join((text or "").lower().split())


def budget(m: int) -> int:
    return max(0, min(int(m * RATE), m // LEAST_PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) of nearly equal length that make up the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int]:
    """Least distance of the pattern to any substring of text, and the end of the first such; (k + 1, -1) if over k.

    masks: for each character, the bits of its places in the pattern. Python's
    whole numbers hold patterns of any length in one word.
    """
    ones = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score, best, end = ones, 0, m, k + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (ones & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & ones
        mh = (mh << 1) & ones
        pv = mh | (ones & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


class Matcher:
    """Automaton over the pieces of one block of items [(item_id, normalised text)]."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, t in items:
            k = budget(len(t))
            masks: dict[str, int] = {}
            for i, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << i
            for at, p in pieces(t, k):
                found.setdefault(p, []).append((len(self.items), at))
            self.items.append((item_id, t, k, masks))
        self.auto = ahocorasick.Automaton()
        for p, where in found.items():
            self.auto.add_word(p, (len(p), where))
        self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of every item found, its best place in the normalised text.

        start is end less the item's length, a bound within the budget.
        """
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, int] = {}
        for last, (size, where) in self.auto.iter(text):
            for n, at in where:
                item_id, t, k, masks = self.items[n]
                if n in best and best[n][0] == 0:
                    continue
                if not k:
                    # The piece is the item; short ones must stand as whole words.
                    if (last + 1 == size or text[last - size] == " ") and text[last + 1 : last + 2] in ("", " "):
                        best[n] = (0, last + 1)
                    continue
                lo = max(0, last + 1 - size - at - k)
                # Windows of one item come in rising order; one that starts where the last started is done.
                if seen.get(n) == lo:
                    continue
                seen[n] = lo
                d, end = myers(masks, len(t), text[lo : lo + len(t) + 2 * k], k)
                if d <= k and (n not in best or d < best[n][0]):
                    best[n] = (d, lo + end)
        return [(self.items[n][0], d, max(0, e - len(self.items[n][1])), e) for n, (d, e) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, distance, start, end): each item found in each row of docs.

    Null and empty texts hold nothing; null and empty items are not looked for; an item
    too short for an edit (budget) must stand as it is, as whole words. Repeated items
    each report, repeated rows of docs each report. Either table may be empty. The
    benchmark is taken in blocks of BLOCK_CHARS, each shipped with the task that scans
    the documents, so neither driver nor task holds more.
    """
    spark = docs.sparkSession
    b = benchmark.select("item_id", "text").where("text is not null")
    out = None

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Matcher(sent.value)
            for x in batches:
                rows = [(i, *r) for i, t in zip(x["doc_id"], x["text"], strict=True) if t for r in m.matches(normalise(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "end"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        return docs.select(F.col("doc_id").cast("long"), "text").where("length(text) > 0").mapInPandas(run, OUT)

    block, size = [], 0
    for r in b.toLocalIterator():
        t = normalise(r["text"])
        if not t:
            continue
        block.append((r["item_id"], t))
        size += len(t)
        if size >= BLOCK_CHARS:
            out = scan(block) if out is None else out.union(scan(block))
            block, size = [], 0
    if block:
        out = scan(block) if out is None else out.union(scan(block))
    return out if out is not None else spark.createDataFrame([], OUT)
