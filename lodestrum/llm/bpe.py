"""Byte-pair encoding with word ends, by a contiguous array of adjacent ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No merge.
NONE = 1 << 60
#: Words kept with their encoding in one worker, and the longest such word; others are encoded anew each time.
CACHE_WORDS, CACHE_CHARS = 250_000, 40
#: Symbols above which a word is merged with a heap instead of repeated scans.
LONG = 256


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b], n = chr(n), n + 1
    return [table[b] for b in range(256)]


class WordBpe:
    """Encodes and decodes as the vocabulary file's own library does, without special tokens added.

    The text is cut at the file's added tokens; what lies between is composed
    (NFC), white space is folded, letters are lowered, and words are found by the
    file's pattern. A token's text is its string in the file.
    """

    def __init__(self, path: str | None = None):
        import regex

        with open(path or vocabulary_path(), encoding="utf-8") as f:
            d = json.load(f)
        vocab, self.end = d["model"]["vocab"], d["model"]["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for n, (a, b) in enumerate(d["model"]["merges"]):
            self.rank.setdefault(vocab[a] << 20 | vocab[b], n)
            self.made.append(vocab[a + b])
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        chars = byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars]
        self.kept: dict[str, tuple[int, bytes, str]] = {}
        # Characters that Python's split() takes for space and the pattern does not.
        self.odd = re.compile("[\x1c-\x1f]").search
        self.spaces = regex.compile(r"\s+").split

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if len(ids) > LONG:
            return self._long(ids)
        rank, made = self.rank.get, self.made
        # ids holds the parts between boundaries; ranks[i] is that of the boundary after part i.
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order for a word of any length."""
        n, rank = len(ids), self.rank.get
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or rank(ids[i] << 20 | ids[j], NONE) != r:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (s := rank(ids[i] << 20 | ids[after[i]], NONE)) != NONE:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := rank(ids[before[i]] << 20 | ids[i], NONE)) != NONE:
                heapq.heappush(heap, (s, before[i]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def chunk(self, chunk: str) -> tuple[int, bytes, str]:
        """(number of ids, ids packed, decoded text) of what stands between spaces."""
        found = self.kept.get(chunk)
        if found is None:
            ids = [i for w in self.find(chunk) for i in self.word(w)]
            found = (len(ids), b"".join(i.to_bytes(4, "little") for i in ids), " ".join([self.token[i] for i in ids]))
            if len(self.kept) < CACHE_WORDS and len(chunk) <= CACHE_CHARS:
                self.kept[chunk] = found
        return found

    def chunks(self, text: str) -> Iterator[tuple[int, bytes, str]]:
        for part in self.cut(text) if "<|" in text else (text,):
            if part in self.added:
                i = self.added[part]
                yield 1, i.to_bytes(4, "little"), part
            elif part:
                part = unicodedata.normalize("NFC", part)
                # Lowered letter by letter: no final form of sigma.
                part = part.replace("Σ", "σ").lower()
                for c in self.spaces(part) if self.odd(part) else part.split():
                    if c and (found := self.chunk(c))[0]:
                        yield found

    def encode(self, text: str | None) -> list[int]:
        raw = b"".join(x[1] for x in self.chunks(text or ""))
        return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)


def encode_decode(docs: DataFrame, path: str | None = None, outputs: bool = True) -> DataFrame:
    """Per row of docs: doc_id, ids (packed as unsigned little-endian 32-bit), decoded, n_tokens and both digests.

    A null text counts as empty: no ids, digests of nothing. Without outputs the
    ids and the decoded text are left out. Other columns are not looked at. path
    is the vocabulary's place, which every executor has.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * outputs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(path)
        for b in batches:
            for at in range(0, len(b), 500):
                rows = []
                for i, t in zip(b["doc_id"].iloc[at : at + 500], b["text"].iloc[at : at + 500], strict=True):
                    found = list(bpe.chunks(t or ""))
                    ids, text = b"".join([x[1] for x in found]), " ".join([x[2] for x in found])
                    rows.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest(), *((ids, text) if outputs else ())))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)
