"""SimHash fingerprints and exact links within a few bits by a Gray-order index.

Fingerprints that differ in at most MAX_DIFF = 3 bits agree wholly in one of
four 16-bit bands, so each distinct fingerprint is dealt out once for each band,
by (band, value). Within such a group a hierarchical index is built: the
fingerprints are sorted by Gray rank, runs of FAN neighbours share a node that
holds the bits all of them agree in (mask and pattern), nodes are grouped again
up to one root, and a search adds up the differences in the bits that each level
fixes and drops a whole node once they exceed the limit.
A band value held by more than HOT fingerprints is dealt out again by four
12-bit bands of the other 48 bits, which again loses no link.

keep_one looks for texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. The index links those whose fingerprints are nearly
equal; what lies beyond its reach is found by exact bounds, so no pair is lost. A text can
have a partner only if 0.8 of its shingles occur elsewhere, which is counted in
packed blocks by hash range. In what is left, the shingles are put in one order,
rare ones first; two near copies share one among the first fifth of each. Pairs
that share one and that sizes, places and parity sketches can't rule out are
checked on the sets themselves. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_DIFF = 3
FAN = 8
#: Fingerprints of one band value in one task, beyond which the value is split by further bits.
HOT = 20_000
#: Candidates looked at together; bounds the memory of a search.
BLOCK = 2_000_000
#: Rows gathered before whole groups are searched.
GATHER = 50_000
#: Near copies: words of a shingle and least Jaccard similarity of the check, in per cent.
SHINGLE, LEAST = 5, 80
#: Near copies: shingles counted in one task, about.
COUNTED = 1_000_000
#: Texts of one shingle looked at in one place; more are dealt out by pairs of blocks.
SHARED = 4_000
#: Texts of one shingle whose sets are compared in one place; more are dealt out likewise.
CHECKED = 500
#: 64-bit words of a parity sketch.
SKETCH = 8
#: Candidates of one text that are checked in one place.
SALTED = 256
#: Rows whose texts are taken apart at once.
SLICE = 500


def fingerprint(text: str | None, shingle: int = 3, distinct: bool = False, seed: int = 42) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes. No word: 0.

    distinct: each shingle counts once however often it occurs.
    """
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    if shingle == 1:
        s = set(w) if distinct else w
    elif len(w) < shingle:
        s = [b" ".join(w)]
    else:
        s = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
        s = set(s) if distinct else s
    return majority(np.fromiter((h64(x, seed) for x in s), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3, distinct: bool = False, seed: int = 42) -> DataFrame:
    """Columns keep of docs and fp (long, the bits as signed)."""
    out = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, distinct, seed) for t in b["_text"]], np.uint64).view(np.int64)
            yield b[keep].assign(fp=fp)

    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(run, out)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Index over fingerprints sorted by (group, Gray rank); a root for each group."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp, self.levels = fp, []
        n = len(fp)
        full = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        mask, pat, g = full, fp, group
        first = np.arange(n)
        last = np.arange(n)
        kids = (np.arange(n), np.arange(n) + 1)
        self.levels.append((mask, pat, kids, last))
        while len(g) > 1 and (g[1:] == g[:-1]).any():
            new = np.r_[True, g[1:] != g[:-1]]
            start = np.flatnonzero(new)
            place = np.arange(len(g)) - start[np.cumsum(new) - 1]
            cut = np.flatnonzero(place % FAN == 0)
            lo, hi = np.bitwise_and.reduceat(pat, cut), np.bitwise_or.reduceat(pat, cut)
            mask = np.bitwise_and.reduceat(mask, cut) & ~(lo ^ hi)
            kids = (cut, np.r_[cut[1:], len(g)])
            first, last = first[kids[0]], last[kids[1] - 1]
            pat, g = lo & mask, g[cut]
            self.levels.append((mask, pat, kids, last))
        self.root = np.searchsorted(first, np.arange(n), side="right") - 1
        self.size = (last - first + 1)[self.root]

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All i < j of one group whose fingerprints differ in at most limit bits."""
        at, n = 0, len(self.fp)
        upto = np.cumsum(self.size)
        while at < n:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
            q = np.arange(at, end)
            node, top = self.root[at:end], len(self.levels) - 1
            mask, pat, _, _ = self.levels[top]
            acc = np.bitwise_count((self.fp[q] ^ pat[node]) & mask[node]).astype(np.int64)
            for level in range(top, 0, -1):
                keep = (acc <= limit) & (self.levels[level][3][node] > q)  # partners after q only
                q, node, acc = q[keep], node[keep], acc[keep]
                lo, hi = self.levels[level][2]
                many = hi[node] - lo[node]
                child = np.repeat(lo[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                held = np.repeat(self.levels[level][0][node], many)
                q, acc = np.repeat(q, many), np.repeat(acc, many)
                mask, pat, _, _ = self.levels[level - 1]
                acc += np.bitwise_count((self.fp[q] ^ pat[child]) & mask[child] & ~held)
                node = child
            keep = (acc <= limit) & (node > q)
            yield q[keep], node[keep]
            at = end


def stars(group: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a sorted run of groups as places (member, representative), one row for each member."""
    label = np.arange(len(fp))
    for i, j in GrayIndex(group, fp).pairs(limit):
        while True:  # hook the larger root below the smaller, then shorten paths
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    own = np.flatnonzero(label != np.arange(len(fp)))
    return own, label[own]


def _whole_groups(batches: Iterator[pd.DataFrame], search: Callable[[pd.DataFrame], pd.DataFrame], gather: int = GATHER) -> Iterator[pd.DataFrame]:
    """search() of runs of whole groups of rows sorted by key, of gather rows or more."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= gather:
            d = pd.concat(held, ignore_index=True)
            last = d["key"].to_numpy() == d["key"].iloc[-1]  # this group may go on
            if not last.all():
                yield search(d[~last])
                d = d[last]
            held = [d]
    if held:
        yield search(pd.concat(held, ignore_index=True))


def links(fps: DataFrame, limit: int = MAX_DIFF) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs within limit bits.

    fps: distinct fp (long). At most one row for each fingerprint and band leaves a
    task, however many pairs a group holds.
    """
    if not 0 <= limit <= MAX_DIFF:
        raise ValueError(f"four bands are exact up to {MAX_DIFF} bits")
    spark = fps.sparkSession
    part = lambda shift, bits: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    key = F.explode(F.array(*[(F.lit(b << 16) + part(16 * b, 16)) for b in range(4)]))
    dealt = fps.select("fp", key.alias("key"))
    # At most 4 x 65,536 keys exist, whatever the input; those above HOT are fewer still.
    hot = [r["key"] for r in dealt.groupBy("key").count().where(F.col("count") > HOT).select("key").collect()]
    if hot:
        held = spark.createDataFrame([(k,) for k in hot], "hot long")
        dealt = dealt.join(F.broadcast(held), F.col("key") == F.col("hot"), "left")
        others = []
        for b in range(4):
            rest = [x for x in range(64) if not 16 * b <= x < 16 * b + 16]
            cuts = []
            for s in range(4):
                bits = rest[12 * s : 12 * s + 12]
                v = F.lit(0).cast("long")
                for n, x in enumerate(bits):
                    v = v.bitwiseOR(F.shiftleft(part(x, 1), n))
                cuts.append(F.lit(s << 12).cast("long").bitwiseOR(v))
            others.append(F.array(*cuts))
        band = F.shiftright("key", 16).cast("int").bitwiseAND(F.lit(3))
        sub = F.when(F.col("hot").isNull(), F.array(F.lit(-1).cast("long")))
        for b in range(4):
            sub = sub.when(band == b, others[b])
        dealt = dealt.select("fp", "key", F.explode(sub).alias("sub"))
    else:
        dealt = dealt.select("fp", "key", F.lit(-1).cast("long").alias("sub"))
    dealt = dealt.select("fp", (F.shiftleft("key", 16) + F.col("sub") + 1).alias("key"))

    def search(d: pd.DataFrame) -> pd.DataFrame:
        g, fp = d["key"].to_numpy(), d["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(fp), g))
        u, v = stars(g[order], fp[order], limit)
        name = d["fp"].to_numpy()[order]
        return pd.DataFrame({"u": name[u], "v": name[v]})

    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(lambda batches: _whole_groups(batches, search), "u long, v long")


def classes(fps: DataFrame, limit: int = MAX_DIFF) -> DataFrame:
    """Rows (fp, root) of the distinct fingerprints that link to another one."""
    return C.components(links(fps, limit)).select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, shingle: int = 3, distinct: bool = False, seed: int = 42, limit: int = MAX_DIFF) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (hex), component_id.

    Two rows link if their fingerprints differ in at most limit bits; the component's
    id is its smallest doc_id. Null and empty texts have fingerprint zero, which
    links like any other. Rows that repeat a doc_id each get a row. A null doc_id
    is never the smallest unless the whole component is null. No rows: no rows.
    """
    d = C.table(fingerprints(docs, ["doc_id"], shingle, distinct, seed), "simhash")
    fps = C.table(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    root = C.table(fps.join(classes(fps.select("fp"), limit), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-roots")
    comp = root.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = root.select("fp", "root").join(comp, "root").select("fp", "component_id")
    return d.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hash of each word, made once."""

    def __missing__(self, w: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        h = self[w] = xxh3_64_intdigest(w)
        return h


def shingle_hashes(w: list[bytes], seen: _Hashes) -> np.ndarray:
    """Distinct SHINGLE-word shingles as sorted hashes; fewer words make one, none make none."""
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    many = len(h) - size + 1
    out = np.full(many, size, np.uint64)
    for k in range(size):
        out = _mix(out + h[k : k + many])
    return np.unique(out)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _words(b: pa.RecordBatch) -> Iterator[list[bytes]]:
    for t in b.column("text").cast(pa.binary()).to_pylist():
        yield (t or b"").lower().split()


def _digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, _row, same): a 128-bit digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in _slices(batches):
            same = pa.array([xxh3_128_digest(b" ".join(w)) for w in _words(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_row"), same], names=["doc_id", "_row", "same"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_row", "text").mapInArrow(run, "doc_id long, _row long, same binary")


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shingles that a text of n has in common with any near copy, at least."""
    return (LEAST * n + 99) // 100


def _with_partners(texts: DataFrame) -> DataFrame:
    """Rows (_row) of texts of which enough shingles occur in another row: a superset of those with a near copy.

    Each slice of texts is sent out by hash range as packed 32-bit remainders with the text's place,
    and each range sends back one count for each text. Equal remainders only keep more.
    """
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(12, max(4, (chars // 6 // COUNTED).bit_length()))
    parts = 1 << bits
    kind = "part int, chunk long, rows binary, sizes binary, place binary, rest binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            if not b.num_rows:
                continue
            seen = _Hashes()
            sets = [shingle_hashes(w, seen) for w in _words(b)]
            sizes = np.array([len(x) for x in sets], np.int32)
            h = np.concatenate(sets)
            part = (h >> np.uint64(64 - bits)).astype(np.int16)
            order = np.argsort(part, kind="stable")
            place = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
            rest = (h >> np.uint64(32 - bits)).astype(np.uint32)[order]
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            rows = b.column("_row").to_numpy()
            made = [(p, int(rows[0]), rows.tobytes() if p == 0 else None, sizes.tobytes(), place[i:j].tobytes(), rest[i:j].tobytes()) for p, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if p == 0 or j > i]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["part", "chunk", "rows", "sizes", "place", "rest"])

    def count(t: pa.Table) -> pa.Table:
        place = [np.frombuffer(x, np.uint16) for x in t.column("place").to_pylist()]
        rest = [np.frombuffer(x, np.uint32) for x in t.column("rest").to_pylist()]
        _, inverse, times = np.unique(np.concatenate(rest), return_inverse=True, return_counts=True)
        often, at, found = times[inverse] > 1, 0, []
        for p, sizes in zip(place, t.column("sizes").to_pylist(), strict=True):
            found.append(np.bincount(p[often[at : at + len(p)]], minlength=len(sizes) // 4).astype(np.int32).tobytes())
            at += len(p)
        return t.select(["chunk", "rows", "sizes"]).append_column("found", pa.array(found, pa.binary()))

    def enough(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in t.column("found").to_pylist())
        rows = next(np.frombuffer(x, np.int64) for x in t.column("rows").to_pylist() if x is not None)
        sizes = np.frombuffer(t.column("sizes")[0].as_py(), np.int32).astype(np.int64)
        return pa.table({"_row": rows[(sizes > 0) & (total >= least_shared(sizes))]})

    dealt = texts.select("_row", "text").mapInArrow(deal, kind)
    counted = dealt.groupBy("part").applyInArrow(count, "chunk long, rows binary, sizes binary, found binary")
    return counted.groupBy("chunk").applyInArrow(enough, "_row long")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """Rows (node, n, s, sketch, fp): hashes of a text's distinct shingles, how many, the parity of how many fall on each bit of a sketch, their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            seen = _Hashes()
            s = [shingle_hashes(w, seen) for w in _words(b)]
            n = pa.array([len(x) for x in s], pa.int32())
            odd = [np.packbits(np.bincount((x & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1).tobytes() for x in s]
            fp = pa.array(np.array([majority(x) for x in s], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("_row"), n, pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64())), pa.array(odd, pa.binary()), fp], names=["node", "n", "s", "sketch", "fp"])

    return docs.select("_row", "text").mapInArrow(run, "node long, n int, s array<long>, sketch binary, fp long")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of similarity LEAST or more, in integers. A v of many pairs is dealt out, SALTED pairs a place."""
    many = pairs.groupBy("v").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("n"))
    right = many.join(sets.withColumnRenamed("node", "v"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.col("s").alias("t"))
    left = pairs.join(many, "v").withColumn("salt", F.pmod(F.xxhash64("u"), "n").cast("int")).select("u", "v", "salt").join(sets.withColumnRenamed("node", "u"), "u")
    both = F.size(F.array_intersect("s", "t"))
    return left.join(right, ["v", "salt"]).where(100 * both >= LEAST * (F.size("s") + F.size("t") - both)).select("u", "v")


def _rare_first(sets: DataFrame) -> DataFrame:
    """Rows (key, node, n, place): each text's shingles that others have, of those that come first; place counts all, from 0."""
    each = sets.select("node", "n", F.explode("s").alias("key"))
    times = C.table(each.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "near-dedup-times")
    own = each.join(times, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("x"))
    # Shingles of one text only come before all others; they are counted, not listed.
    alone = F.col("n") - F.size("x")
    first = F.col("n") - F.floor((LEAST * F.col("n") + 99) / 100).cast("int") + 1
    own = own.withColumn("alone", alone).withColumn("x", F.slice("x", F.lit(1), F.greatest(F.lit(0), first - alone)))
    return own.select("node", "n", "alone", F.posexplode("x").alias("at", "y")).select(F.col("y.key").alias("key"), "node", "n", (F.col("alone") + F.col("at")).alias("place"))


def _dealt(posts: DataFrame, shared: int) -> DataFrame:
    """posts of keys with unlike roots, and side; a key of more than shared rows is dealt out by pairs of blocks, so every pair of its rows meets in one task.

    Side -1: all pairs of one block; 0 and 1: pairs across two blocks.
    """
    held = posts.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    d = posts.join(held.select("key", F.ceil(F.col("c") / shared).cast("int").alias("blocks")), "key")
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    d = d.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    pair = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    rest = [c for c in posts.columns if c != "key"]
    return d.select(F.col("key").alias("shingle"), pair.alias("key"), *rest, side.alias("side"))


def _may_be_copies(d: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows sorted by key that share it, have unlike roots, and that sizes, places and sketches do not rule out."""
    key, n, place, root, side = (d[c].to_numpy() for c in ("key", "n", "place", "root", "side"))
    n = n.astype(np.int64)
    sketch = np.frombuffer(b"".join(d["sketch"]), np.uint64).reshape(-1, SKETCH)
    end = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
    many = np.repeat(end, np.diff(np.r_[0, end])) - np.arange(len(key)) - 1
    upto, at = np.cumsum(many), 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
        m = many[at:to]
        i = np.repeat(np.arange(at, to), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        least = -(-LEAST * (n[i] + n[j]) // (100 + LEAST))
        # At the first shared key no more than what follows it can be shared; other keys of a pair may drop it.
        may = (root[i] != root[j]) & ((side[i] < 0) | (side[i] != side[j])) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= least)
        i, j, least = i[may], j[may], least[may]
        differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        may = differ <= n[i] + n[j] - 2 * least
        yield i[may], j[may]
        at = to


def _with_candidates(posts: DataFrame) -> DataFrame:
    """Distinct (key, node) of posts (key, node, n, place, sketch, root) that have a candidate at that key: a row for each post at most."""

    def search(d: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(d), bool)
        for i, j in _may_be_copies(d):
            hit[i] = hit[j] = True
        return pd.DataFrame({"key": d["shingle"].to_numpy()[hit], "node": d["node"].to_numpy()[hit]})

    found = _dealt(posts, SHARED).repartition("key").sortWithinPartitions("key").mapInPandas(lambda batches: _whole_groups(batches, search), "key long, node long")
    return found.distinct()


def copies_among(posts: DataFrame) -> DataFrame:
    """Links (u, v) whose components, with those of the roots, are those of all near copies among posts (as above, with s, the set).

    Candidates are checked where they meet, and a pair that earlier links of the group join is not looked at, so no more links leave a task than it has rows.
    """

    def search(d: pd.DataFrame) -> pd.DataFrame:
        sets = [x.view(np.uint64) if isinstance(x, np.ndarray) else np.asarray(x, np.int64).view(np.uint64) for x in d["s"]]
        node, root = d["node"].to_numpy(), d["root"].to_numpy()
        # The links found so far, over roots.
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        out = []
        for ii, jj in _may_be_copies(d):
            for i, j in zip(ii.tolist(), jj.tolist(), strict=True):
                a, b = top(int(root[i])), top(int(root[j]))
                if a == b:
                    continue
                x, y = sets[i], sets[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= LEAST * (len(x) + len(y) - both):
                    up[max(a, b)] = min(a, b)
                    out.append((max(node[i], node[j]), min(node[i], node[j])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    d = _dealt(posts, CHECKED).repartition("key").sortWithinPartitions("key")
    return d.mapInPandas(lambda batches: _whole_groups(batches, search, CHECKED), "u long, v long").distinct()


def _index_links(fps: DataFrame) -> DataFrame:
    """Pairs (u > v) of nodes whose fingerprints the index links: each with the least node of its fingerprint, and those with each other."""
    least = C.table(fps.groupBy("fp").agg(F.min("node").alias("least")), "near-dedup-fps")
    same = fps.join(least, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    near = links(least.select("fp")).join(least.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    return same.union(near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def near_copies(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, root) of the components of near copies; texts: _row, text; nodes: node (a _row), one for each distinct text."""
    ends = _with_partners(texts).join(nodes.select(F.col("node").alias("_row")), "_row", "left_semi")
    sets = C.table(_shingle_sets(texts.join(C.table(ends, "near-dedup-ends"), "_row", "left_semi")), "near-dedup-sets")
    posts = C.table(_rare_first(sets), "near-dedup-posts")
    # The index's links and one candidate of each text and shingle first; what those join needs no further check.
    first = posts.groupBy("key").agg(F.min("node").alias("v"))
    first = posts.join(first, "key").where("node <> v").groupBy("node", "v").agg(F.count("*").alias("c"))
    first = first.groupBy("node").agg(F.max_by("v", F.struct("c", "v")).alias("v")).select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v"))
    sets_only = sets.select("node", "s")
    good = C.table(_checked(first.union(_index_links(sets.select("node", "fp"))).distinct(), sets_only), "near-dedup-links")
    root = C.components(good)
    posts = posts.join(sets.select("node", "sketch"), "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Only those with a candidate left take their sets along.
    some = C.table(_with_candidates(posts), "near-dedup-candidates")
    rest = posts.join(some, ["key", "node"], "left_semi").join(sets_only, "node")
    return C.components(good.union(C.table(copies_among(rest), "near-dedup-links")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies in docs, that of the smallest doc_id (null first), with all its columns.

    Texts of the same words, but for A-Z against a-z and white space, are one; others
    link if their sets of five-word shingles have a Jaccard similarity of 0.8 (LEAST) or
    more (under five words: the whole text is the shingle); groups are the components of links.
    Every pair of that similarity is found (near_copies). Texts without a word, nulls
    too, are one group. Repeated rows are one group. No rows: no rows.
    """
    own = docs.columns
    d, names = C.renamed(docs)
    doc_id, text = names[own.index("doc_id")], names[own.index("text")]
    d = C.table(d.withColumn("_row", F.monotonically_increasing_id()), "near-dedup-texts")
    texts = d.select("_row", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    nodes = _digests(texts).groupBy("same").agg(F.min(F.struct("doc_id", "_row")).alias("least"))
    nodes = C.table(nodes.select(F.col("least._row").alias("node"), "least"), "near-dedup-nodes")
    root = nodes.select("node", "least").join(near_copies(texts, nodes), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = root.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._row").alias("_row"))
    return d.join(kept, "_row", "left_semi").select(*names).toDF(*own)
