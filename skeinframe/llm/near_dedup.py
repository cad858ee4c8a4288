"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles are five words, A-Z in lower case (a shorter text is one shingle). A shingle's weight is its count in the text
times the mean inverse document frequency of its words, idf(w) = 1 + ln(N / df(w)) / ln(N + 1), kept in sixteenths so
that sums are exact. Frequencies are taken by word: with a frequency for each whole shingle, what a large group of copies
shares would weigh less with every copy, and the group would fall below the threshold because it is large.

1. Blocks (blocks.py) ask the owners for the df of their words, over all documents, and for the smallest doc_id with the
   same whole text (two 64-bit hashes; a block sends each distinct text once). Exact copies take their original's class
   and go no further.
2. For each other text and each sample k, ICWS draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from a shingle's hash, sets
   t = floor(ln w / r + beta) and keeps the smallest ln c - r (t - beta + 1). Two texts agree in a sample with the
   probability of their weighted Jaccard similarity.
3. Samples are banded by `rows`. Texts that share a band are compared with its leader, a row each; a second key of each
   band (two samples more) does so once more among closer texts. Texts of bands that still hold several classes are
   then searched for links between classes, rarest shingles first, where most pairs that can't reach the threshold never
   meet. The similarity of a pair is exact.
4. Verified links become classes by alternating star contractions, over tables in the shared folder.

Cases. Null or wordless text: a class of its own. Null doc_id: null class, never a duplicate. Rows that share a doc_id
are one document: they stay or go together. Ties: the smallest doc_id names a class and stays. Empty table: no rows.
Extra columns are dropped by `classes` and kept by `one_of_each`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .shared import cut, only
from .substring_dedup import rolling

U64 = B.U64
SIZE = 5
#: idf steps of one; weights are small integers.
STEPS = 16
#: Elements that are sampled together, to stay in cache.
CHUNK = 1 << 15


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 2^16 even steps; ln of its quantile at each float32 whose low 16 bits are 0, up to 1."""
    x = np.concatenate([[0], np.geomspace(1e-25, 60, 400_000)])
    cdf = np.where(x < 1e-4, x**2 / 2 - x**3 / 3, 1 - (1 + x) * np.exp(-x))
    even = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), cdf, x).astype(np.float32)
    u = (np.arange(0x3F81, dtype=np.uint32) << 16).view(np.float32).astype(np.float64)
    with np.errstate(divide="ignore"):
        log_c = np.interp(np.log(np.clip(u, 1e-30, 1 - 2e-8)), np.log(np.maximum(cdf[1:], 1e-60)), np.log(x[1:]))
    return even, log_c.astype(np.float32)


GAMMA, LOG_C = _tables()


def samples(keys: np.ndarray, log_w: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """ICWS: for each text (elements from starts[i] on) and sample the value of its chosen element.

    A value depends on the element, the sample and t alone, so equal values stand for the same (element, t).
    """
    ends = np.append(starts[1:], len(keys))
    out = np.empty((len(starts), count), np.float32)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, side="right")))
        a, b = starts[first], ends[last - 1]
        own, weight, cuts = keys[a:b], log_w[a:b], starts[first:last] - a
        high, low = (own >> U64(32)).astype(np.uint32), own.astype(np.uint32)
        for k in range(count):
            salt = B.mix(np.array([k + 1], U64))
            x = (low ^ np.uint32(salt[0] & U64(0xFFFFFFFF))) * np.uint32(0x85EBCA6B) + high
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(13)
            y = (x + np.uint32(salt[0] >> U64(32))) * np.uint32(0x27D4EB2F) ^ high
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x165667B1)
            y ^= y >> np.uint32(16)
            r = GAMMA[y & np.uint32(0xFFFF)]
            beta = (y >> np.uint32(16)).astype(np.float32) * np.float32(2**-16)
            log_c = LOG_C[(x.astype(np.float32) * np.float32(2**-32)).view(np.uint32) >> np.uint32(16)]
            t = np.floor(weight / r + beta)
            t -= beta
            t += np.float32(1)
            t *= r
            log_c -= t
            out[first:last, k] = np.minimum.reduceat(log_c, cuts)
        first = last
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """Two keys a band: its rows (even), and these with two samples of the next band (odd)."""
    n, count = values.shape
    bits = np.ascontiguousarray(values).view(np.uint32).astype(U64)
    keys = []
    for band in range(count // rows):
        for extra in (0, 2):
            key = np.full(n, U64(2 * band + (extra > 0) + 1))
            for j in range(rows + extra):
                key = B.mix(key * U64(0x9E3779B97F4A7C15) + bits[:, (band * rows + j) % count])
            keys.append((key & ~U64(1)) | U64(extra > 0))
    return np.stack(keys, axis=1).view(np.int64)


class Shingles:
    """Distinct shingles of some documents of a block, by document, with integer weights."""

    def __init__(self, block: B.Block, idf: np.ndarray, wanted: np.ndarray):
        """idf: of each word, in steps; wanted: documents by place, ascending, with words."""
        hashes = block.word_hashes()
        long = block.lens >= SIZE
        doc = block.doc_of
        place = np.arange(len(doc)) - block.starts[doc]
        take = np.zeros(len(block.ids), bool)
        take[wanted] = True
        at = np.flatnonzero((take & long)[doc] & (place + SIZE <= block.lens[doc]))
        steps = idf[block.tokens].astype(np.uint32)
        key = rolling(hashes[block.tokens], SIZE)[at] if len(at) else np.zeros(0, U64)
        weight = sum((steps[at + j] for j in range(SIZE)), np.zeros(len(at), np.uint32))
        doc = doc[at]
        short = [d for d in wanted.tolist() if not long[d]]
        for d in short:
            own = block.tokens[block.starts[d] : block.ends[d]]
            one = B.mix(np.array([(len(own) + sum(int(h) * (3 + 2 * j) for j, h in enumerate(hashes[own].tolist()))) & 0xFFFFFFFFFFFFFFFF], U64))
            key, doc, weight = np.append(key, one), np.append(doc, d), np.append(weight, np.uint32(SIZE * steps[block.starts[d] : block.ends[d]].mean()))
        order = np.argsort(doc, kind="stable") if short else slice(None)
        key, doc, weight = key[order], doc[order], weight[order]
        # repeats within a document, which are few, are found by one sort of plain numbers; places stay in text order
        both = B.mix(key + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
        ranked = np.sort(both)
        again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if len(again):
            at = np.flatnonzero(np.isin(both, again))
            at = at[np.argsort(both[at], kind="stable")]
            new = np.append(True, both[at][1:] != both[at][:-1])
            weight = weight.copy()
            weight[at[new]] = np.add.reduceat(weight[at], np.flatnonzero(new))
            keep = np.ones(len(key), bool)
            keep[at[~new]] = False
            key, doc, weight = key[keep], doc[keep], weight[keep]
        self.key, self.doc, self.weight = key, doc, weight
        self.starts = np.searchsorted(self.doc, wanted)


def pack_vector(key: np.ndarray, weight: np.ndarray) -> bytes:
    """Shingles by the high 32 bits of their hashes, ascending: a false match of a pair costs one shingle's weight."""
    order = np.argsort(key)
    short, weight = (key[order] >> U64(32)).astype(np.uint32), weight[order]
    if len(short) > 1 and (short[1:] == short[:-1]).any():
        first = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        short, weight = short[first], np.add.reduceat(weight, first)
    return B.pack_parts(B.pack_ints(np.diff(short, prepend=np.uint32(0))), B.pack_ints(weight.astype(np.uint32)))


def unpack_vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, weights = B.unpack_parts(data)
    return np.cumsum(B.unpack_ints(keys, np.uint32), dtype=np.uint32), B.unpack_ints(weights, np.uint32).astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def ask_frequencies(owners: int):
    """Questions: words with the documents that have each, and the hashes and ids of whole texts."""

    def question(block: B.Block):
        n = max(1, len(block.words))
        pairs = np.unique(block.doc_of * n + block.tokens)
        counts = np.bincount(pairs % n, minlength=len(block.words)).astype(np.uint32)
        hashes = block.word_hashes()
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        sums, ids, _ = block.texts()
        said = {o: (a, b) for o, a, b in B.owner_ranges(hashes, owners)}
        whole = {o: (a, b) for o, a, b in B.owner_ranges(np.ascontiguousarray(sums[:, 0]), owners)}
        for o in sorted({*said, *whole}):
            (a, b), (x, y) = said.get(o, (0, 0)), whole.get(o, (0, 0))
            yield o, B.pack_parts(B.pack_keys(hashes[a:b]), B.pack_ints(counts[a:b]), sums[x:y].tobytes(), ids[x:y].tobytes())

    return question


def tell_frequencies(payloads: list[bytes]):
    parts = [B.unpack_parts(p) for p in payloads]
    totals, _, _ = B.summed(payloads)
    sums = [np.frombuffer(p[2], U64).reshape(-1, 2) for p in parts]
    for total, own in zip(totals, B.smallest_of_texts(sums, [np.frombuffer(p[3], np.int64) for p in parts]), strict=True):
        yield B.pack_parts(B.pack_ints(total), own.tobytes())


def _heard(block: B.Block, payloads: list[bytes], n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """idf steps by word; the original of each document (itself where it has none smaller); documents to compare."""
    parts = [B.unpack_parts(p) for p in payloads]
    df = np.empty(len(block.words), np.int64)
    df[np.argsort(block.word_hashes(), kind="stable")] = np.concatenate([B.unpack_ints(p[0], np.int64) for p in parts])
    least = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])[block.texts()[2]]
    idf = np.rint(STEPS * (1 + np.log(np.maximum(n_docs, df) / df) / np.log(n_docs + 1.0)))
    original = np.where((block.lens > 0) & (least < block.ids) & (block.ids != B.NO_ID), least, block.ids)
    return idf, original, np.flatnonzero((block.lens > 0) & (original == block.ids) & (block.ids != B.NO_ID))


TEXT = "doc_id long, original long, keys array<long>, weight long, vector binary"


def prepared(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Rows of TEXT: for each document its original, the band keys it shares with others, total weight and vector.

    Copies have no keys; texts that share no key have no vector. docs: (doc_id, text).
    """
    n_docs = docs.count()
    owners = B.owner_count(docs)
    packed = B.blocks(docs, B.split_lower)
    said = B.answers(B.ask(packed, ask_frequencies(owners)), tell_frequencies).withColumns({"place": F.lit(None).cast("int"), "key": F.lit(None).cast("long")})

    def sampled(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = B.Block.unpack(left.data.iloc[0])
        idf, _, wanted = _heard(block, list(right.sort_values("owner").payload), n_docs)
        columns = ["block", "place", "key"]
        if not len(wanted):
            return pd.DataFrame([], columns=columns)
        own = Shingles(block, idf, wanted)
        keys = band_keys(samples(own.key, np.log(own.weight).astype(np.float32), own.starts, bands * rows), rows)
        return pd.DataFrame({"block": left.block.iloc[0], "place": np.repeat(wanted, keys.shape[1]), "key": keys.ravel()}, columns=columns)

    keys = packed.groupBy("block").cogroup(said.groupBy("block")).applyInPandas(sampled, "block long, place int, key long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    busy = keys.join(shared, "key").select("block", F.lit(-2).cast("long").alias("owner"), F.lit(None).cast("binary").alias("payload"), "place", "key")

    def told(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = B.Block.unpack(left.data.iloc[0])
        idf, original, _ = _heard(block, list(right[right.owner >= 0].sort_values("owner").payload), n_docs)
        right = right[right.owner < 0]
        place, key = right.place.to_numpy(np.int64), right.key.to_numpy(np.int64)
        order = np.argsort(place, kind="stable")
        place, key = place[order], key[order]
        wanted, first = np.unique(place, return_index=True)
        own = Shingles(block, idf, wanted)
        ends = np.append(own.starts, len(own.key))[1:]
        n = len(block.ids)
        found, totals, vectors = [None] * n, [0] * n, [None] * n
        for d, a, b, k in zip(wanted.tolist(), own.starts.tolist(), ends.tolist(), np.split(key, first[1:]) if len(first) else [], strict=True):
            found[d], totals[d], vectors[d] = k, int(own.weight[a:b].sum()), pack_vector(own.key[a:b], own.weight[a:b])
        return pd.DataFrame({"doc_id": B.id_column(block.ids), "original": B.id_column(original), "keys": found, "weight": totals, "vector": vectors})

    return packed.groupBy("block").cogroup(said.where("block >= 0").unionByName(busy).groupBy("block")).applyInPandas(told, TEXT)


def similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted Jaccard of two columns of vectors."""
    last, known, out = None, None, []
    for x, y in zip(a, b, strict=True):
        if y != last:
            last, known = y, unpack_vector(y)
        out.append(weighted_jaccard(unpack_vector(x), known))
    return pd.Series(out, dtype="float64")


def elements(vectors: pd.Series) -> pd.DataFrame:
    """A column of vectors as arrays of shingles and of their weights."""
    both = [unpack_vector(v) for v in vectors]
    return pd.DataFrame({"e": [k.view(np.int32) for k, _ in both], "w": [w for _, w in both]})


def able(texts: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, other), doc_id > other: pairs of different classes that may reach the threshold, and all that do.

    texts: (doc_id, class_id, weight, vector), once each. Shingles have one order: those of a single class, then by the
    number of texts that have them, rarest first. What two texts share lies, in both, at or after the first shingle they
    share, so what weighs less from there on than the threshold asks for needs no look. As similar texts share at least
    `threshold` of each one's weight, a text only stands under the shingles up to that remainder, and texts with much of
    their own under none. Of a shingle's texts those outside its largest class are joined with those of other classes.
    """
    unpack = F.pandas_udf(elements, "e array<int>, w array<long>")
    texts = texts.withColumns({"text": F.xxhash64("vector"), "u": unpack("vector")}).drop("vector")
    rows = texts.select("doc_id", "text", "class_id", "weight", F.explode(F.arrays_zip("u.e", "u.w")).alias("z")).select("doc_id", "text", "class_id", "weight", "z.e", "z.w")
    common = rows.groupBy("e").agg(F.count("*").alias("n"), F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a < z").select("e", "n")
    rest = F.sum("w").over(Window.partitionBy("doc_id", "text").orderBy(F.desc("n"), "e").rowsBetween(Window.unboundedPreceding, 0))
    under = cut(rows.join(common, "e").withColumn("rest", rest).where(F.col("rest") >= threshold * F.col("weight")).select("e", "doc_id", "class_id", "weight", "rest"))
    sizes = under.groupBy("e", "class_id").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("e").agg(F.max(F.struct("n", "class_id")).alias("most"), F.count("*").alias("classes")).where("classes > 1").select("e", F.col("most.class_id").alias("largest"))
    x, y = under.join(largest, "e").where("class_id <> largest").alias("x"), under.alias("y")
    enough = F.least("x.rest", "y.rest") * (1 + threshold) >= threshold * (F.col("x.weight") + F.col("y.weight")) - 1e-6
    pairs = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.class_id") != F.col("y.class_id")) & enough)
    return pairs.select(F.greatest("x.doc_id", "y.doc_id").alias("doc_id"), F.least("x.doc_id", "y.doc_id").alias("other")).distinct()


def links(texts: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, other): other is the smallest id of the class that doc_id is linked to. texts: rows of TEXT.

    First each band's texts are compared with its leader, the one that shares bands with most others (what all its near
    copies were made from, if it is there). Then all texts of bands that hold several classes are searched for pairs of
    different classes (`able`). So of any two texts that share a band, both are in one class, or they were compared, or
    they can't reach the threshold.
    """
    similarity = F.pandas_udf(similarities, "double")
    vectors = texts.where("vector IS NOT NULL").select("doc_id", "weight", "vector")
    first, second = (vectors.select(F.col("doc_id").alias(n), F.col("weight").alias(f"{n}_weight"), F.col("vector").alias(f"{n}_vector")) for n in ("doc_id", "other"))

    def linked(pairs: DataFrame) -> DataFrame:
        """(doc_id, other) of the pairs that reach the threshold; their total weights differ by no more than it."""
        both = pairs.distinct().join(first, "doc_id").join(second, "other")
        both = both.where(F.least("doc_id_weight", "other_weight") >= threshold * F.greatest("doc_id_weight", "other_weight"))
        return cut(both.select("doc_id", "other", similarity("doc_id_vector", "other_vector").alias("s")).where(F.col("s") >= threshold).select("doc_id", "other"))

    members = texts.select("doc_id", F.explode("keys").alias("key")).distinct()
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    degree = members.join(sizes, "key").groupBy("doc_id").agg(F.sum("n").alias("degree"))
    members = cut(members.join(degree, "doc_id"))
    best = F.max(F.struct("degree", (-F.col("doc_id")).alias("minus"))).alias("b")
    leaders = members.groupBy("key").agg(best, F.count("*").alias("n")).where("n > 1").select("key", (-F.col("b.minus")).alias("leader"))
    tries = members.join(leaders, "key").where("doc_id <> leader")
    named = components(linked(tries.select(F.greatest("doc_id", "leader").alias("doc_id"), F.least("doc_id", "leader").alias("other"))))

    # texts that share a second key share the first one too
    own = cut(members.where("key & 1 = 0").select("doc_id", "key").join(named, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")))
    mixed = own.groupBy("key").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a < z").select("key")
    mixed = own.join(mixed, "key").select("doc_id", "class_id").distinct()
    more = linked(able(mixed.join(vectors, "doc_id").distinct(), threshold))
    if not more.isEmpty():
        named = components(named.select("doc_id", F.col("class_id").alias("other")).unionByName(more))
    return named.select("doc_id", F.col("class_id").alias("other"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for pairs (doc_id, other), doc_id > other; class_id is the smallest id of the component.

    Alternating large-star and small-star steps: each only sends a node's smallest neighbour to its other neighbours.
    """
    edges = cut(pairs.select(F.col("doc_id").alias("u"), F.col("other").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("class_id"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.where("u > v").distinct())


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = 12, rows: int = 4) -> DataFrame:
    """(doc_id, class_id) for each document: class_id is the smallest doc_id of its near-duplicates."""
    texts = cut(prepared(only(docs, doc_id="long", text="string"), bands, rows))
    named = links(texts, threshold).select(F.col("doc_id").alias("original"), F.col("other").alias("class_id"))
    return texts.select("doc_id", "original").join(named, "original", "left").select("doc_id", F.coalesce("class_id", "original").alias("class_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that name their class, with the columns they came with; rows without an id stay."""
    gone = classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__copy"], "left_anti")
