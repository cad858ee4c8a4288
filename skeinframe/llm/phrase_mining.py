"""Phrase collocation mining: direct-address tiling over frequency-ranked ids.

Text, with A-Z in lower case, is cut into pieces at `.,;:!?` and line breaks, pieces into words. Per language, phrases of 2
to 5 words that occur often enough are scored by the cut that explains them best.

One level. Blocks hold a sequence of ids, one for each place, of the frequent phrases of k words that begin there. A phrase of
k + 1 words is a pair of neighbouring ids, as both its beginning and its end of k words must be frequent. Ids are ranks: an
owner ranks what it found by frequency, and owners take turns in the numbering. The pair plane is cut into tiles, narrow where
ids are small and pairs dense. Each tile belongs to one owner. A block counts its pairs, sends each distinct one once to the
tile's owner, and the owner adds up: a tile with many pairs for its size is counted in a dense array by np.bincount, the others
as sorted coordinates (COO). Frequent pairs are ranked and become the ids of the next level; blocks get back the ids of those
of their pairs that are frequent, and the next level's sequences. Words are level 1, with the words as keys.

Bounds. A block has about a million words of one language (a longer document is one block); a task holds one. A dense tile is
at most WIDEST squared. A common pair costs its owner one entry for each block. Counts are never collected or broadcast.
Each level's blocks and answers are tables in the shared folder, so a lost executor costs its own tasks.

Scores are exact: products are decimals of 38 digits. The best of a language are taken in rounds, so that no task sorts all
of a language's phrases.

Cases. Null text: empty. Null lang: `und`. doc_id isn't used; repeated rows count again. Empty texts, tables and languages
without frequent phrases give no rows. Other columns are dropped.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import Numbers, owner_count, pack_ints, pack_parts, unpack_ints, unpack_parts
from .shared import new_folder

#: Words after which a block ends.
BLOCK_WORDS = 1 << 20
#: Tiles have this many ids a side in the corner, double with the ids, and never have more than WIDEST.
NARROWEST, WIDEST = 64, 1024
#: A tile is dense where it gets at least one entry for so many cells; all dense tiles of a task have so many times its entries.
DENSE = 8
U64, U32 = np.uint64, np.uint32
#: No frequent phrase begins here.
NONE = np.iinfo(np.uint32).max

BLOCK = "block string, lang string, n_words long, data binary"
MESSAGE = "block string, owner long, payload binary"
#: Stands for the break between pieces; it isn't a byte of UTF-8.
BREAK = b"\xff"
SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def pieces_and_words(text: bytes) -> list[bytes]:
    """Words in order, with BREAK between pieces."""
    return text.lower().translate(SEPARATORS).replace(b"\n", b" \xff ").split()


# Blocks: (lang, ids by place, words by number at level 1).


def built(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
    """(lang, data, words) of blocks from (lang, text). Number 0 is BREAK, which also ends each document."""
    held: dict[str, tuple[array, Numbers]] = {}
    total = 0

    def give() -> Iterator[tuple[str, bytes, int]]:
        for lang, (tokens, words) in held.items():
            ids = np.array(tokens, U32)
            sizes = np.fromiter(map(len, words), U32, len(words))
            text = zstandard.ZstdCompressor(level=1).compress(b"".join(words))
            yield lang, pack_parts(pack_ints(ids), pack_ints(sizes), text), int((ids != 0).sum())
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            lang = lang.as_py()
            if lang not in held:
                words = Numbers()
                words[BREAK]
                held[lang] = (array("I", [0]), words)
            tokens, words = held[lang]
            found = pieces_and_words(text.as_py())
            tokens.extend(map(words.__getitem__, found))
            tokens.append(0)
            total += len(found) + 1
            if total >= BLOCK_WORDS:
                yield from give()
                total = 0
    yield from give()


def words_of(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    ids, sizes, text = unpack_parts(data)
    text = zstandard.ZstdDecompressor().decompress(text)
    ends = np.cumsum(unpack_ints(sizes, U32), dtype=np.int64).tolist()
    return unpack_ints(ids, U32), [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def pack_sequence(ids: np.ndarray) -> bytes:
    """Ids by place, most of them NONE."""
    there = ids != NONE
    return pack_parts(np.int64(len(ids)).tobytes(), zstandard.ZstdCompressor(level=1).compress(np.packbits(there).tobytes()), pack_ints(ids[there]))


def sequence_of(data: bytes) -> np.ndarray:
    n, there, ids = unpack_parts(data)
    n = int(np.frombuffer(n, np.int64)[0])
    there = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(there), np.uint8), count=n).astype(bool)
    out = np.full(n, NONE, U32)
    out[there] = unpack_ints(ids, U32)
    return out


# Tiles.


def band(ids: np.ndarray) -> np.ndarray:
    """The band of an id: bands are NARROWEST wide at first, then double up to WIDEST."""
    doubling = int(np.log2(WIDEST // NARROWEST))
    low = np.searchsorted(np.array([NARROWEST << i for i in range(doubling + 1)]), ids, side="right")
    return np.where(ids < WIDEST, low, ids // WIDEST + doubling)


def band_start(b: np.ndarray) -> np.ndarray:
    doubling = int(np.log2(WIDEST // NARROWEST))
    return np.where(b == 0, 0, np.where(b <= doubling, NARROWEST << np.clip(b - 1, 0, doubling), (b - doubling) * WIDEST))


def band_width(b: np.ndarray) -> np.ndarray:
    return band_start(b + 1) - band_start(b)


def tile_of(pairs: np.ndarray) -> np.ndarray:
    """The tile of pairs (left << 32 | right) as one number."""
    left, right = (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64)
    return band(left).astype(U64) << U64(32) | band(right).astype(U64)


def dense_counts(pairs: np.ndarray, counts: np.ndarray | None, tiles: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs with totals, by an array of all cells of some tiles, side by side. place: each pair's tile among them."""
    rows, cols = (tiles >> U64(32)).astype(np.int64), (tiles & U64(0xFFFFFFFF)).astype(np.int64)
    top, left, width = band_start(rows), band_start(cols), band_width(cols)
    ends = np.cumsum(band_width(rows) * width)
    first = ends - band_width(rows) * width
    cell = first[place] + ((pairs >> U64(32)).astype(np.int64) - top[place]) * width[place] + (pairs & U64(0xFFFFFFFF)).astype(np.int64) - left[place]
    # weights are summed as doubles, exact below 2 ** 53
    total = np.bincount(cell, counts) if counts is not None else np.bincount(cell)
    cell = np.flatnonzero(total)
    at = np.searchsorted(ends, cell, side="right")
    inside = cell - first[at]
    return (inside // width[at] + top[at]).astype(U64) << U64(32) | (inside % width[at] + left[at]).astype(U64), total[cell].astype(np.int64)


def sorted_counts(pairs: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs with totals, by sorting."""
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], starts) if counts is not None and len(pairs) else np.diff(np.append(starts, len(pairs)))
    return pairs[starts], total.astype(np.int64)


def numbered(tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tiles, each pair's tile among them, and the pairs of each; without sorting where the plane is small."""
    rows, cols = tiles >> U64(32), tiles & U64(0xFFFFFFFF)
    width = int(cols.max()) + 1 if len(tiles) else 1
    if len(tiles) and (int(rows.max()) + 1) * width <= 4 * len(tiles) + 1024:
        code = (rows * U64(width) + cols).astype(np.int64)
        n = np.bincount(code)
        there = np.flatnonzero(n)
        number = np.empty(len(n), np.int64)
        number[there] = np.arange(len(there))
        return (there // width).astype(U64) << U64(32) | (there % width).astype(U64), number[code], n[there]
    kinds, place, n = np.unique(tiles, return_inverse=True, return_counts=True)
    return kinds, place, n


def count_pairs(pairs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order with totals: dense tiles by bincount, what is left by sorting."""
    kinds, place, n = numbered(tile_of(pairs))
    dense = n * DENSE >= band_width((kinds >> U64(32)).astype(np.int64)) * band_width((kinds & U64(0xFFFFFFFF)).astype(np.int64))
    here = dense[place]
    some = lambda mask: None if counts is None else counts[mask]
    found = [sorted_counts(pairs[~here], some(~here))]
    if here.any():
        found.append(dense_counts(pairs[here], some(here), kinds[dense], (np.cumsum(dense) - 1)[place[here]]))
    keys, totals = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.argsort(keys, kind="stable")
    return keys[order], totals[order]


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """Pairs of neighbouring ids by the place of the first; where one is NONE the highest number."""
    out = np.full(len(ids), np.iinfo(U64).max, U64)
    if len(ids) > 1:
        both = (ids[:-1] != NONE) & (ids[1:] != NONE)
        out[:-1][both] = ids[:-1][both].astype(U64) << U64(32) | ids[1:][both].astype(U64)
    return out


def owners_of(lang: str, tiles: np.ndarray, owners: int) -> np.ndarray:
    kinds, place, _ = numbered(tiles)
    head = lang.encode()
    return np.array([xxhash.xxh3_64_intdigest(head + t.to_bytes(8, "little")) % owners for t in kinds.tolist()], np.int64)[place] if len(kinds) else np.zeros(0, np.int64)


# Messages: (lang, keys, counts) to an owner; (keys, ids) to a block; (lang, keys, ids, counts) to the table of phrases.


def pack_words(words: list[bytes]) -> bytes:
    return pack_parts(pack_ints(np.fromiter(map(len, words), U32, len(words))), zstandard.ZstdCompressor(level=1).compress(b"".join(words)))


def unpack_words(data: bytes) -> list[bytes]:
    sizes, text = unpack_parts(data)
    text = zstandard.ZstdDecompressor().decompress(text)
    ends = np.cumsum(unpack_ints(sizes, U32), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def pack_pairs(pairs: np.ndarray) -> bytes:
    return pack_ints(np.diff(pairs, prepend=U64(0)))


def unpack_pairs(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data, U64), dtype=U64)


def ask_words(lang: str, data: bytes, owners: int) -> Iterator[tuple[int, bytes]]:
    ids, words = words_of(data)
    counts = np.bincount(ids, minlength=len(words)).tolist()
    to: dict[int, list[int]] = {}
    head = lang.encode()
    for i in range(1, len(words)):
        to.setdefault(xxhash.xxh3_64_intdigest(words[i], xxhash.xxh32_intdigest(head)) % owners, []).append(i)
    for owner, some in to.items():
        yield owner, pack_parts(head, pack_words([words[i] for i in some]), pack_ints(np.array([counts[i] for i in some], np.int64)))


def ask_pairs(lang: str, data: bytes, owners: int) -> Iterator[tuple[int, bytes]]:
    pairs = pairs_of(sequence_of(data))
    pairs, counts = count_pairs(pairs[pairs != np.iinfo(U64).max])
    to = owners_of(lang, tile_of(pairs), owners)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for some in np.split(order, cuts) if len(order) else []:
        yield int(to[some[0]]), pack_parts(lang.encode(), pack_pairs(pairs[some]), pack_ints(counts[some]))


def ranked(counts: np.ndarray, owner: int, owners: int) -> np.ndarray:
    """Ids by descending count; owners take turns, so ids of all owners together are nearly ranks."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    ids = rank * owners + owner
    if len(ids) and int(ids.max()) >= NONE:
        raise ValueError("more frequent phrases than ids; raise the least count")
    return ids.astype(U32)


def answer_words(blocks: list[str], payloads: list[bytes], owner: int, owners: int, least: int) -> Iterator[tuple[str | None, bytes]]:
    totals: dict[bytes, dict[bytes, int]] = {}
    asked = []
    for p in payloads:
        lang, words, counts = unpack_parts(p)
        words, mine = unpack_words(words), totals.setdefault(lang, {})
        for w, n in zip(words, unpack_ints(counts, np.int64).tolist(), strict=True):
            mine[w] = mine.get(w, 0) + n
        asked.append((lang, words))
    ids: dict[bytes, dict[bytes, int]] = {}
    for lang, mine in totals.items():
        kept = [w for w, n in mine.items() if n >= least]
        counts = np.array([mine[w] for w in kept], np.int64)
        numbers = ranked(counts, owner, owners)
        ids[lang] = dict(zip(kept, numbers.tolist(), strict=True))
        yield None, pack_parts(lang, pack_words(kept), pack_ints(numbers), pack_ints(counts))
    for block, (lang, words) in zip(blocks, asked, strict=True):
        mine = ids[lang]
        if kept := [w for w in words if w in mine]:
            yield block, pack_parts(pack_words(kept), pack_ints(np.array([mine[w] for w in kept], U32)))


def answer_pairs(blocks: list[str], payloads: list[bytes], owner: int, owners: int, least: int) -> Iterator[tuple[str | None, bytes]]:
    asked: dict[bytes, list[tuple[str, np.ndarray, np.ndarray]]] = {}
    for block, p in zip(blocks, payloads, strict=True):
        lang, pairs, counts = unpack_parts(p)
        asked.setdefault(lang, []).append((block, unpack_pairs(pairs), unpack_ints(counts, np.int64)))
    for lang, parts in asked.items():
        pairs, totals = count_pairs(np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts]))
        pairs, totals = pairs[totals >= least], totals[totals >= least]
        ids = ranked(totals, owner, owners)
        if not len(pairs):
            continue
        yield None, pack_parts(lang, pack_pairs(pairs), pack_ints(ids), pack_ints(totals))
        for block, some, _ in parts:
            place = np.minimum(np.searchsorted(pairs, some), len(pairs) - 1)
            there = pairs[place] == some
            if there.any():
                yield block, pack_parts(pack_pairs(some[there]), pack_ints(ids[place[there]]))


def renumbered_words(data: bytes, answers: list[bytes]) -> np.ndarray:
    ids, words = words_of(data)
    table = {}
    for a in answers:
        kept, numbers = unpack_parts(a)
        table.update(zip(unpack_words(kept), unpack_ints(numbers, U32).tolist(), strict=True))
    return np.array([table.get(w, NONE) for w in words], U32)[ids]


def renumbered_pairs(data: bytes, answers: list[bytes]) -> np.ndarray:
    pairs = pairs_of(sequence_of(data))
    parts = [unpack_parts(a) for a in answers]
    keys, ids = np.concatenate([unpack_pairs(p[0]) for p in parts]), np.concatenate([unpack_ints(p[1], U32) for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    out = np.full(len(pairs), NONE, U32)
    there = np.flatnonzero(pairs != np.iinfo(U64).max)
    place = np.minimum(np.searchsorted(keys, pairs[there]), len(keys) - 1)
    same = keys[place] == pairs[there]
    out[there[same]] = ids[place[same]]
    return out


def without_lone(ids: np.ndarray) -> np.ndarray:
    """Ids that have a neighbour; the others make no pair."""
    there = ids != NONE
    beside = np.zeros(len(ids), bool)
    if len(ids) > 1:
        beside[:-1] |= there[1:]
        beside[1:] |= there[:-1]
    return np.where(there & beside, ids, NONE).astype(U32)


# Levels.


def block_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for n, (lang, data, n_words) in enumerate(built(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}/{n}"]), pa.array([lang]), pa.array([n_words], pa.int64()), pa.array([data], pa.binary())], names=["block", "lang", "n_words", "data"])

    folder = new_folder(spark, "phrase-blocks")
    rows.mapInArrow(run, BLOCK).write.parquet(folder)
    return spark.read.schema(BLOCK).parquet(folder)


def answered(blocks: DataFrame, ask: Callable, answer: Callable, owners: int, least: int) -> DataFrame:
    """Rows of MESSAGE from the owners, in the shared folder; block is null in rows for the table of phrases."""

    def asked(batches):
        for batch in batches:
            for block, lang, data in zip(*(batch.column(n).to_pylist() for n in ("block", "lang", "data")), strict=True):
                if rows := list(ask(lang, data, owners)):
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows)), pa.array([o for o, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["block", "owner", "payload"])

    def said(pdf: pd.DataFrame) -> pd.DataFrame:
        # blocks in order, so that a task that runs again ranks ties alike
        pdf = pdf.sort_values("block")
        owner = int(pdf.owner.iloc[0])
        rows = list(answer(list(pdf.block), list(pdf.payload), owner, owners, least))
        return pd.DataFrame({"block": pd.Series([b for b, _ in rows], dtype=object), "owner": pd.Series([owner] * len(rows), dtype="int64"), "payload": pd.Series([p for _, p in rows], dtype=object)})

    folder = new_folder(blocks.sparkSession, "phrase-answers")
    blocks.select("block", "lang", "data").mapInArrow(asked, MESSAGE).groupBy("owner").applyInPandas(said, MESSAGE).write.parquet(folder)
    return blocks.sparkSession.read.schema(MESSAGE).parquet(folder)


def next_blocks(blocks: DataFrame, said: DataFrame, renumbered: Callable) -> DataFrame:
    """Blocks with the ids of the next level; those without pairs go."""

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right) or not len(left):
            return left[:0]
        ids = without_lone(renumbered(left.data.iloc[0], list(right.payload)))
        return left[:0] if (ids == NONE).all() else left.assign(data=pd.Series([pack_sequence(ids)], index=left.index, dtype=object))

    folder = new_folder(blocks.sparkSession, "phrase-level")
    blocks.groupBy("block").cogroup(said.where("block IS NOT NULL").groupBy("block")).applyInPandas(met, BLOCK).write.parquet(folder)
    return blocks.sparkSession.read.schema(BLOCK).parquet(folder)


def word_table(said: DataFrame) -> DataFrame:
    """(lang, id, a, phrase) of frequent words."""

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                lang, words, ids, counts = unpack_parts(p)
                words = unpack_words(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.decode()] * len(words)), pa.array(unpack_ints(ids, U32).astype(np.int64)), pa.array(unpack_ints(counts, np.int64)), pa.array([w.decode() for w in words], pa.string())], names=["lang", "id", "a", "phrase"]
                )

    return said.where("block IS NULL").select("payload").mapInArrow(run, "lang string, id long, a long, phrase string")


def pair_table(said: DataFrame) -> DataFrame:
    """(lang, id, a, left, right) of frequent pairs."""

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                lang, pairs, ids, counts = unpack_parts(p)
                pairs = unpack_pairs(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.decode()] * len(pairs)), *(pa.array(x.astype(np.int64)) for x in (unpack_ints(ids, U32), unpack_ints(counts, np.int64), pairs >> U64(32), pairs & U64(0xFFFFFFFF)))], names=["lang", "id", "a", "left", "right"]
                )

    return said.where("block IS NULL").select("payload").mapInArrow(run, "lang string, id long, a long, left long, right long")


def stored(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def frequent(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... words, and (lang, n): all words of each language.

    A table has lang, id, a, phrase, words (array), before and after: how often the phrase's first 1, 2, ... words occur, and
    its last 1, 2, ... words; left and right: the ids of the phrases without its last and its first word.
    """
    spark = docs.sparkSession
    owners = owner_count(docs)
    blocks = block_table(spark, docs)
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    none = F.array().cast("array<long>")
    said = answered(blocks, ask_words, answer_words, owners, least)
    tables = [stored(word_table(said).select("lang", "id", "a", "phrase", F.col("phrase").alias("last"), none.alias("before"), none.alias("after")), "phrase-1")]
    for k in range(2, longest + 1):
        blocks = next_blocks(blocks, said, renumbered_words if k == 2 else renumbered_pairs)
        said = answered(blocks, ask_pairs, answer_pairs, owners, least)
        found = pair_table(said)
        low = tables[-1]
        head = low.select("lang", F.col("id").alias("left"), F.col("phrase").alias("h_phrase"), F.concat("before", F.array("a")).alias("before"))
        tail = low.select("lang", F.col("id").alias("right"), "last", F.concat("after", F.array("a")).alias("after"))
        both = found.join(head, ["lang", "left"]).join(tail, ["lang", "right"])
        tables.append(stored(both.select("lang", "id", "a", "left", "right", F.concat_ws(" ", "h_phrase", "last").alias("phrase"), "last", "before", "after"), f"phrase-{k}"))
        if tables[-1].isEmpty():
            break
    return tables, totals


def exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def lowest_cut(k: int) -> Column:
    """Of the cuts of a phrase of k words the one with the lowest score, then the fewest first words: struct score, cut, l, r."""
    cuts = [
        F.struct(F.call_function("div", exact(F.col("a")) * 1000 * exact(F.col("n")), exact(F.get("before", F.lit(i - 1))) * exact(F.get("after", F.lit(k - i - 1)))).cast("long").alias("score"), F.lit(i).alias("cut"), F.get("before", F.lit(i - 1)).alias("l"), F.get("after", F.lit(k - i - 1)).alias("r"))
        for i in range(1, k)
    ]
    return F.array_min(F.array(*cuts))


def first_of_each(rows: DataFrame, most: int) -> DataFrame:
    """rows with rank: the first `most` of each lang, in rounds of smaller and smaller numbers of parts."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while parts > 1:
        w = Window.partitionBy("lang", "part").orderBy(*order)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase", F.lit(parts)), F.lit(parts))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("part", "rank")
        parts = parts // 16
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def mine(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of 2 to `longest` words.

    docs: (text, lang). A phrase occurs `least` times or more. It goes if a longer frequent phrase that holds it occurs in at
    least `share` hundredths of its places; as counts only fall with length, one word more decides that.
    """
    tables, totals = frequent(docs, longest, least)
    parts = []
    for k, here in enumerate(tables[1:], 2):
        rows = here.join(totals, "lang").withColumn("low", lowest_cut(k)).select("lang", "id", "phrase", "a", "n", "low.score", "low.l", "low.r")
        if k < len(tables):
            longer = tables[k].select("lang", F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("longer")).groupBy("lang", "id").agg(F.max("longer").alias("longer"))
            rows = rows.join(longer, ["lang", "id"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
        parts.append(rows.select("lang", "phrase", "a", "l", "r", "n", "score"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return first_of_each(every, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
