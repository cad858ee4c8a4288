"""Blocks of tokenised documents, and a two-way exchange between blocks and the owners of keys.

Corpus statistics at the size of the corpus (n-gram counts, document frequencies, the first document of a passage)
are neither broadcast nor joined token by token. A *block* is about a million tokens of whole documents that one task
read. It sends each of its distinct keys (64-bit hashes) once to the key's *owner*, with what the block knows of it.
Owners are ranges of the hash, so a common key costs its owner one row for each block, however often documents have it.
The owner merges what the blocks say and answers each block in the order of its question, so an answer needs no keys.

    docs --mapInArrow--> blocks --shuffle by block--> questions --shuffle by owner--> answers --shuffle by block--> blocks

A block is built once and shuffled once; questions and the meeting with the answers both read that shuffle. Its id covers
its place and its document ids, so if a lost shuffle were worked out anew from rows in another order, answers would be
missing and the job would fail rather than give wrong counts.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens after which a block ends. A document is never split: a longer one is a block of its own.
BLOCK_TOKENS = 1 << 20
#: Bytes of text for each owner of keys.
OWNER_BYTES = 8 << 20
#: Stands for a null id inside blocks; it comes back as null.
NO_ID = np.iinfo(np.int64).max

MESSAGE = "block long, owner long, payload binary"
BLOCK = "block long, data binary"

U64 = np.uint64


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: high bytes are mostly alike."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences."""
    return pack_ints(np.diff(keys, prepend=U64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data, U64), dtype=U64)


def pack_parts(*parts: bytes) -> bytes:
    lengths = np.array([len(parts), *map(len, parts)], np.int64)
    return lengths.tobytes() + b"".join(parts)


def unpack_parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.int64, n, 8)) + 8 * (n + 1)
    starts = [8 * (n + 1), *ends[:-1]]
    return [data[a:b] for a, b in zip(starts, ends, strict=True)]


def mix(values: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values over all bits."""
    x = values.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Numbers(dict):
    """Words to numbers in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Block:
    """Whole documents as numbers of words.

    ids: int64 for each document; lens: its number of tokens; tokens: their numbers, documents one after another;
    words: the words by number; sums: 64-bit hashes of each whole text, two for each document.
    """

    ids: np.ndarray
    lens: np.ndarray
    tokens: np.ndarray
    words: list[bytes]
    sums: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.lens, dtype=np.int64)

    @property
    def starts(self) -> np.ndarray:
        return self.ends - self.lens

    @property
    def doc_of(self) -> np.ndarray:
        """The document of each token, by place in the block."""
        return np.repeat(np.arange(len(self.ids)), self.lens)

    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct whole texts: their hashes in order, each one's smallest id, and each document's text by number."""
        order = np.lexsort((self.sums[:, 1], self.sums[:, 0]))
        ranked = self.sums[order]
        new = np.ones(len(order), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), NO_ID)
        np.minimum.at(least, number, self.ids)
        return np.ascontiguousarray(ranked[new]), least, number

    def word_hashes(self) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in self.words), U64, len(self.words))

    def pack(self) -> bytes:
        sizes = np.fromiter(map(len, self.words), np.uint32, len(self.words))
        text = zstandard.ZstdCompressor(level=1).compress(b"".join(self.words))
        return pack_parts(pack_ints(self.ids), pack_ints(self.lens), pack_ints(self.tokens), pack_ints(sizes), text, self.sums.tobytes())

    @staticmethod
    def unpack(data: bytes) -> Block:
        ids, lens, tokens, sizes, text, sums = unpack_parts(data)
        text = zstandard.ZstdDecompressor().decompress(text)
        ends = np.cumsum(unpack_ints(sizes, np.uint32), dtype=np.int64).tolist()
        words = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        return Block(unpack_ints(ids, np.int64), unpack_ints(lens, np.uint32).astype(np.int64), unpack_ints(tokens, np.uint32), words, np.frombuffer(sums, U64).reshape(-1, 2))


def split_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D."""
    return text.split()


def split_lower(text: bytes) -> list[bytes]:
    """The same with A-Z in lower case."""
    return text.lower().split()


Splitter = Callable[[bytes], list[bytes]]


def _built(batches: Iterable[pa.RecordBatch], split: Splitter) -> Iterator[tuple[int, Block]]:
    """Blocks of the rows (id, text) of one task, with ids."""
    part, n = TaskContext.get().partitionId(), 0
    ids, lens, tokens, words, sums = array("q"), array("I"), array("I"), Numbers(), array("Q")

    def block() -> tuple[int, Block]:
        nonlocal ids, lens, tokens, words, sums, n
        made = Block(np.array(ids, np.int64), np.array(lens, np.uint32), np.array(tokens, np.uint32), list(words), np.array(sums, U64).reshape(-1, 2))
        key = xxhash.xxh3_64_intdigest(made.ids.tobytes() + made.lens.tobytes() + f"{part}/{n}".encode()) >> 1
        ids, lens, tokens, words, sums = array("q"), array("I"), array("I"), Numbers(), array("Q")
        n += 1
        return key, made

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for id_, text in zip(batch.column(0), texts, strict=True):
            raw = text.as_py() or b""
            found = split(raw)
            ids.append(NO_ID if (i := id_.as_py()) is None else i)
            lens.append(len(found))
            tokens.extend(map(words.__getitem__, found))
            sums.append(xxhash.xxh3_64_intdigest(raw))
            sums.append(xxhash.xxh3_64_intdigest(raw, seed=7))
            if len(tokens) >= BLOCK_TOKENS:
                yield block()
    if ids:
        yield block()


def id_column(ids: np.ndarray) -> pd.Series:
    """Ids with nulls where there were none."""
    return pd.Series(ids, dtype="int64").astype("Int64").mask(pd.Series(ids == NO_ID))


def owner_count(docs: DataFrame, text: str = "text") -> int:
    """How many owners: in proportion to the text, so that what an owner gets stays about as large at any size."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(8, -(-int(total) // OWNER_BYTES))


def owner_ranges(keys: np.ndarray, owners: int) -> list[tuple[int, int, int]]:
    """(owner, from, to) for ascending keys; an owner has one range of the hash."""
    width = (1 << 64) // owners + 1
    cuts = np.searchsorted(keys, np.array([i * width for i in range(owners)], U64))
    ends = [*cuts[1:], len(keys)]
    return [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(cuts, ends, strict=True)) if a < b]


Question = Callable[[Block], Iterable[tuple[int, bytes]]]
Answer = Callable[[list[bytes]], Iterable[bytes]]


def ask(packed: DataFrame, question: Question) -> DataFrame:
    """Each block's questions as rows of MESSAGE. packed: blocks()."""

    def asked(batches):
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                if rows := list(question(Block.unpack(data.as_py()))):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), pa.int64()), pa.array([o for o, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["block", "owner", "payload"])

    return packed.mapInArrow(asked, MESSAGE)


def ask_scan(docs: DataFrame, split: Splitter, question: Question) -> DataFrame:
    """The same straight from docs, without a shuffle, where the blocks are shuffled in a later job anyway.

    docs must give the same rows in the same places twice, as a written table does; otherwise the later job fails.
    """

    def asked(batches):
        for key, block in _built(batches, split):
            if rows := list(question(block)):
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array([o for o, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["block", "owner", "payload"])

    return docs.mapInArrow(asked, MESSAGE)


def blocks(docs: DataFrame, split: Splitter) -> DataFrame:
    """Rows of BLOCK, dealt by block. docs: (id long, text string)."""

    def packed(batches):
        for key, block in _built(batches, split):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([block.pack()], pa.binary())], names=["block", "data"])

    return docs.mapInArrow(packed, BLOCK).repartition("block")


def answers(messages: DataFrame, answer: Answer) -> DataFrame:
    """What the owners say: rows of MESSAGE. An answer beyond those to the questions goes to block -1."""

    def answered(pdf: pd.DataFrame) -> pd.DataFrame:
        said = list(answer(list(pdf.payload)))
        to = [*pdf.block, *[-1] * (len(said) - len(pdf))]
        return pd.DataFrame({"block": to, "owner": pdf.owner.iloc[0], "payload": said})

    return messages.groupBy("owner").applyInPandas(answered, MESSAGE)


def meet(packed: DataFrame, said: DataFrame, what: Callable[[int, Block, list[tuple[int, bytes]]], pd.DataFrame], schema: str) -> DataFrame:
    """Each block with its answers (owner, payload), by owner."""

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) != 1:
            raise ValueError(f"{len(left)} blocks for the answers to block {right.block.iloc[0]}: the input isn't read in the same order twice; write it to a table first")
        right = right.sort_values("owner", kind="stable")
        return what(int(left.block.iloc[0]), Block.unpack(left.data.iloc[0]), list(zip(right.owner, right.payload, strict=True)))

    return packed.groupBy("block").cogroup(said.where("block >= 0").groupBy("block")).applyInPandas(met, schema)


# Answers of the two plain kinds: sums of counts, and the smallest id.


def summed(payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of payloads (keys, counts): each one's totals, and the distinct keys with their totals."""
    parts = [unpack_parts(p) for p in payloads]
    keys = [unpack_keys(p[0]) for p in parts]
    counts = np.concatenate([unpack_ints(p[1], np.uint32) for p in parts]).astype(np.int64)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, counts, len(distinct)).astype(np.int64)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return np.split(totals[place], cuts), distinct, totals


def smallest_of_texts(sums: list[np.ndarray], ids: list[np.ndarray]) -> list[np.ndarray]:
    """For each whole text (two hashes) of each array the smallest id that any array has for it."""
    every, values = np.concatenate(sums), np.concatenate(ids)
    order = np.lexsort((every[:, 1], every[:, 0]))
    ranked = every[order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), NO_ID)
    np.minimum.at(least, number, values)
    return np.split(least[number], np.cumsum([len(s) for s in sums])[:-1])
