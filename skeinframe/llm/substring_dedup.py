"""Repeated passages: prefix-partitioned suffix trees over the words of all documents, down to a depth of `window` words.

A *suffix* starts at each word of a document that has at least `window` words left. All suffixes together form a suffix
tree; an internal node at depth `window` or below stands for a passage that occurs more than once, and a run of places
whose suffixes have such a node is a maximal repeat. The tree is never held whole:

1. Leaves first. Every window of the same words has the same *anchor*, its smallest 8-word hash, and anchors are some 20
   times fewer than suffixes. Blocks exchange (blocks.py) how many documents have each anchor. A suffix whose anchor one
   document alone has is a leaf. Copies of a whole text (128-bit hash) of a smaller doc_id need no suffixes either: all
   their windows start there. A block sends each distinct text and each distinct window once, with its smallest doc_id, so
   a text or a passage in a third of all documents costs one row a block.
2. Partition. The other suffixes go to the owner of their prefix. Its length varies so that a prefix's group fits memory:
   8 words, or more where the documents that share the anchor could fill more than GROUP_BYTES (prefix_lengths()), at last
   the whole window, whose group is a row a block.
3. Subtrees. A suffix comes as its prefix and the edges below it, EDGE words each. An owner sorts its suffixes edge by
   edge. The depth to which neighbours agree is that of the node they share; runs that agree down to the window are the
   deep internal nodes, and each gets the smallest doc_id below it.
4. Maximal repeats. A word goes if a window that covers it has a deep node whose smallest doc_id is below the document's
   own. Neighbouring windows join to the longest run, the repeat's extent in this document. Windows are judged on the
   input.

Words, prefixes and edges are known by hashes (64 bits a prefix, 32 an edge): equal windows agree in at least 224 bits.

Cases. Null text: no words. Fewer words than a window: nothing removed. A null doc_id is larger than all others and
never the smaller one. Rows that share a doc_id are one document to each other: neither is smaller. Empty table: no
rows. Extra columns are dropped. Memory: a block and its distinct windows; an owner's groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import blocks as B
from .shared import only

U64 = B.U64
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:int,end:int>>"
#: Words of an anchor and of the shortest prefix, and of an edge below a prefix.
GRAM = 8
EDGE = 7
#: Bytes that the suffixes of one prefix may take, and bytes of a suffix as it travels.
GROUP_BYTES = 4 << 20
SUFFIX_BYTES = 64
STEP = np.array([0x9E3779B97F4A7C15], U64)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on (fewer places at the end)."""
    if len(hashes) < n:
        return hashes[:0]
    powers, have, total, at = STEP, 1, None, 0
    runs = hashes.astype(U64, copy=True)  # runs[i]: polynomial over `have` words from i
    left = n
    while left:
        if left & 1:
            part = runs[at : at + len(hashes) - n + 1]
            total = part.copy() if total is None else total * powers + part
            at += have
        left >>= 1
        if left:
            runs = runs[:-have] * powers + runs[have:]
            powers, have = powers * powers, have * 2
    return B.mix(total)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the n values from each place on."""
    if len(values) < n:
        return values[:0]
    least, have = values, 1
    while 2 * have <= n:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    return np.minimum(least[: len(values) - n + 1], least[n - have :])


def prefix_lengths(window: int) -> list[tuple[int, int]]:
    """(words, documents): prefixes in growing length, each with the documents up to which it is taken.

    A document has few windows of one prefix, so its group takes about SUFFIX_BYTES a document. The shortest prefix is
    left early, so that groups are mostly small; the last one, the whole window, has no limit and needs none.
    """
    most = GROUP_BYTES // SUFFIX_BYTES
    steps = [(GRAM, most // 16), (GRAM + EDGE, most // 4), (GRAM + 2 * EDGE, most)]
    return [(n, m) for n, m in steps if n < window]


def edge_starts(window: int) -> list[int]:
    """Where the edges below the shortest prefix begin; the last one ends with the window, so it may overlap."""
    return sorted({min(i, max(0, window - EDGE)) for i in range(GRAM, window, EDGE)}) or [0]


class Suffixes:
    """The suffixes of a block that have `window` words: their places, documents and anchors."""

    def __init__(self, block: B.Block, window: int):
        self.block, self.window = block, window
        hashes = block.word_hashes()[block.tokens] if len(block.words) else np.zeros(0, U64)
        self.hashes = hashes
        doc = block.doc_of
        place = np.arange(len(doc)) - block.starts[doc]
        self.at = np.flatnonzero(place + window <= block.lens[doc])
        self.doc = doc[self.at]
        self.first = rolling(hashes, GRAM)
        # smallest values are all low ones; mixed, they spread over the owners
        self.anchor = B.mix(sliding_min(self.first, window - GRAM + 1)[self.at]) if len(self.at) else np.zeros(0, U64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and the number of documents here that have each."""
        if not len(self.at):
            return np.zeros(0, U64), np.zeros(0, np.uint32)
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        anchor, doc = self.anchor[new], self.doc[new]
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        keys, counts = np.unique(anchor[new], return_counts=True)
        return keys, counts.astype(np.uint32)

    def shared(self, shared_by: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, ...]:
        """The suffixes left after the leaves went, and their distinct windows.

        shared_by: documents of each of anchors(). copies: whether each document copies one with a smaller id. Gives the
        left ones' indices, each one's number among the distinct windows, and of these, in order of their prefixes, the
        prefix, the edges and the least id.
        """
        keys = np.unique(self.anchor)
        by = shared_by[np.searchsorted(keys, self.anchor)] if len(keys) else np.zeros(0, np.int64)
        left = np.flatnonzero((by > 1) & ~copies[self.doc])
        at, by = self.at[left], by[left]
        label = rolling(self.hashes, self.window)[at] if len(at) else np.zeros(0, U64)
        prefix = label.copy()
        for words, most in reversed(prefix_lengths(self.window)):
            if len(at):
                prefix = np.where(by <= most, rolling(self.hashes, words)[at], prefix)
        order = np.lexsort((label, prefix))
        p, x = prefix[order], label[order]
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (x[1:] != x[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), B.NO_ID)
        np.minimum.at(least, number, self.block.ids[self.doc[left]])
        first = at[order[new]]
        edge = rolling(self.hashes, min(EDGE, self.window))
        edges = [(edge[first + i] >> U64(32)).astype(np.uint32) for i in edge_starts(self.window)]
        return left, number, p[new], np.stack(edges, axis=1) if len(first) else np.zeros((0, len(edges)), np.uint32), least


def leaf_question(window: int, owners: int):
    """Anchors with their numbers of documents, and the hashes and ids of whole texts."""

    def question(block: B.Block):
        anchors, counts = Suffixes(block, window).anchors()
        sums, ids, _ = block.texts()
        said = {o: (anchors[a:b], counts[a:b]) for o, a, b in B.owner_ranges(anchors, owners)}
        texts = {o: (a, b) for o, a, b in B.owner_ranges(np.ascontiguousarray(sums[:, 0]), owners)}
        for o in sorted({*said, *texts}):
            k, n = said.get(o, (anchors[:0], counts[:0]))
            a, b = texts.get(o, (0, 0))
            yield o, B.pack_parts(B.pack_keys(k), B.pack_ints(n), sums[a:b].tobytes(), ids[a:b].tobytes())

    return question


def leaf_answer(payloads: list[bytes]):
    parts = [B.unpack_parts(p) for p in payloads]
    totals, _, _ = B.summed(payloads)
    sums = [np.frombuffer(p[2], U64).reshape(-1, 2) for p in parts]
    for total, own in zip(totals, B.smallest_of_texts(sums, [np.frombuffer(p[3], np.int64) for p in parts]), strict=True):
        yield B.pack_parts(B.pack_ints(total), own.tobytes())


def _heard(block: B.Block, replies: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """From leaf_answer: documents of each anchor, and which documents are copies of smaller ones."""
    parts = [B.unpack_parts(p) for _, p in replies]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(len(block.ids), bool)
    shared_by = np.concatenate([B.unpack_ints(p[0], np.int64) for p in parts])
    least = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])[block.texts()[2]]
    return shared_by, least < block.ids


def suffix_order(prefix: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, edge by edge, and for each but the first the edges that it shares with the one before.

    -1: not even the prefix.
    """
    order = np.lexsort((*edges.T[::-1], prefix))
    ranked = edges[order]
    same = np.cumprod(ranked[1:] == ranked[:-1], axis=1, dtype=np.int8).sum(axis=1)
    return order, np.where(prefix[order][1:] == prefix[order][:-1], same, -1)


def subtree_answer(window: int):
    """Subtrees of the prefixes that one owner has; for each window asked, whether a smaller id is below its deep node."""
    depth = len(edge_starts(window))

    def answer(payloads: list[bytes]):
        parts = [B.unpack_parts(p) for p in payloads]
        ids = [B.unpack_ints(p[2], np.int64) for p in parts]
        prefix = np.concatenate([B.unpack_keys(p[0]) for p in parts])
        edges = np.concatenate([B.unpack_ints(p[1], np.uint32).reshape(depth, -1).T for p in parts])
        order, common = suffix_order(prefix, edges)
        deep = np.append(True, common < depth)  # where the next node at the window's depth begins
        own = np.concatenate(ids)[order]
        least = np.minimum.reduceat(own, np.flatnonzero(deep))
        smaller = np.empty(len(order), bool)
        smaller[order] = least[np.cumsum(deep) - 1] < own
        for part in np.split(smaller, np.cumsum([len(x) for x in ids])[:-1]):
            yield np.packbits(part).tobytes()

    return answer


#: Added to the owners of subtrees, to tell their answers from the first.
SECOND = 1 << 40


def dedup(docs: DataFrame, window: int = 50, texts: bool = True) -> DataFrame:
    """Rows of KEPT for docs (doc_id, text): what is left of each document without its repeated passages.

    texts=False leaves out kept_text and spans (the removed runs of words, end exclusive).
    """
    docs = only(docs, doc_id="long", text="string")
    owners = B.owner_count(docs)
    packed = B.blocks(docs, B.split_words)
    leaves = B.answers(B.ask(packed, leaf_question(window, owners)), leaf_answer)

    def windows(key: int, block: B.Block, replies) -> pd.DataFrame:
        _, _, prefix, edges, least = Suffixes(block, window).shared(*_heard(block, replies))
        rows = [(key, SECOND + o, B.pack_parts(B.pack_keys(prefix[a:b]), B.pack_ints(edges[a:b].T), B.pack_ints(least[a:b]))) for o, a, b in B.owner_ranges(prefix, owners)]
        return pd.DataFrame(rows, columns=["block", "owner", "payload"])

    trees = B.answers(B.meet(packed, leaves, windows, B.MESSAGE), subtree_answer(window))

    def kept(_: int, block: B.Block, replies) -> pd.DataFrame:
        shared_by, copies = _heard(block, [r for r in replies if r[0] < SECOND])
        own = Suffixes(block, window)
        left, number, prefix, _, least = own.shared(shared_by, copies)
        bits = [(np.frombuffer(p, np.uint8), b - a) for (_, p), (_, a, b) in zip([r for r in replies if r[0] >= SECOND], B.owner_ranges(prefix, owners), strict=True)]
        smaller = np.concatenate([np.unpackbits(x, count=n).astype(bool) for x, n in bits]) if bits else np.zeros(0, bool)
        gone = smaller[number] | (least[number] < block.ids[own.doc[left]])
        edges = np.zeros(len(block.tokens) + 1, np.int64)
        starts = own.at[left[gone]]
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + window, -1)
        covered = np.cumsum(edges[:-1]) > 0
        covered |= np.repeat(copies & (block.lens >= window), block.lens)
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), block.starts) * (block.lens > 0) if len(block.ids) else np.zeros(0, np.int64)
        words, tokens = block.words, block.tokens
        rows = []
        for a, b, n in zip(block.starts.tolist(), block.ends.tolist(), removed.tolist(), strict=True):
            part = tokens[a:b] if not n else tokens[a:b][~covered[a:b]]
            text = b" ".join([words[i] for i in part.tolist()])
            digest = hashlib.sha256(text).hexdigest()
            if texts:
                cut = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
                rows.append((digest, text.decode(), [{"start": int(x), "end": int(y)} for x, y in cut.reshape(-1, 2)]))
            else:
                rows.append((digest,))
        out = pd.DataFrame(rows, columns=["kept_sha256", "kept_text", "spans"][: 3 if texts else 1])
        out.insert(0, "n_removed", removed)
        out.insert(0, "n_words", block.lens)
        out.insert(0, "doc_id", B.id_column(block.ids))
        return out

    return B.meet(packed, leaves.unionByName(trees), kept, KEPT if texts else KEPT.split(", kept_text")[0])
