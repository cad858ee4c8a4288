"""Language-model scores of whole texts: a weighted backoff automaton over smoothed n-grams.

Training text is every document whose crc32(doc_id as text) mod 7 is not 2. Tokens are the words (runs other than space
and 0x09-0x0D, A-Z in lower case) and one end for each document.

Smoothing. With c an n-gram's count, h its history and s(h) the history without its first word:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + mu * p(w | s(h))) / (c(h) + mu)

The automaton's states are the histories seen in training, with the empty one as root. A state has an arc for each word
seen after it, weighted log10 p(w | h), and a failure arc to s(h), weighted log10(mu / (c(h) + mu)): exactly what the
formula leaves a word without an arc. An arc for w leads to the longest suffix of h w that is a state.

A text is read once from left to right: the state is carried from token to token, failure arcs are followed until a
state has an arc for the token, and the log-probabilities add up. A block's texts are read side by side, one token of each
at a time, with their states in one array.

At scale, n-gram counts are not collected anywhere: blocks.py sends each block's distinct n-grams to the owners of their
hashes, and the counts come back. Both the counts gathered and the states of a block follow the size of the input. First
one and two words are counted. Longer n-grams follow by length, and only those are sent whose two parts, without the last
and without the first word, occur more than once in all documents: of the others the only occurrence is the one at hand.
N-grams are known by 64-bit hashes.

Cases. Null text: empty, one end token. Empty table: no rows. Null doc_id: part of training, held_out false. Rows that
share a doc_id are scored each by itself and all count. Extra columns are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .shared import cut, only

U64 = B.U64
END = U64(0x5EED0FE2D0FDAC5D)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(ids: np.ndarray, folds: int, fold: int) -> np.ndarray:
    return np.array([i != B.NO_ID and zlib.crc32(str(i).encode()) % folds == fold for i in ids.tolist()], bool)


def grams(block: B.Block, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 1 to order: keys of the n-grams that end at each token, and whether the document reaches so far back.

    Also the document of each token (its end included), and where documents end. The lowest bit tells single tokens.
    """
    lens = block.lens + 1
    doc = np.repeat(np.arange(len(lens)), lens)
    ends = np.cumsum(lens)
    hashes = np.full(len(doc), END)
    inner = np.ones(len(doc), bool)
    inner[ends - 1] = False
    hashes[inner] = block.word_hashes()[block.tokens] if len(block.words) else hashes[inner]
    place = np.arange(len(doc)) - np.repeat(ends - lens, lens)
    keys, there = [B.mix(hashes)], [np.ones(len(doc), bool)]
    for n in range(2, order + 1):
        longer = np.zeros_like(hashes)
        longer[1:] = B.mix(keys[-1][:-1] * U64(0x9E3779B97F4A7C15) + keys[0][1:] + U64(n))
        keys.append(longer)
        there.append(place >= n - 1)
    return [k & ~U64(1) | U64(n == 0) for n, k in enumerate(keys)], there, doc, ends


#: An n-gram's owner is this times n, and the number of its range of hashes.
ROUND = 1 << 40


def _cut_up(n: int, keys: np.ndarray, learned: np.ndarray, others: np.ndarray, owners: int):
    """Questions for ascending keys with their counts in training and in other documents."""
    learned, others = learned.astype(np.uint32), others.astype(np.uint32)
    for owner, a, b in B.owner_ranges(keys, owners):
        yield n * ROUND + owner, B.pack_parts(B.pack_keys(keys[a:b]), B.pack_ints(learned[a:b]), B.pack_ints(others[a:b]))


class Known:
    """Counts in training of the n-grams of one block: of each token's n-gram, for n = 1, 2 and so on, as far as replies go."""

    def __init__(self, block: B.Block, order: int, folds: int, fold: int):
        self.keys, self.there, self.doc, self.ends = grams(block, max(order, 2))
        self.learned = ~held_out(block.ids, folds, fold)[self.doc]
        self.counts: list[np.ndarray] = []
        self.again = np.zeros(0, bool)  # of each token's last n-gram, whether documents have it more than once
        # a block knows its words by number, so single tokens need no sorting of the text
        inner = np.ones(len(self.doc), bool)
        inner[self.ends - 1] = False
        number = np.full(len(self.doc), len(block.words))
        number[inner] = block.tokens
        words = B.mix(np.append(block.word_hashes(), END)) & ~U64(1) | U64(1)
        order_ = np.argsort(words, kind="stable")
        rank = np.empty(len(order_), np.int64)
        rank[order_] = np.arange(len(order_))
        self.words, self.word = words[order_], rank[number]

    def open(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the next n: the distinct keys of n-grams that may occur elsewhere too, the tokens that end one, their keys' places."""
        n = len(self.counts)
        if n == 0:
            return self.words, np.arange(len(self.doc)), self.word
        wanted = self.there[n].copy()
        if n > 1:
            wanted[1:] &= self.again[:-1] & self.again[1:]
        at = np.flatnonzero(wanted)
        keys, place = np.unique(self.keys[n][at], return_inverse=True)
        return keys, at, place

    def ask(self, owners: int):
        """The keys of open() with their counts in this block."""
        keys, at, place = self.open()
        learned = self.learned[at]
        return _cut_up(len(self.counts) + 1, keys, np.bincount(place[learned], minlength=len(keys)), np.bincount(place[~learned], minlength=len(keys)), owners)

    def next(self, payloads: list[bytes]) -> None:
        """Counts of the next n from the answers to ask()."""
        keys, at, place = self.open()
        parts = [B.unpack_parts(p) for p in payloads]
        counts = np.concatenate([*[B.unpack_ints(p[0], np.int64) for p in parts], np.zeros(0, np.int64)])
        again = np.concatenate([*[B.unpack_ints(p[1], np.uint8) for p in parts], np.zeros(0, np.uint8)]).astype(bool)
        if len(counts) != len(keys):
            raise ValueError("answers don't fit the block")
        n = len(self.counts)
        found = (self.there[n] & self.learned).astype(np.int64)  # what isn't asked for occurs here only
        found[at] = counts[place]
        self.again = np.zeros(len(found), bool)
        self.again[at] = again[place]
        self.counts.append(found)


def count_question(owners: int, folds: int, fold: int):
    """One and two words."""

    def question(block: B.Block):
        own = Known(block, 2, folds, fold)
        yield from own.ask(owners)
        own.counts.append(own.keys[0])  # only their number counts here
        yield from own.ask(owners)

    return question


def plain_answer(payloads: list[bytes]):
    """For each question: counts in training over the corpus, and whether all documents have more than one."""
    totals, _, _ = B.summed(payloads)
    others, _, _ = B.summed([B.pack_parts(keys, rest) for keys, _, rest in map(B.unpack_parts, payloads)])
    for t, o in zip(totals, others, strict=True):
        yield B.pack_parts(B.pack_ints(t), B.pack_ints((t + o > 1).astype(np.uint8)))


def count_answer(payloads: list[bytes]):
    """plain_answer(), and last, for block -1, the owner's training tokens and distinct ones."""
    yield from plain_answer(payloads)
    _, distinct, all_ = B.summed(payloads)
    single = all_[((distinct & U64(1)) == 1) & (all_ > 0)]
    yield f"{single.sum()} {np.count_nonzero(single)}".encode()


class Automaton:
    """States, arcs and failure arcs for the n-grams of one block.

    The n words before a token are a state if training has them. arc[n][i]: log10 weight of the arc of token i from the
    state of the n words before it; has[n][i]: whether it is there; fall[n][i]: weight of that state's failure arc to the
    n - 1 words before i.
    """

    def __init__(self, counts: list[np.ndarray], seen: np.ndarray, total: int, distinct: int, mu: float):
        """counts: of each token's n-gram, by n; seen: whether training has the token."""
        self.seen = seen
        p = (counts[0] + 1.0) / (total + distinct + 1.0)
        self.arc, self.has, self.fall = [np.log10(p)], [np.ones(len(p), bool)], [np.zeros(len(p))]
        for shorter, longer in zip(counts, counts[1:], strict=False):
            history = np.zeros(len(p))
            history[1:] = shorter[:-1]
            p = (longer + mu * p) / (history + mu)
            self.arc.append(np.log10(p))
            self.has.append(longer > 0)
            self.fall.append(np.log10(mu / (history + mu)))

    def read(self, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """log10 probability of each text (tokens from starts[i] on), by one traversal with a carried state.

        A state is known by the number of its words; they are the last ones read.
        """
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        longest = len(self.arc) - 1
        state, total = np.zeros(len(lens), np.int64), np.zeros(len(lens))
        active = len(lens)
        for t in range(int(lens[0]) if len(lens) else 0):
            while lens[active - 1] <= t:
                active -= 1
            i, here, added = starts[:active] + t, state[:active], total[:active]
            for n in range(longest, 0, -1):
                at = here == n
                fails = at & ~self.has[n][i]
                added += np.where(at, np.where(fails, self.fall[n][i], self.arc[n][i]), 0.0)
                here[fails] = n - 1
                # where an arc was taken the next state is one word longer, up to the longest; marked apart until all is done
                here[at & ~fails] = -min(n + 1, longest)
            root = here == 0
            added[root] += self.arc[0][i[root]]
            # from the root the next state is the token itself, if training has it
            here[root] = np.where(self.seen[i[root]], -min(1, longest), 0) if longest else 0
            np.negative(here, out=here)
        out = np.empty(len(lens))
        out[order] = total
        return out


def scores(docs: DataFrame, order: int = 3, mu: float = 5.0, folds: int = 7, fold: int = 2) -> DataFrame:
    """Rows of SCORES for docs (doc_id, text): base_score by add-one unigrams, score by the automaton.

    mu: chosen on held-out documents, log10 per token -4.13 at 5, -4.31 at 2 (sf0.1). train_tokens is N; n_known counts the tokens with c > 0.
    """
    docs = only(docs, doc_id="long", text="string")
    owners = B.owner_count(docs)
    packed = B.blocks(docs, B.split_lower)
    said = cut(B.answers(B.ask_scan(docs, B.split_lower, count_question(owners, folds, fold)), count_answer))
    sums = F.split(F.col("payload").cast("string"), " ")
    total, distinct = said.where("block < 0").agg(F.coalesce(F.sum(sums[0].cast("long")), F.lit(0)), F.coalesce(F.sum(sums[1].cast("long")), F.lit(0))).first()
    said = said.where("block >= 0")

    def known(block: B.Block, replies, upto: int) -> Known:
        """Counts up to n-grams of `upto` words; the owner of a reply tells its n."""
        own = Known(block, order, folds, fold)
        for n in range(1, upto + 1):
            own.next([p for o, p in replies if o // ROUND == n])
        return own

    def asking(n: int):
        def ask(key: int, block: B.Block, replies) -> pd.DataFrame:
            rows = [(key, owner, payload) for owner, payload in known(block, replies, n - 1).ask(owners)]
            return pd.DataFrame(rows, columns=["block", "owner", "payload"])

        return ask

    for n in range(3, order + 1):
        said = said.unionByName(B.answers(B.meet(packed, said, asking(n), B.MESSAGE), plain_answer))

    def scored(_: int, block: B.Block, replies) -> pd.DataFrame:
        own = known(block, replies, order)
        starts = own.ends - block.lens - 1
        c = own.counts[0]
        base = np.log10((c + 1.0) / (total + distinct + 1.0))
        automaton = Automaton(own.counts[:order], c > 0, total, distinct, mu)
        return pd.DataFrame({
            "doc_id": B.id_column(block.ids), "held_out": held_out(block.ids, folds, fold), "n_tokens": block.lens + 1, "n_known": np.add.reduceat((c > 0).astype(np.int64), starts),
            "train_tokens": total, "base_score": np.add.reduceat(base, starts), "score": automaton.read(starts, block.lens + 1),
        })

    return B.meet(packed, said, scored, SCORES)
