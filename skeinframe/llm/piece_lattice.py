"""SentencePiece encoding and decoding: a relational lattice over the distinct words of a corpus, folded by Spark.

A text is normalised as the model does it (a space in front, spaces as U+2581, nothing else) and falls into *units*: spaces
with the letters, or with the other characters, after them. No piece of the model reaches over a unit's end; that is
checked when it is loaded (a model with other pieces gets longer units, or is refused). Units over LONG characters are
split further, between two characters that stand side by side in no piece.

1. Blocks (blocks.py) of words between spaces send the distinct units of their distinct words to owners, which keep each
   unit of the corpus once.
2. Lattice. A unit's substrings, up to the longest piece, are exploded and equi-joined to the piece table (broadcast; a
   vocabulary over MOST_PIECES is refused). Matches are grouped by unit as edges (start, length, rank of the score). Units
   are partitioned before they are exploded, so neither substrings nor edges are shuffled.
3. Fold. For unigram models a Viterbi fold (`best_path`) takes the edges in order and keeps the best path to each place.
   For BPE models the best path is *not* what the model's own encoder gives: it merges, again and again, the adjacent
   pair with the best score, leftmost first. `merge_path` folds just that over the same lattice: its state is the set of
   remaining boundaries as bits, and one pass over the edges, best first, removes the boundary inside each edge that spans
   two symbols. A merge can make an edge fit that was passed before; such edges hold the symbol just merged, so at most
   `longest` of them follow one another, and they are taken at once, best first. Only pieces that start or end a better
   one can cause that (`precede`), so the search for such edges is rare.
4. The boundaries go back to the blocks, which write ids; characters without a piece become byte pieces.

Units of up to BITS characters have their boundaries in one long, longer ones in an array of longs of 32 bits each; no
length is treated by another method. Decoding joins pieces, byte pieces as UTF-8, drops the space in front and turns
U+2581 into spaces.

Cases. Null or empty text: no pieces, decodes to empty. U+2581 in a text is a space afterwards, as in the library. Null or
repeated doc_id: rows are encoded each. Empty table: no rows. Extra columns are dropped. Very long units: exact; the time
grows with the square of the length of a run of letters without a split, in numbers of 32 characters.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .shared import only

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_PIECES = 1_000_000
#: Units of more characters are split where no piece has the two characters side by side.
LONG = 48
#: Boundaries of so many characters fit one long, beside the rank of a piece.
BITS = 41
#: Characters of the longest piece that a fold's window of bits holds.
LONGEST = 31
#: Starts that one slice of a unit covers, so that a substring is never far from its slice's start.
SLICE = 64
#: Letters (ASCII, or two and more bytes but for U+0080-U+00BF and U+2000-U+2FFF) and other characters apart; else words.
FINE = re.compile(rb" *(?:[A-Za-z]+|[\xc3-\xe1\xe3-\xf4][\x80-\xbf]+)+| *(?:[^A-Za-z \x80-\xff]+|[\xc2\xe2][\x80-\xbf]+)+| +")
COARSE = re.compile(rb" *[^ ]+| +")
MARK = "▁"
ENCODED = "doc_id long, n_pieces long, ids array<int>"


@dataclass
class Model:
    """Pieces with U+2581 as spaces; ids by piece and pieces by id, as bytes. pairs: characters side by side in a piece."""

    scores: dict[str, tuple[int, float]]
    byte_ids: list[int]
    texts: list[bytes]
    merges: bool
    unit: re.Pattern
    pairs: frozenset[str]

    @staticmethod
    def load(path: str = MODEL) -> Model:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(p.get_piece_size())
        plain = [i for i in every if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        names = {i: p.id_to_piece(i).replace(MARK, " ") for i in plain}
        if len(names) > MOST_PIECES:
            raise ValueError(f"{len(names)} pieces; a broadcast table takes {MOST_PIECES}")
        if (longest := max(map(len, names.values()), default=0)) > LONGEST:
            raise ValueError(f"a piece of {longest} characters; the fold takes {LONGEST}")
        unit = next((u for u in (FINE, COARSE) if all(u.fullmatch(x.encode()) for x in names.values())), None)
        if unit is None:
            raise ValueError("a piece reaches from one word into the next")
        texts = [b""] * len(every)
        byte_ids = [0] * 256
        for i in every:
            if p.is_byte(i):
                byte_ids[v := int(p.id_to_piece(i)[1:-1], 16)] = i
                texts[i] = bytes([v])
            elif i in names:
                texts[i] = names[i].encode()
        scores = {x: (i, p.get_score(i)) for i, x in names.items()}
        # merge scores are minus a rank; log probabilities are not whole
        merges = all(s == int(s) for _, s in scores.values())
        pairs = frozenset(x[i : i + 2] for x in scores for i in range(len(x) - 1))
        return Model(scores, byte_ids, texts, merges, unit, pairs)

    def units(self, word: bytes) -> list[bytes]:
        """The units of a space and a word, as words() gives it."""
        found = self.unit.findall(b" " + word)
        if len(word) < LONG:
            return found
        return [part for u in found for part in ([u] if len(u) <= LONG else self.split(u.decode()))]

    def split(self, unit: str) -> list[bytes]:
        """A unit in parts that no piece joins."""
        if len(unit) <= LONG:
            return [unit.encode()]
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.pairs]
        return [unit[a:b].encode() for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.texts[i] for i in ids])
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def words(text: bytes) -> list[bytes]:
    """A text's UTF-8, normalised and cut before each run of spaces, each part without its first space.

    Of several spaces the others stay in front; spaces at the end are a word of their own.
    """
    if not text:
        return []
    text = text.replace(MARK.encode(), b" ")
    return [x[1:] for x in COARSE.findall(b" " + text)] if b"  " in text or text[:1] == b" " else text.split(b" ")


def precede(scores: dict[str, float]) -> set[str]:
    """Pieces that are the start or the end of a piece with a score as good or better."""
    found = set()
    for whole, score in scores.items():
        for i in range(1, len(whole)):
            found.update(x for x in (whole[:i], whole[i:]) if x in scores and scores[x] <= score)
    return found


def piece_table(spark: SparkSession, scores: dict[str, float]) -> tuple[DataFrame, list[float]]:
    """(key, piece, code), broadcast, and the score of each rank: falling, equal scores share a rank.

    key: a 64-bit hash of the piece, which joins faster than a string; matches are verified. code: the rank from bit 43
    on, bit 0 set for the pieces of precede(); an edge has its place in between.
    """
    ranked = sorted(set(scores.values()), reverse=True)
    at = {s: i for i, s in enumerate(ranked)}
    first = precede(scores)
    table = spark.createDataFrame([(x, (at[s] << 43) + (x in first)) for x, s in scores.items()], "piece string, code long")
    return F.broadcast(table.select(F.xxhash64("piece").alias("key"), "piece", "code")), ranked


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by.cast("int"))


def _start(edge: Column) -> Column:
    return F.shiftright(edge, 7).bitwiseAND(F.lit((1 << 36) - 1))


def _length(edge: Column) -> Column:
    return F.shiftright(edge, 1).bitwiseAND(F.lit(63)).cast("int")


def lattice(units: DataFrame, pieces: DataFrame, longest: int, shortest: int = 2, short: int = BITS) -> DataFrame:
    """units (owner, unit), distinct -> (owner, unit, n, edges): every match of a piece, sorted.

    An edge is code | start << 7 | length << 1 in units of more than `short` characters. In others it is code | span << 1
    with the bits of its boundaries, from its start to its end, as the span. Both sort by rank, then by start.

    Rows are dealt out by owner before they are exploded, and grouped within it, so nothing after that is shuffled. A
    match is three numbers; the unit itself travels in one of its rows.
    """
    rows = units.select("owner", "unit").repartition("owner").withColumns({"uid": F.monotonically_increasing_id(), "n": F.length("unit")})
    # explode_outer: for explode() Spark adds a filter that builds each array twice
    slices = rows.select("*", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(SLICE))).alias("o"))
    slices = slices.withColumn("part", F.when(F.col("n") <= SLICE, F.col("unit")).otherwise(F.substring(F.col("unit"), F.col("o") + 1, F.lit(SLICE + longest - 1))))
    starts = slices.select("*", F.explode_outer(F.sequence(F.lit(0), F.least(F.col("n") - F.col("o"), F.lit(SLICE)) - 1)).alias("s"))
    room = F.least(F.col("n") - F.col("o") - F.col("s"), F.lit(longest))
    parts = starts.select("*", F.explode_outer(F.when(room >= shortest, F.sequence(F.lit(shortest), room))).alias("len"))
    part = F.substring(F.col("part"), F.col("s") + 1, F.col("len"))
    joined = parts.join(pieces, F.xxhash64(part) == F.col("key"), "left")
    lead = (F.col("o") == 0) & (F.col("s") == 0) & F.coalesce(F.col("len") == shortest, F.lit(True))
    span = _shift(_shift(F.lit(2).cast("long"), F.col("len")) - 1, F.col("s") + 1)
    place = F.when(F.col("n") <= short, span).otherwise(_shift((F.col("o") + F.col("s")).cast("long"), F.lit(7)) + F.col("len") * 2)
    edge = F.when(F.col("piece") == part, F.col("code") + place)
    found = joined.select("owner", "uid", F.when(lead, F.col("unit")).alias("unit"), edge.alias("edge")).where("edge IS NOT NULL OR unit IS NOT NULL")
    grouped = found.groupBy("owner", "uid").agg(F.max("unit").alias("unit"), F.collect_list("edge").alias("edges"))
    return grouped.select("owner", "unit", F.length("unit").alias("n"), F.sort_array("edges").alias("edges"))


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class _Long:
    """Boundaries of up to BITS characters: bit i of a long. Edges have spans of such bits."""

    every = staticmethod(lambda n: _shift(F.lit(1).cast("long"), n + 1) - 1)
    near = staticmethod(lambda edge: F.col("edges"))
    span = staticmethod(lambda edge: F.shiftright(edge.bitwiseAND(F.lit((1 << 43) - 1)), 1))
    words = staticmethod(lambda state: F.array(state.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(state, 32)))

    @staticmethod
    def ends(span: Column) -> Column:
        low = span.bitwiseAND(-span)
        return low + F.shiftright(span + low, 1)

    @staticmethod
    def fits(state: Column, edge: Column) -> Column:
        """Whether both ends are boundaries still, and one between them."""
        span = _Long.span(edge)
        return (F.bit_count(state.bitwiseAND(span)) == 3) & (state.bitwiseAND(_Long.ends(span)) == _Long.ends(span))

    @staticmethod
    def merged(state: Column, edge: Column) -> Column:
        span = _Long.span(edge)
        return state.bitwiseAND(F.bitwise_not(span - _Long.ends(span)))


class _Blocks:
    """Boundaries of any number of characters: bit i % 32 of the element i / 32 of an array."""

    every = staticmethod(lambda n: F.array_repeat(F.lit(0xFFFFFFFF), (F.floor(n / 32) + 2).cast("int")))
    words = staticmethod(lambda state: state)
    block = staticmethod(lambda edge: F.shiftright(_start(edge), 5).cast("int"))
    # an edge that holds the symbol of another starts in the same block or one beside it
    near = staticmethod(lambda edge: F.flatten(F.slice("blocks", F.greatest(_Blocks.block(edge), F.lit(1)), F.lit(3))))
    offset = staticmethod(lambda edge: _start(edge).bitwiseAND(F.lit(31)).cast("int"))
    end = staticmethod(lambda edge: _shift(F.lit(1).cast("long"), _length(edge)))

    @staticmethod
    def fits(state: Column, edge: Column) -> Column:
        q, r, end = _Blocks.block(edge), _Blocks.offset(edge), _Blocks.end(edge)
        window = F.call_function("shiftright", F.get(state, q), r).bitwiseOR(_shift(F.get(state, q + 1), 32 - r))
        return (window.bitwiseAND(end + 1) == end + 1) & (F.bit_count(window.bitwiseAND(end - 2)) == 1)

    @staticmethod
    def merged(state: Column, edge: Column) -> Column:
        q = _Blocks.block(edge)
        gone = F.bitwise_not(_shift(_Blocks.end(edge) - 2, _Blocks.offset(edge)))
        both = F.array(F.get(state, q).bitwiseAND(gone), F.get(state, q + 1).bitwiseAND(F.shiftright(gone, 32)))
        return F.concat(F.slice(state, F.lit(1), q), both, F.slice(state, q + 3, F.size(state)))


def merge_path(found: DataFrame, longest: int) -> DataFrame:
    """(owner, unit, words) for lattice(): the boundaries 0 to n that BPE merges leave, 32 bits an element."""

    def folded(kind) -> Column:
        def settled(state: Column, edge: Column) -> Column:
            """After the merge of edge: what it made fit among the edges before it is merged, best first."""
            earlier = lambda now: F.filter(kind.near(edge), lambda e: (e < edge) & kind.fits(now, e))
            again = lambda now, _: F.coalesce(_bound(F.array_min(earlier(now)), lambda e: F.when(e.isNotNull(), kind.merged(now, e))), now)
            some = F.exists(kind.near(edge), lambda e: (e < edge) & kind.fits(state, e))
            return F.when(some, F.aggregate(F.sequence(F.lit(1), F.lit(longest)), state, again)).otherwise(state)

        def step(state: Column, edge: Column) -> Column:
            new = kind.merged(state, edge)
            return F.when(kind.fits(state, edge), F.when(edge.bitwiseAND(F.lit(1)) == 1, _bound(new, lambda now: settled(now, edge))).otherwise(new)).otherwise(state)

        return F.aggregate("edges", kind.every(F.col("n")), step, kind.words)

    starts = F.sequence(F.lit(0), (F.floor(F.col("n") / 32)).cast("int"))
    blocks = F.when(F.col("n") > BITS, F.transform(starts, lambda q: F.filter("edges", lambda e: _Blocks.block(e) == q)))
    found = found.withColumn("blocks", blocks)
    return found.select("owner", "unit", F.when(F.col("n") <= BITS, folded(_Long)).otherwise(folded(_Blocks)).alias("words"))


def best_path(found: DataFrame, ranked: list[float], unknown: float) -> DataFrame:
    """(owner, unit, words) for lattice(shortest=1): boundaries of the path with the highest sum of scores.

    A character that is no piece scores `unknown`. Of equal paths the one found first from the left stays.
    """
    scores = F.split(F.lit(",".join(map(repr, ranked))), ",").cast("array<double>")
    edge = lambda p: F.struct(_start(p).cast("int").alias("s"), (_start(p) + _length(p)).cast("int").alias("e"), F.get(scores, F.shiftright(p, 43).cast("int")).alias("score"))
    rows = found.select("owner", "unit", "n", F.transform("edges", edge).alias("edges"))
    missing = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.transform(F.filter("edges", lambda e: e["e"] == e["s"] + 1), lambda e: e["s"]))
    single = F.transform(missing, lambda i: F.struct(i.alias("s"), (i + 1).alias("e"), F.lit(unknown).alias("score")))
    rows = rows.select("owner", "unit", "n", F.array_sort(F.concat("edges", single)).alias("edges"))
    place = F.struct(F.lit(None).cast("double").alias("score"), F.lit(0).alias("from"))
    start = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from"))), F.array_repeat(place, F.col("n")))

    def step(best: Column, e: Column) -> Column:
        score = F.get(best, e["s"])["score"] + e["score"]
        old = F.get(best, e["e"])["score"]
        new = F.array(F.struct(score.alias("score"), e["s"].alias("from")))
        return F.when(old.isNull() | (score > old), F.concat(F.slice(best, F.lit(1), e["e"]), new, F.slice(best, e["e"] + 2, F.size(best)))).otherwise(best)

    rows = rows.select("owner", "unit", "n", F.aggregate("edges", start, step).alias("best"))
    back = lambda a, _: F.when(a["at"] > 0, F.struct(F.get("best", a["at"])["from"].alias("at"), F.concat(F.array(a["at"]), a["ends"]).alias("ends"))).otherwise(a)
    rows = rows.select("owner", "unit", "n", F.aggregate(F.sequence(F.lit(1), F.col("n")), F.struct(F.col("n").alias("at"), F.array().cast("array<int>").alias("ends")), back, lambda a: a["ends"]).alias("ends"))
    bit = lambda a, e, k: a + F.when(F.shiftright(e, 5) == k, _shift(F.lit(1).cast("long"), e.bitwiseAND(F.lit(31)))).otherwise(F.lit(0).cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), (F.floor(F.col("n") / 32) + 1).cast("int")), lambda k: F.aggregate("ends", F.lit(0).cast("long"), lambda a, e: bit(a, e, k)))
    return rows.select("owner", "unit", blocks.alias("words"))


def segment(units: DataFrame, scores: dict[str, float], merges: bool, unknown: float | None = None) -> DataFrame:
    """(owner, unit, words) for distinct, non-empty units (owner, unit): words[i / 32] has bit i % 32 set for each boundary i.

    unknown: by default 10 below the lowest score.
    """
    pieces, ranked = piece_table(units.sparkSession, scores)
    longest = max(map(len, scores), default=1)
    if merges:
        return merge_path(lattice(units, pieces, longest), longest)
    return best_path(lattice(units, pieces, longest, 1, 0), ranked, min(ranked, default=0.0) - 10 if unknown is None else unknown)


def _block_units(block: B.Block, model: Model) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct units of a block, in the order of their hashes, the hashes, each word's number of units, and their numbers."""
    known = B.Numbers()
    odd = [i for i, w in enumerate(block.words) if len(w) >= LONG or w[:1] in (b"", b" ")]
    plain = block.words
    if odd:
        plain = list(block.words)
        for i in odd:
            plain[i] = b"x"  # one unit, which is put right below
    # other words neither start with a space nor are empty, so all can be cut at once: a unit with a space begins a word
    found = model.unit.findall(b" " + b" ".join(plain)) if plain else []
    number = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
    begins = np.flatnonzero(np.fromiter((u[0] == 32 for u in found), bool, len(found)))
    count = np.diff(np.append(begins, len(found)))
    if odd:
        parts, at = [], 0
        for i in odd:
            own = np.array([known[u] for u in model.units(block.words[i])], np.int64)
            parts += [number[at : begins[i]], own]
            at = begins[i] + count[i]
            count[i] = len(own)
        number = np.concatenate([*parts, number[at:]])
    units = list(known)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, len(units))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [units[i] for i in order.tolist()], hashes[order], count, place[number]


def _ask_units(model: Model, owners: int):
    def question(block: B.Block):
        units, hashes, _, _ = _block_units(block, model)
        for owner, a, b in B.owner_ranges(hashes, owners):
            yield owner, _pack_units(units[a:b])

    return question


def _pack_units(words: list[bytes]) -> bytes:
    return B.pack_parts(B.pack_ints(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.ZstdCompressor(level=3).compress(b"".join(words)))


def _unpack_units(data: bytes) -> list[bytes]:
    sizes, text = B.unpack_parts(data)
    text = zstandard.ZstdDecompressor().decompress(text)
    ends = np.cumsum(B.unpack_ints(sizes, np.uint32), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _encode(docs: DataFrame, model: Model, what, schema: str) -> DataFrame:
    """what(block, ids of its words, bytes that they decode to) for each block, with rows of schema."""
    docs = only(docs, doc_id="long", text="string")
    owners = B.owner_count(docs)
    packed = B.blocks(docs, words)
    asked = B.ask(packed, _ask_units(model, owners))

    def distinct(pdf: pd.DataFrame) -> pd.DataFrame:
        found = set().union(*map(_unpack_units, pdf.payload))
        return pd.DataFrame({"owner": pdf.owner.iloc[0], "unit": [w.decode() for w in found]})

    units = asked.groupBy("owner").applyInPandas(distinct, "owner long, unit string")
    bounds = segment(units, {x: s for x, (_, s) in model.scores.items()}, model.merges)

    bits = F.get("words", F.lit(0)) + F.shiftleft(F.get("words", F.lit(1)), 32)
    bounds = bounds.select("owner", "unit", bits.alias("bits"), F.when(F.size("words") > 2, F.col("words")).alias("words"))

    def reply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip((u.encode() for u in right.unit), right.bits.tolist(), strict=True))
        long = right[right.words.notna()]
        more = dict(zip((u.encode() for u in long.unit), long.words, strict=True))
        payloads = []
        for asked_for in map(_unpack_units, left.payload):
            rest = [np.asarray(more[u], np.int64) for u in asked_for if u in more] if more else []
            payloads.append(B.pack_parts(B.pack_ints(np.fromiter((known[u] for u in asked_for), np.int64, len(asked_for))), B.pack_ints(np.concatenate([*rest, np.zeros(0, np.int64)]))))
        return pd.DataFrame({"block": left.block, "owner": left.owner, "payload": payloads})

    replies = asked.groupBy("owner").cogroup(bounds.groupBy("owner")).applyInPandas(reply, B.MESSAGE)

    def met(_: int, block: B.Block, said) -> pd.DataFrame:
        units, _, count, inside = _block_units(block, model)
        parts = [B.unpack_parts(p) for _, p in said]
        ids = _unit_ids(units, model, *[np.concatenate([*[B.unpack_ints(p[i], np.int64) for p in parts], np.zeros(0, np.int64)]) for i in range(2)])
        flat = _Ragged.of(count, inside)
        return what(block, flat.through(ids), units, ids, flat)

    return B.meet(packed, replies, met, schema)


@dataclass
class _Ragged:
    """Lists of numbers, one after another."""

    first: np.ndarray
    size: np.ndarray
    flat: np.ndarray

    @staticmethod
    def of(size: np.ndarray, flat: np.ndarray) -> _Ragged:
        return _Ragged(np.cumsum(size) - size, size, flat)

    def pick(self, which: np.ndarray) -> _Ragged:
        """The lists of these numbers, in this order."""
        n = self.size[which]
        at = np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return _Ragged.of(n, self.flat[at])

    def through(self, other: _Ragged) -> _Ragged:
        """Each list with its numbers replaced by the other's lists of these numbers."""
        deep = other.pick(self.flat)
        ends = np.append(0, np.cumsum(deep.size))
        return _Ragged.of(ends[self.first + self.size] - ends[self.first], deep.flat)


def _unit_ids(units: list[bytes], model: Model, bits: np.ndarray, rest: np.ndarray) -> _Ragged:
    """Ids of each unit from its boundaries: in `bits`, or for more than BITS characters in `rest`, 32 an element."""
    texts = [u.decode() for u in units]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    words = bits.astype("<i8").view("<u4").reshape(-1, 2)
    length = np.full(len(texts), 2)
    if len(rest):
        length = np.where(size > BITS, size // 32 + 2, 2)
        cuts = np.cumsum(np.where(size > BITS, length, 0)).tolist()
        words = np.concatenate([words[i] if n <= BITS else rest[e - n // 32 - 2 : e].astype("<u4") for i, (n, e) in enumerate(zip(size.tolist(), cuts, strict=True))])
    first = np.cumsum(length) - length
    at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).reshape(-1).view(np.uint8), bitorder="little"))
    unit = np.repeat(np.arange(len(texts)), length)[at >> 5]
    end = at - 32 * first[unit]
    inside = (end > 0) & (end <= size[unit])
    unit, end = unit[inside], end[inside]
    start = np.zeros_like(end)
    start[1:] = np.where(unit[1:] == unit[:-1], end[:-1], 0)
    known = {x: i for x, (i, _) in model.scores.items()}
    found = np.fromiter((known.get(texts[u][a:b], -1) for u, a, b in zip(unit.tolist(), start.tolist(), end.tolist(), strict=True)), np.int64, len(unit))
    if (found < 0).any():  # characters without a piece become the pieces of their bytes
        none = np.flatnonzero(found < 0).tolist()
        parts = [[model.byte_ids[x] for x in texts[unit[i]][start[i] : end[i]].encode()] for i in none]
        more = np.ones(len(found), np.int64)
        more[none] = [len(p) for p in parts]
        found, unit = np.repeat(found, more), np.repeat(unit, more)
        found[found < 0] = list(chain.from_iterable(parts))
    return _Ragged.of(np.bincount(unit, minlength=len(texts)), found)


def _by_document(block: B.Block, ids: _Ragged):
    """Each document's ids as an int32 array."""
    pieces = ids.pick(block.tokens)
    ends = np.append(0, np.cumsum(pieces.size))
    flat = pieces.flat.astype(np.int32)
    for a, b in zip(ends[block.starts].tolist(), ends[block.ends].tolist(), strict=True):
        yield flat[a:b]


def encode(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows of ENCODED for docs (doc_id, text)."""
    model = model or Model.load()

    def rows(block: B.Block, ids: _Ragged, *_) -> pd.DataFrame:
        found = list(_by_document(block, ids))
        return pd.DataFrame({"doc_id": B.id_column(block.ids), "n_pieces": [len(x) for x in found], "ids": found})

    return _encode(docs, model, rows, ENCODED)


def decode(encoded: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids)."""
    model = model or Model.load()

    def texts(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else model.decode(list(x)) for x in ids], dtype=object)

    return encoded.select("doc_id", F.pandas_udf(texts, "string")("ids").alias("text"))


def digests(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, text_sha256, round_trip): ids as little-endian int32; text as decoded from them."""
    model = model or Model.load()

    def rows(block: B.Block, ids: _Ragged, units: list[bytes], unit_ids: _Ragged, inside: _Ragged) -> pd.DataFrame:
        out = []
        pieces = [model.texts[i] for i in unit_ids.flat.tolist()]
        ends = np.append(0, np.cumsum(unit_ids.size)).tolist()
        back = [b"".join(pieces[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        same = np.fromiter((a == b for a, b in zip(back, units, strict=True)), bool, len(units))
        # a word of units that came back as they were came back as it was
        right = np.logical_and.reduceat(same[inside.flat], inside.first) if len(inside.flat) else np.zeros(0, bool)
        decoded = [b" " + w for w in block.words]
        for i in np.flatnonzero(~right).tolist():
            decoded[i] = b"".join([back[j] for j in inside.flat[inside.first[i] : inside.first[i] + inside.size[i]].tolist()])
        for own, a, b in zip(_by_document(block, ids), block.starts.tolist(), block.ends.tolist(), strict=True):
            tokens = block.tokens[a:b]
            text = b"".join([decoded[i] for i in tokens.tolist()])[1:]
            out.append((len(own), hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest(), bool(right[tokens].all())))
        frame = pd.DataFrame(out, columns=["n_pieces", "ids_sha256", "text_sha256", "round_trip"])
        frame.insert(0, "doc_id", B.id_column(block.ids))
        return frame

    return _encode(docs, model, rows, "doc_id long, n_pieces long, ids_sha256 string, text_sha256 string, round_trip boolean")
