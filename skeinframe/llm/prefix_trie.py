"""The trie of conversation prefixes: splitter-skeleton.

A conversation is the path of its turns' keys (128 bits of the SHA-256 of role and text). Every distinct beginning of a path
is a node. Paths are sorted over range shards. A node that members in two shards share is a beginning of the splitter between
them, as members on both sides of a splitter can only have in common what the splitter has too. So:

1. Splitters come from a bounded sample of the paths; they only decide how evenly shards are filled. The trie of their
   beginnings, the skeleton, is broadcast: at most MOST_SHARDS splitters of DEEPEST turns, some 11 MB.
2. Each shard reads its sorted paths once, holding one path's open nodes, and finishes all its nodes outside the skeleton.
   Of a skeleton node it gives what it knows: members, smallest member, finished children, leaves and savings below.
3. Skeleton nodes add up their partial rows; what they are themselves (leaf, own savings) goes to all skeleton nodes above.

Paths end with their conversation's id, so a splitter can fall between equal paths: copies of one conversation spread over
shards like anything else, and a node's members that end there come in order of their ids.

Bounds. A task holds one path (21 bytes a turn) and the finished children of its open nodes, never more than its shard.
Copies of paths that share more than DEEPEST turns can't be split inside that beginning; such a shard is longer, not larger
in memory. The ids that end at a node are hashed one after another as a stream.

Cases. Turns by turn number, null first, equal ones by key; null role or text: empty. Rows without conv_id belong to no
conversation and are left out. Repeated rows are turns like others. A conversation without turns is a member of the root.
No conversations: no nodes. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chat_format import batches_of
from .shared import new_folder

#: Turns of a shard.
SHARD_TURNS = 20_000
#: Shards at most; their splitters are broadcast.
MOST_SHARDS = 10_000
#: Turns of a splitter at most.
DEEPEST = 64
#: Sampled paths for each splitter.
OVERSAMPLE = 8
#: Ids in one row of those that end at a skeleton node.
CHUNK = 1 << 16
#: Bytes of a turn in a sort key: 1 and the key. A path ends with 0 and its conversation's id, 9 bytes.
STEP, TAIL = 17, 9
EMPTY = hashlib.sha256(b"").hexdigest()

LONG = pa.int64()
FOUND = pa.schema([
    ("kind", LONG), ("at", LONG), ("shard", LONG), ("conv_id", LONG), ("depth", LONG), ("parent_conv_id", LONG), ("n_convs", LONG), ("n_children", LONG), ("n_leaves", LONG), ("saved_tokens", LONG),
    ("size", LONG), ("ends_sha256", pa.string()), ("turn_key", pa.binary()), ("above", pa.list_(LONG)), ("chunk", LONG), ("ids", pa.string()),
])
FOUND_SCHEMA = "kind long, at long, shard long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string, turn_key binary, above array<long>, chunk long, ids string"
#: Kinds of rows: finished; finished but for the parent, a skeleton node; a shard's part of a skeleton node; ids that end there.
DONE, HANGING, PART, ENDS = 0, 1, 2, 3


def paths(conversations: DataFrame, near: int = 1) -> DataFrame:
    """(base, conv_id, turns array<struct<turn, key, size>>): each conversation's turns in order.

    key: 32 hex digits of role and text, size: UTF-8 bytes of the text. Conversations of one base (conv_id less its
    remainder by `near`) are in one partition.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(
        (conv - conv % near).alias("base"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32).alias("key"), F.octet_length(text).cast("long").alias("size"),
    ).where("conv_id IS NOT NULL")
    turns = F.sort_array(F.collect_list(F.struct("turn", "key", "size"))).alias("turns")
    return rows.repartition("base").groupBy("base", "conv_id").agg(turns)


def grafted(found: DataFrame, most: int = 9) -> DataFrame:
    """paths() in which each conversation begins with the first h turns of its base: h = crc32(conv_id) % most.

    Its own first h turns go; a base that isn't there gives none.
    """
    heads = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.slice("turns", 1, 0)
    rows = found.withColumn("head", heads).withColumn("h", h)
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).otherwise(none)
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), own).alias("turns"))


def sort_keys(found: DataFrame) -> DataFrame:
    """(conv_id, key binary, sizes): a path as bytes whose order is that of paths, then of ids."""
    steps = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("01"), t["key"])), "")
    id_ = F.lpad(F.hex(F.col("conv_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return found.select("conv_id", F.unhex(F.concat(steps, F.lit("00"), id_)).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    most = min(len(a), len(b)) // STEP
    if a[: most * STEP] == b[: most * STEP]:
        same = most
    else:
        low, high = 0, most - 1
        while low < high:  # the largest number of turns that are alike
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[: mid * STEP] == b[: mid * STEP] else (low, mid - 1)
        same = low
    while same and a[(same - 1) * STEP] == 0:
        same -= 1
    return same


def turns_in(key: bytes) -> int:
    """Whole turns of a splitter, which may be cut off anywhere."""
    n = 0
    while len(key) >= (n + 1) * STEP and key[n * STEP] == 1:
        n += 1
    return n


def skeleton(splitters: list[bytes], deepest: int) -> list[list[int]]:
    """For each splitter the numbers of its beginnings of 0, 1, ... turns; equal beginnings have one number."""
    out: list[list[int]] = []
    for i, s in enumerate(splitters):
        same = min(common(splitters[i - 1], s), len(out[-1]) - 1) if i else 0
        own = out[-1][: same + 1] if i else [0]
        out.append(own + [i * (deepest + 1) + k for k in range(len(own), turns_in(s) + 1)])
    return out


class Open:
    """A node on the current path."""

    __slots__ = ("above", "children", "digest", "ends", "first", "key", "leaves", "n", "on_left", "on_right", "pending", "saved", "size")

    def __init__(self, key: bytes | None, size: int, on_left: bool, on_right: bool, above: list[int] | None):
        self.key, self.size, self.on_left, self.on_right, self.above = key, size, on_left, on_right, above
        self.first, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.digest, self.pending = 0, None, []


def shard_nodes(rows: Iterable[tuple[int, bytes, list[int]]], shard: int, left: bytes, right: bytes, left_ids: list[int], right_ids: list[int]) -> Iterator[tuple]:
    """Rows of FOUND from one shard's (conv_id, key, sizes) in order of key.

    left, right: the splitters at its ends (b"" at the outer ends), left_ids, right_ids: the numbers of their beginnings.
    """
    ids: dict[int, list[int]] = {}  # ids that end at open skeleton nodes, by depth
    chunks: dict[int, int] = {}
    stack = [Open(None, 0, True, True, [0])]
    last = b""

    def give_ids(depth: int) -> Iterator[tuple]:
        held = ids.pop(depth, [])
        if held:
            at = stack[depth].above[-1]
            yield (ENDS, at, shard, *[None] * 11, chunks.get(depth, 0), ",".join(map(str, held)))
            chunks[depth] = chunks.get(depth, 0) + 1

    def close() -> Iterator[tuple]:
        depth = len(stack) - 1
        node = stack[-1]
        if node.above is not None:
            yield from give_ids(depth)
            chunks.pop(depth, None)
            yield (PART, node.above[-1], shard, node.first, depth, None, node.n, node.children, node.leaves, node.saved, node.size, None, node.key, node.above, None, None)
            stack.pop()
            if stack:
                up = stack[-1]
                up.n += node.n
                up.first = node.first if up.first is None else min(up.first, node.first)
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        for row in node.pending:
            yield (*row[:5], node.first, *row[6:])
        stack.pop()
        up = stack[-1]
        sha = node.digest.hexdigest() if node.digest else EMPTY
        row = (DONE, None, shard, node.first, depth, None, node.n, node.children, leaves, saved, node.size, sha, node.key, None, None, None)
        if up.above is None:
            up.pending.append(row)
        else:
            yield (HANGING, up.above[-1], *row[2:])
        up.n += node.n
        up.first = node.first if up.first is None else min(up.first, node.first)
        up.children += 1
        up.leaves += leaves
        up.saved += saved

    n_rows = 0
    for conv, key, sizes in rows:
        n_rows += 1
        depth = (len(key) - TAIL) // STEP
        same = min(common(last, key), depth, len(stack) - 1)
        while len(stack) - 1 > same:
            yield from close()
        for d in range(same, depth):
            up = stack[-1]
            here = key[d * STEP : (d + 1) * STEP]
            on_left = up.on_left and left[d * STEP : (d + 1) * STEP] == here
            on_right = up.on_right and right[d * STEP : (d + 1) * STEP] == here
            above = [*up.above, (left_ids if on_left else right_ids)[d + 1]] if on_left or on_right else None
            stack.append(Open(here[1:], sizes[d], on_left, on_right, above))
        node = stack[-1]
        node.n += 1
        node.first = conv if node.first is None else min(node.first, conv)
        if node.above is not None:
            held = ids.setdefault(depth, [])
            held.append(conv)
            if len(held) >= CHUNK:
                yield from give_ids(depth)
        elif node.digest is None:
            node.digest = hashlib.sha256(str(conv).encode())
        else:
            node.digest.update(f",{conv}".encode())
        last = key
    while stack and n_rows:
        yield from close()


def nodes(found: DataFrame, shard_turns: int = SHARD_TURNS, deepest: int = DEEPEST) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, turn_key (of its last turn, null for the root).

    found: (conv_id, turns array<struct<key string, size long>>), a row for each conversation.
    """
    spark = found.sparkSession
    folder = new_folder(spark, "trie-paths")
    sort_keys(found).write.parquet(folder)
    keys = spark.read.schema("conv_id long, key binary, sizes array<long>").parquet(folder)
    n, turns = keys.agg(F.count("*"), F.sum(F.size("sizes") + 1)).first()
    shards = max(1, min(MOST_SHARDS, -(-int(turns or 0) // shard_turns)))
    splitters: list[bytes] = []
    if shards > 1:
        # a sample of bounded size: at most about OVERSAMPLE * MOST_SHARDS keys of DEEPEST turns
        share = min(1 << 30, int((1 << 30) * OVERSAMPLE * shards / n) + 1)
        sample = keys.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < share).select(F.substring("key", 1, deepest * STEP).alias("key"))
        sampled = sorted(bytes(r.key) for r in sample.collect())
        splitters = sorted({sampled[i * len(sampled) // shards] for i in range(1, shards)}) if sampled else []
    numbers = skeleton(splitters, deepest)
    shared = spark.sparkContext.broadcast((splitters, numbers))

    def dealt(batches):
        bounds = shared.value[0]
        for batch in batches:
            to = [bisect_right(bounds, k) for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *batch.columns], names=["shard", "conv_id", "key", "sizes"])

    def in_shard(batches):
        bounds, ids = shared.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True)

        def made() -> Iterator[tuple]:
            held = rows()
            first = next(held, None)
            if first is None:
                return
            shard = first[0]

            def own() -> Iterator[tuple]:
                yield first[1:]
                for r in held:
                    yield r[1:]

            left, left_ids = (bounds[shard - 1], ids[shard - 1]) if shard else (b"", [0])
            right, right_ids = (bounds[shard], ids[shard]) if shard < len(bounds) else (b"", [0])
            yield from shard_nodes(own(), shard, left, right, left_ids, right_ids)

        return batches_of(made(), FOUND, lambda row: 200 + len(row[15] or "") + 9 * len(row[13] or ()))

    spread = keys.mapInArrow(dealt, "shard int, conv_id long, key binary, sizes array<long>").repartitionById(len(splitters) + 1, F.col("shard"))
    folder = new_folder(spark, "trie-nodes")
    spread.sortWithinPartitions("key").mapInArrow(in_shard, FOUND_SCHEMA).write.parquet(folder)
    made = spark.read.schema(FOUND_SCHEMA).parquet(folder)
    return united(made)


def united(made: DataFrame) -> DataFrame:
    """Finished nodes with those of the skeleton, reduced from the shards' parts."""
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_key"]

    def hashed(batches):
        def rows() -> Iterator[tuple]:
            at, digest = None, None
            for batch in batches:
                for a, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if a != at:
                        if digest:
                            yield (at, digest.hexdigest())
                        at, digest = a, hashlib.sha256(ids.encode())
                    else:
                        digest.update(f",{ids}".encode())
            if digest:
                yield (at, digest.hexdigest())

        return batches_of(rows(), pa.schema([("at", LONG), ("sha", pa.string())]), len)

    ends = made.where(F.col("kind") == ENDS).select("at", "shard", "chunk", "ids").repartition("at").sortWithinPartitions("at", "shard", "chunk").mapInArrow(hashed, "at long, sha string")
    part = made.where(F.col("kind") == PART).groupBy("at").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.first("size").alias("size"), F.first("turn_key").alias("turn_key"), F.first("above").alias("above"),
    )
    # a skeleton node's skeleton children count once, not once a shard
    up = F.when(F.size("above") > 1, F.element_at("above", -2))
    part = part.withColumn("up", up)
    more = part.where("up IS NOT NULL").groupBy(F.col("up").alias("at")).agg(F.count("*").alias("more"))
    part = part.join(more, "at", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = part.select(
        F.explode("above").alias("at"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")
    )
    below = own.groupBy("at").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    # at most MOST_SHARDS * (DEEPEST + 1) rows of two numbers
    firsts = part.select(F.col("at").alias("up"), F.col("conv_id").alias("first_of_parent"))
    spine = part.drop("n_leaves", "saved_tokens").join(below, "at").join(ends, "at", "left").join(firsts, "up", "left")
    spine = spine.withColumns({"ends_sha256": F.coalesce("sha", F.lit(EMPTY)), "parent_conv_id": F.col("first_of_parent")})
    hanging = made.where(F.col("kind") == HANGING).withColumnRenamed("at", "up").drop("parent_conv_id").join(F.broadcast(firsts), "up").withColumn("parent_conv_id", F.col("first_of_parent"))
    done = made.where(F.col("kind") == DONE)
    return done.select(*out).unionByName(hanging.select(*out)).unionByName(spine.select(*out))
