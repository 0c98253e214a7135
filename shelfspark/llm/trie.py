"""Prefix trie of conversations: ternary search trees over range shards of turn sequences, merged at shard boundaries.

A turn is a 64-bit code of role and text, so no text is shuffled; two turns at one node whose codes collide would be one.
Sequences are sorted over all tasks, and each task cuts its part into shards of a bounded number of turns. A shard
codes its turns as dense ids, inserts its sequences into a ternary search tree, median first, and adds up its nodes. Only
nodes on the paths of a shard's first and last sequence can stand in another shard, too: these are merged, and what each
merge changes is added to the ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.llm.common import WORD, keep, release, text_of, trim

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "words long, key binary, parent_key binary, on_first boolean, on_last boolean, block string, part long, ends string"
)
_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Ids in one piece of text on the way to a digest.
_IDS = 512
_SALTS = 16


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, codes, words: the turns of each conversation in order, as codes and numbers of words.

    Turns are ordered by turn, null first, then by code. Null roles and texts are empty; rows without a conv_id belong to
    no conversation. A conversation's codes and word numbers, 16 bytes a turn, stand in one row.
    """
    words = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    code = F.xxhash64(text_of("role"), text_of())
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", code.alias("code"), words.alias("words")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.col("t.code").alias("codes"), F.col("t.words").alias("words"))


def rebuild(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % every; h is crc32(c as text) % heads.

    Where the other conversation is absent or shorter, fewer turns or none take their place. `%` has the sign of c.
    """
    own = ("codes", "words")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    head = F.struct(*[F.slice(c, 1, heads - 1).alias(c) for c in own])
    rows = rows.withColumn("head", F.max(F.when(F.col("conv_id") == F.col("base"), head)).over(W.partitionBy("base")))  # `every` rows, twice as many about 0
    new = [F.concat(F.slice(F.coalesce(f"head.{c}", F.array().cast("array<long>")), F.lit(1), h), F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))).alias(c) for c in own]
    return rows.select("conv_id", *new)


class SearchTree:
    """A ternary search tree over id sequences; each node of the trie is a symbol of one sequence under its prefix."""

    def __init__(self) -> None:
        self.symbol, self.low, self.high, self.equal, self.parent, self.end = [-1], [0], [0], [0], [0], [-1]

    def insert(self, ids: list[int], number: int) -> None:
        """Adds a sequence; its last node remembers its number."""
        node = 0
        for x in ids:
            at, side = self.equal[node], self.equal
            hold = node
            while at:
                s = self.symbol[at]
                if x == s:
                    break
                side, hold = (self.low, at) if x < s else (self.high, at)
                at = side[at]
            if not at:
                at = side[hold] = len(self.symbol)
                for column, value in ((self.symbol, x), (self.low, 0), (self.high, 0), (self.equal, 0), (self.parent, node), (self.end, -1)):
                    column.append(value)
            node = at
        self.end[node] = number

    def walk(self) -> Iterator[int]:
        """Nodes in order of their prefixes, parents first; a stack in place of recursion."""
        yield 0
        stack, at = [], self.equal[0]
        while at or stack:
            while at:
                stack.append((at, False))
                at = self.low[at]
            node, done = stack.pop()
            if done:
                at = self.high[node]
                continue
            yield node
            stack.append((node, True))
            at = self.equal[node]


def by_median(n: int) -> Iterator[int]:
    """0 to n-1, the middle of each range before its halves: sorted sequences make a balanced tree in this order."""
    spans = [(0, n)]
    while spans:
        lo, hi = spans.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            spans += [(lo, mid), (mid + 1, hi)]


def _path(tree: SearchTree, node: int) -> list[int]:
    out = [node]
    while node:
        node = tree.parent[node]
        out.append(node)
    return out[::-1]


def _keys(codes: np.ndarray) -> list[bytes]:
    """Keys of all prefixes of a sequence, the empty one first."""
    digest = hashlib.blake2b(digest_size=16)
    out = [digest.digest()]
    for code in codes:
        digest.update(code.tobytes())
        out.append(digest.copy().digest())
    return out


def shard_nodes(shard: list[tuple[np.ndarray, np.ndarray, list[int]]], block: str) -> Iterator[dict]:
    """Rows of NODE of one shard: its sequences (codes, words, ids of its conversations) in order, each once.

    Nodes on the first and last path carry keys. For the two sequences whose conversations other shards may hold, too,
    the ids follow as pieces of text in rows of their own.
    """
    dictionary = np.unique(np.concatenate([codes for codes, _, _ in shard]))
    ids = [np.searchsorted(dictionary, codes).tolist() for codes, _, _ in shard]
    tree = SearchTree()
    for i in by_median(len(shard)):
        tree.insert(ids[i], i)
    n = len(tree.symbol)
    depth, members, children, leaves, saved, words = ([0] * n for _ in range(6))
    least: list[int | None] = [None] * n
    order = list(tree.walk())
    last: dict[int, int] = {}
    for node in order:
        if node:
            depth[node] = depth[tree.parent[node]] + 1
        if tree.end[node] >= 0:
            last[tree.end[node]] = node
    for i, (_, own, _) in enumerate(shard):
        node = last[i]
        for d in range(len(own), 0, -1):
            if words[node] or depth[node] != d:
                break
            words[node] = int(own[d - 1])
            node = tree.parent[node]
    for node in reversed(order):
        if tree.end[node] >= 0:
            convs = shard[tree.end[node]][2]
            members[node] += len(convs)
            least[node] = convs[0] if least[node] is None else min(least[node], convs[0])
        leaves[node] += not children[node]
        saved[node] += (members[node] - 1) * words[node]
        if node:
            up = tree.parent[node]
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    keys, sides = {}, (set(), set())
    for side, i in enumerate((0, len(shard) - 1)):
        path = _path(tree, last[i])
        keys.update(zip(path, _keys(shard[i][0])))
        sides[side].update(path)
    for node in order:
        up, end = tree.parent[node], tree.end[node]
        digest = hashlib.sha256(",".join(map(str, shard[end][2])).encode()).hexdigest() if end >= 0 else NO_ENDS
        yield dict(
            conv_id=least[node], depth=depth[node], parent_conv_id=least[up] if node else None, n_convs=members[node], n_children=children[node], n_leaves=leaves[node], saved_tokens=saved[node],
            ends_sha256=digest, words=words[node], key=keys.get(node), parent_key=keys.get(up) if node else None, on_first=node in sides[0], on_last=node in sides[1], block=block,
        )
    for i in {0, len(shard) - 1}:
        convs = shard[i][2]
        for at in range(0, len(convs), _IDS):
            yield dict(key=keys[last[i]], part=convs[at], ends=",".join(map(str, convs[at : at + _IDS])))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[t]) for c, t in (x.split() for x in NODE.split(", "))], _COLUMNS)


def _shards(batches: Iterable[pa.RecordBatch], turns: int) -> Iterator[list]:
    """Shards of about so many turns (an equal share for each conversation) from sorted rows; equal sequences are one."""
    shard, size, seen = [], 0, None
    for batch in batches:
        for conv, codes, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            codes = codes.values.to_numpy(zero_copy_only=False)
            same = seen is not None and len(codes) == len(seen) and bool((codes == seen).all())
            cost = 1 if same else 1 + len(codes)
            if shard and size + cost > turns:
                yield shard
                shard, size, same = [], 0, False
            if same:
                shard[-1][2].append(conv)
            else:
                shard.append((codes, words.values.to_numpy(zero_copy_only=False), [conv]))
            seen = codes
            size += cost
    if shard:
        yield shard


def trie(convs: DataFrame, shard_turns: int = 100_000) -> DataFrame:
    """A row for each distinct prefix of the sequences of convs (conv_id, codes, words), the empty one included.

    Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Sequences of no turns end at the root; without conversations there is no root. `shard_turns` bounds the
    turns that a task holds (one longer conversation is a shard of its own); it has no bearing on the result.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for number, shard in enumerate(_shards(batches, shard_turns)):
            rows: list[dict] = []
            for row in shard_nodes(shard, f"{task.partitionId() if task else 0}.{number}"):
                rows.append(row)
                if len(rows) >= 5000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
        trim()

    convs = keep(convs, "sequences")
    ordered = convs.repartitionByRange("codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    made = keep(ordered.select("conv_id", "codes", "words").mapInArrow(build, NODE), "trie_nodes")
    release(convs)

    nodes, pieces = made.where("ends is null"), made.where("ends is not null")
    path = nodes.where("key is not null")
    childless = F.count_if(F.col("n_children") == 0)
    merged = path.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.first("parent_key").alias("parent_key"), F.count("*").alias("shards"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        childless.alias("childless"), F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends_sha256"), F.count_if(F.col("ends_sha256") != NO_ENDS).alias("ended"), F.min("block").alias("block"),
    )
    merged = keep(merged, "trie_paths")
    shared = merged.where("shards > 1")

    # What merging a node changes in all nodes above it, and in itself: the copies of its turn, and of its leaf.
    change = shared.select("key", "block", ((F.col("shards") - 1) * F.col("words")).alias("more_saved"), (F.when(F.col("childless") == F.col("shards"), 1).otherwise(0) - F.col("childless")).alias("more_leaves"))
    spot = path.select("key", "block", "depth", "on_first", "on_last")
    at = change.join(spot, ["key", "block"]).select("block", "more_saved", "more_leaves", F.col("depth").alias("below"), F.col("on_first").alias("first"), F.col("on_last").alias("last"))
    above = at.join(spot, "block").where("depth <= below and ((first and on_first) or (not first and last and on_last))")
    change = above.groupBy("key").agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
    twice = shared.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.sum(F.col("shards") - 1).alias("fewer"))
    digests = _digests(pieces.join(merged.where("ended > 1").select("key"), "key", "left_semi"))

    zero = lambda c: F.coalesce(c, F.lit(0))
    paths = merged.join(change, "key", "left").join(twice, "key", "left").join(digests, "key", "left")
    paths = paths.select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", (F.col("n_children") - zero("fewer")).alias("n_children"), (F.col("n_leaves") + zero("more_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + zero("more_saved")).alias("saved_tokens"), F.coalesce("digest", "ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "parent_key",
    )
    inner = nodes.where("key is null").select(*paths.columns)
    rows = inner.where("parent_key is not null").unionByName(paths)
    # Children of one node, such as the root, may be most of the rows: they are dealt to several copies of it.
    tops = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("top"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(_SALTS)).cast("int")).join(tops, ["parent_key", "salt"], "left")
    rows = rows.withColumn("parent_conv_id", F.col("top")).unionByName(inner.where("parent_key is null"), allowMissingColumns=True)
    return rows.select(*_COLUMNS[:8])


def _digests(pieces: DataFrame) -> DataFrame:
    """(key, digest): SHA-256 over the pieces of each key in order. A task streams them; it holds one batch at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != now:
                    done += [(now, sha.hexdigest())] if sha else []
                    now, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ends.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["key", "digest"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["key", "digest"])

    return pieces.repartition("key").sortWithinPartitions("key", "part").select("key", "ends").mapInArrow(digest, "key binary, digest string")
