"""Shingle-set similarity join: a count-vector R-tree in pages, bounds by summed coordinate minima, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.llm.common import keep, may_hold, mix64, row_key, shingle_hashes, text_of, trim, word_hashes
from shelfspark.llm.components import components

#: Tokens for each coordinate of a count vector: between this and half of it.
TOKENS_A_GROUP = 4
#: Cells of the sketch that says which tokens are frequent, as a power of two, and its pieces: fixed at every size.
CELLS, PIECES = 20, 256


class Rule:
    """den * |A and B| >= num * |A or B|, and what follows from it for sizes and groups."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def links(self, n: int, m: int, both: int) -> bool:
        return self.den * both >= self.num * (n + m - both)

    def least_overlap(self, n, m):
        return -(-self.num * (n + m) // (self.den + self.num))

    def prefix(self, n: int) -> int:
        """Tokens of a set of n, first ones in any order that all sets share, of which a linked set holds one among its own."""
        return n - -(-self.num * n // self.den) + 1


def token_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text."""
    words, at = word_hashes(texts)
    return [np.unique(shingle_hashes(words[at[i] : at[i + 1]], k)) for i in range(len(texts))]


def set_id(tokens: np.ndarray) -> int:
    return int(mix64(np.array([mix64(tokens ^ np.uint64(77)).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0].view(np.int64))


def page_keys(tokens: np.ndarray, rule: Rule, level: np.ndarray) -> np.ndarray:
    """Tokens under which a set stands in the index: its first ones in the order of (level of frequency, hash).

    Two sets that link have in common at least num / den of the larger one; so the first common token, in an order that
    is the same for all sets, lies in the prefix of both. Rare tokens come first, so that passages which many documents
    share bring those together only whose shared part is most of the text. The levels touch the work, never the result.
    """
    most = rule.prefix(len(tokens))
    return tokens[np.argsort(level[(tokens >> np.uint64(64 - CELLS)).astype(np.int64)], kind="stable")[:most]]


def levels(counts: np.ndarray) -> np.ndarray:
    """Level of each cell: 0 where its tokens are no more than chance, then one more for each doubling above."""
    mean = counts.mean() if len(counts) else 0.0
    apart = max(30.0, 6 * mean**0.5)
    return np.floor(np.log2(np.maximum((counts - mean) / apart, 0.5)) + 1).astype(np.uint8)


def count_vector(tokens: np.ndarray) -> np.ndarray:
    """Numbers of tokens in 2**k groups by hash, where 2**k is more than size / TOKENS_A_GROUP and at least 16."""
    k = max(4, int(len(tokens) // TOKENS_A_GROUP).bit_length())
    return np.bincount((tokens >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype(np.uint16)


def read_point(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16).astype(np.int64)


def folded(v: np.ndarray, size: int) -> np.ndarray:
    """A count vector over fewer groups; groups are prefixes of the hash, so neighbours add up."""
    return v.reshape(size, -1).sum(1)


class RTree:
    """Count vectors in order of size, packed into leaves, and leaves into nodes; each has its largest coordinates and sizes.

    What a box admits is bounded by the sum of the smaller of the point's and the box's coordinates, group by group.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, fan: int = 16):
        self.points, self.sizes, self.parts, self.fan = points, sizes, parts, fan
        self.levels = [(points, sizes, sizes, parts)]  # points, then leaves, then nodes: largest coordinates, sizes, only part
        while len(self.levels[-1][0]) > fan or len(self.levels) == 1:
            most, low, high, only = self.levels[-1]
            cut = np.arange(0, len(most), fan)
            a, b = np.minimum.reduceat(only, cut), np.maximum.reduceat(only, cut)
            self.levels.append((np.maximum.reduceat(most, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.where(a == b, a, -1)))

    def search(self, i: int, rule: Rule) -> np.ndarray:
        """Points after i, of another part, whose overlap with point i can be large enough."""
        p, n, part = self.points[i], self.sizes[i], self.parts[i]
        here = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            most, low, high, only = self.levels[depth]
            here = here[(here >= i // self.fan**depth) & (high[here] >= n) & (low[here] * rule.num <= n * rule.den) & (only[here] != part)]
            here = here[np.minimum(most[here], p).sum(1) >= rule.least_overlap(n, np.maximum(low[here], n))]
            if depth:
                here = (here[:, None] * self.fan + np.arange(self.fan)).reshape(-1)
                here = here[here < len(self.levels[depth - 1][0])]
        return here[here > i]


def bounded_pairs(points: list[np.ndarray], sizes: np.ndarray, parts: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different parts that the summed coordinate minima leave possible.

    Sets that link are of sizes that differ by den / num at most, and so are their vectors' widths, which are powers of
    two: a tree holds the points of a width and the wider ones within reach, folded to it.
    """
    widths = np.array([len(p) for p in points])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    reach = 2 * rule.den // rule.num + 1
    for width in np.unique(widths):
        here = np.flatnonzero((widths >= width) & (widths <= reach * width))
        order = here[np.argsort(sizes[here], kind="stable")]
        own = widths[order] == width
        tree = RTree(np.array([folded(points[i], width) for i in order], np.int64), sizes[order], parts[order])
        for i in range(len(order)):
            found = tree.search(i, rule)
            found = found if own[i] else found[own[found]]  # pairs of wider points have a tree of their own
            a.append(np.full(len(found), order[i]))
            b.append(order[found])
    return np.concatenate(a), np.concatenate(b)


def _texts(rows: DataFrame, chosen: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, text) of the sets; of the other texts only those travel that the key filter's fixed size lets through."""
    wanted = keep(chosen.select("sid", "row").join(sids.distinct(), "sid").select("sid", "row"), "wanted")
    found = may_hold(rows.select("row", "text"), "row", wanted.select("row"), "_held").where("_held").select("row", "text")
    return found.join(wanted, "row").dropDuplicates(["row"]).select("sid", "text")


def _compared(pairs: DataFrame, points: DataFrame, rows: DataFrame, k: int, rule: Rule) -> DataFrame:
    """Pairs (a, b) of set ids with their Jaccard similarity, and whether they link; pairs that the bounds exclude are absent.

    points: (sid, row, point), a row a set; rows: (row, text). Texts travel only for pairs that the bounds leave.
    """

    @F.pandas_udf("boolean")
    def admits(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = read_point(x), read_point(y)
            width = min(len(p), len(q))
            both = int(np.minimum(folded(p, width), folded(q, width)).sum())
            out.append(rule.links(int(p.sum()), int(q.sum()), both))
        return pd.Series(out, dtype=bool)

    met = pairs.join(points.select(F.col("sid").alias("b"), F.col("point").alias("pb")), "b")
    met = met.join(points.select(F.col("sid").alias("a"), F.col("point").alias("pa")), "a").where(admits("pa", "pb"))
    met = keep(met.select("a", "b"), "bounded")
    texts = keep(_texts(rows, points, met.select(F.col("a").alias("sid")).unionByName(met.select(F.col("b").alias("sid")))), "texts")
    first = met.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
    both = first.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                new = [i for i in dict.fromkeys(part.a) if i not in held]
                if len(held) > 512:
                    held = {}
                    new = list(dict.fromkeys(part.a))
                ta = dict(zip(part.a, part.ta, strict=True))
                held |= dict(zip(new, token_sets([bytes(ta[i]) for i in new], k), strict=True))
                sets = token_sets([bytes(t) for t in part.tb], k)
                both = [len(np.intersect1d(held[a], s, assume_unique=True)) for a, s in zip(part.a, sets, strict=True)]
                sizes = [(len(held[a]), len(s)) for a, s in zip(part.a, sets, strict=True)]
                ok = [rule.links(n, m, x) for (n, m), x in zip(sizes, both, strict=True)]
                yield part[["a", "b"]].assign(near=[x / (n + m - x) for (n, m), x in zip(sizes, both, strict=True)], ok=ok)

    return both.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long, near double, ok boolean")


def jaccard_components(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    num: int = 80,
    den: int = 100,
    block: int = 512,
    page_bytes: int = 32 << 20,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, row) of every document; documents link when den * both >= num * either.

    A text's set: distinct `words`-word shingles of its words, A-Z lower-cased; with fewer words the whole sequence as
    one; without words it is empty and links with nothing. component_id is the smallest key reachable by links.

    Equal sets are one set from the start. Every set is a point of the index, its count vector, and stands in the pages
    of its prefix (page_keys): sets that link share a page for certain. Each page compares its sets with its first one,
    and what is then still apart with the set nearest to that, rows in proportion to the page. Where a page still holds
    several components, an R-tree over its points finds the sets that have a partner in another component. In all three
    rounds the summed coordinate minima of two points decide first; only texts of pairs that they admit travel, and these
    are verified on whole token sets. Of the R-tree's pairs a task returns links that span what it found, never all of
    them. Such pages are cut into blocks of `block` sets, and each pair of blocks is a group of its own.

    Null text counts as text without words. A null key gives a row whose component may be null. Rows that repeat are
    documents of their own. An empty table gives an empty result. Extra columns are ignored; `row` is a content key.
    """
    rule = Rule(num, den)
    k = words
    rows = docs.select(F.col(key).alias("doc_id"), row_key(key, text).alias("row"), text_of(text).cast("binary").alias("text"))

    kind = docs.schema[key].dataType.simpleString()
    form = f"doc_id {kind}, row long, n long, sid long, point binary, bytes long, piece int, cells binary"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document, and at last the task's counts of tokens by cell, in pieces."""
        counts, schema = np.zeros(1 << CELLS, np.uint32), None
        for batch in batches:
            out, seen = [], []
            for at in range(0, batch.num_rows, 256):
                sets = token_sets(batch.column("text").slice(at, 256).to_pylist(), k)
                out += [(len(s), set_id(s), count_vector(s).tobytes()) if len(s) else (0, None, None) for s in sets]
                seen += [s >> np.uint64(64 - CELLS) for s in sets]
            if seen:
                counts += np.bincount(np.concatenate(seen).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            n, sid, point = zip(*out, strict=True) if out else ((), (), ())
            doc, row, text = (batch.column(c) for c in ("doc_id", "row", "text"))
            none = [None] * len(out)
            columns = [doc, row, pa.array(n, "int64"), pa.array(sid, "int64"), pa.array(point, "binary"), pc.binary_length(text).cast("int64"), pa.array(none, "int32"), pa.array(none, "binary")]
            made = pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "sid", "point", "bytes", "piece", "cells"])
            schema = made.schema
            yield made
        if schema is not None:
            pieces = np.minimum(counts, 65535).astype(np.uint16).reshape(PIECES, -1)
            last = [pa.nulls(PIECES, f.type) for f in schema][:6] + [pa.array(range(PIECES), "int32"), pa.array([x.tobytes() for x in pieces], "binary")]
            yield pa.RecordBatch.from_arrays(last, schema=schema)
        trim()

    described = keep(rows.mapInArrow(describe, form), "sets")
    known = described.where("piece is null").select("doc_id", "row", "n", "sid", "point", "bytes")
    total = known.agg(F.sum("bytes")).first()[0] or 0
    parts = int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // page_bytes)))

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        found = sum(np.frombuffer(c, np.uint16).astype(np.int64) for c in pdf.cells)
        return pd.DataFrame({"piece": pdf.piece.iloc[:1], "cells": [found.tobytes()]})

    counted = described.where("piece is not null").select("piece", "cells").groupBy("piece").applyInPandas(added, "piece int, cells binary")
    counted = [np.frombuffer(r.cells, np.int64) for r in sorted(counted.collect())]  # 8 MB in all, whatever the input
    level = docs.sparkSession.sparkContext.broadcast(levels(np.concatenate(counted) if counted else np.zeros(1 << CELLS)))

    def stand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held, ids, n = [], [], 0
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                for tokens in token_sets([bytes(t) for t in pdf.text.iloc[at : at + 256]], k):
                    if not len(tokens) or (sid := set_id(tokens)) in seen:
                        continue
                    seen.add(sid)
                    held.append(page_keys(tokens, rule, level.value))
                    ids.append((sid, len(held[-1])))
                    n += len(held[-1])
                if n >= 1 << 20:
                    yield _dealt(held, ids, parts)
                    held, ids, n, seen = [], [], 0, set()
        if held:
            yield _dealt(held, ids, parts)
        held, ids = [], []
        trim()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a page's first set and each other one, once a part."""
        blobs = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in pdf.blob]
        page, sids = np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]).view(np.int64)
        order = np.argsort(page, kind="stable")
        page, sids = page[order], sids[order]
        same = page[1:] == page[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        page, sids = page[shared], sids[shared]
        start = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1]))) if len(page) else np.zeros(0, np.int64)
        first = np.repeat(np.minimum.reduceat(sids, start), np.diff(np.append(start, len(page)))) if len(page) else sids
        apart = first != sids
        pairs = np.unique(np.stack([first[apart], sids[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    stood = rows.select("text").mapInPandas(stand, "part int, blob binary")
    star = keep(stood.groupBy("part").applyInPandas(meet, "a long, b long").distinct(), "pairs")

    needed = star.select(F.col("a").alias("sid")).unionByName(star.select(F.col("b").alias("sid"))).distinct()
    chosen = known.where("sid is not null").groupBy("sid").agg(F.min("row").alias("row"), F.first("point").alias("point"))
    chosen = keep(chosen.join(needed, "sid"), "chosen")
    seen = keep(_compared(star, chosen, rows, k, rule), "compared")
    links = seen.where("ok").select("a", "b")
    nodes = components(links)

    # a pivot that has met all of its page leaves it
    still = keep(_open_pages(star.select(F.col("a").alias("page"), F.col("b").alias("sid")), nodes), "open")
    # what is nearest to a page's first set lies nearest to the middle of its copies: all that are still apart meet it
    near = seen.groupBy(F.col("a").alias("page")).agg(F.min_by("b", F.struct(-F.col("near"), F.col("b"))).alias("near"))
    middle = still.groupBy("page").agg(F.min("sid").alias("next")).join(near, "page", "left").select("page", F.coalesce("near", "next").alias("middle"))
    still = keep(still.join(middle, "page").select(F.col("middle").alias("page"), "sid", "part").where("page <> sid").distinct(), "open")
    homes = nodes.select(F.col("node").alias("page"), F.col("component").alias("home"))
    again = still.join(homes, "page", "left").where("part <> coalesce(home, page)").select(F.col("page").alias("a"), F.col("sid").alias("b"))
    late = keep(_compared(again, chosen, rows, k, rule), "compared")
    links = links.unionByName(late.where("ok").select("a", "b"))
    if not late.where("ok").isEmpty():
        nodes = components(links)
        homes = nodes.select(F.col("node").alias("page"), F.col("component").alias("home"))

    rest = _open_pages(still.select("page", "sid"), nodes)
    rest = rest.join(homes, "page", "left").withColumn("main", F.col("part") == F.coalesce("home", "page")).drop("home")
    # sets of the middle's component never need to meet each other: they go to the other sets' blocks only
    counts = rest.groupBy("page").agg(F.ceil(F.count_if("main") / block).cast("int").alias("mm"), F.ceil(F.count_if(~F.col("main")) / block).cast("int").alias("mo"))
    spot = F.xxhash64(F.lit(2), "sid")
    rest = rest.join(counts, "page").withColumn("own", F.when(F.col("main"), F.col("mo") + F.pmod(spot, F.greatest("mm", F.lit(1)))).otherwise(F.pmod(spot, F.col("mo"))).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("mo")).otherwise(F.col("mo") + F.col("mm")) - 1)))
    rest = rest.select("page", "sid", "part", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rest = rest.join(chosen.select("sid", "point"), "sid").withColumn("spread", F.pmod(F.xxhash64("page", "i", "j"), F.lit(4 * parts)))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sets that the bounds leave a partner in their pair of blocks."""
        out = []
        for _, part in pdf.groupby(["page", "i", "j"]):
            points = [read_point(p) for p in part.point]
            a, b = bounded_pairs(points, np.array([int(p.sum()) for p in points]), part.part.to_numpy(np.int64), rule)
            across = (part.own.to_numpy()[a] != part.own.to_numpy()[b]) | (part.i.iloc[0] == part.j.iloc[0])
            out.append(part.iloc[np.unique(np.concatenate((a[across], b[across])))])
        return pd.concat(out)[["page", "sid", "part", "own", "i", "j"]]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        trim()
        out = [np.zeros((0, 2), np.int64)]
        for (i, j, _), part in pdf.groupby(["i", "j", "page"]):
            sets = token_sets([bytes(t) for t in part.text], k)
            sid, own = part.sid.to_numpy(np.int64), part.own.to_numpy()
            a, b = bounded_pairs([count_vector(s).astype(np.int64) for s in sets], np.array([len(s) for s in sets]), part.part.to_numpy(np.int64), rule)
            across = (own[a] != own[b]) | (i == j)
            out.append(sid[spanning_links(sets, a[across], b[across], rule)])
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    left = keep(rest.groupBy("spread").applyInPandas(bound, "page long, sid long, part long, own int, i int, j int"), "left")
    left = left.join(keep(_texts(rows, chosen, left.select("sid")), "texts"), "sid").withColumn("spread", F.xxhash64("page", "i", "j"))
    last = keep(left.groupBy("spread").applyInPandas(search, "a long, b long").distinct(), "links")
    if not last.isEmpty():
        nodes = components(links.unionByName(last))

    named = known.join(nodes.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.withColumn("part", F.coalesce("component", "sid")).select("doc_id", "row", "n", "sid", "part")
    least = named.where("sid is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "part", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "row")


def _open_pages(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page, sid, part) of pages whose sets lie in several components."""
    rows = member.join(nodes, F.col("sid") == F.col("node"), "left").select("page", "sid", F.coalesce("component", "sid").alias("part"))
    ends = rows.groupBy("page").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return rows.join(ends.where("low <> high").select("page"), "page")


def spanning_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """Pairs of set numbers that link, out of the candidates (a, b): enough of them to span what all of them span.

    Overlaps of all the sets concerned come from products of their 0/1 matrix of shared tokens, block by block.
    """
    used = np.unique(np.concatenate((a, b)))
    if not len(used):
        return np.zeros((0, 2), np.int64)
    size = np.array([len(sets[i]) for i in used])
    _, column, often = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), size)
    shared = often[column] > 1  # tokens of one set only are in no overlap
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    both = np.zeros((len(used), len(used)), np.float32)
    for lo in range(0, int((often > 1).sum()), 8192):
        now = (column >= lo) & (column < lo + 8192)
        m = np.zeros((len(used), 8192), np.float32)
        m[row[now], column[now] - lo] = 1
        both += m @ m.T
    x, y = np.searchsorted(used, a), np.searchsorted(used, b)
    overlap = both[x, y].astype(np.int64)
    ok = rule.den * overlap >= rule.num * (size[x] + size[y] - overlap)
    root, out = list(range(len(used))), []
    for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[q] = p
            out.append((used[p], used[q]))
    return np.array(out, np.int64).reshape(-1, 2)


def _dealt(held: list[np.ndarray], ids: list[tuple[int, int]], parts: int) -> pd.DataFrame:
    """Page keys and set ids, packed by the part of the index where the page lies."""
    keys = np.concatenate(held)
    sids = np.repeat(np.array([i for i, _ in ids], np.int64), [n for _, n in ids]).view(np.uint64)
    part = (mix64(keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cut))
    blobs = [np.stack([keys[order[cut[p] : cut[p + 1]]], sids[order[cut[p] : cut[p + 1]]]]).tobytes() for p in full]
    return pd.DataFrame({"part": full.astype(np.int32), "blob": blobs})


def keep_one(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose key is their component's smallest, once each; documents without words stay as they are.

    Only documents that go, or whose rows repeat, travel, but for what the key filter's fixed size lets through. The
    caller's columns travel in one struct, so none of their names can clash.
    """
    stays = F.bool_and(F.col("doc_id").eqNullSafe(F.col("component_id")))
    by_row = found.groupBy("row").agg(F.count("*").alias("n"), stays.alias("stays"), F.max("n_shingles").alias("size"))
    special = keep(by_row.where("not stays or (n > 1 and size > 0)").select("row", "stays"), "special")
    rows = docs.select(F.struct(*docs.columns).alias("own"), row_key(key, text).alias("row"))
    rows = may_hold(rows, "row", special.select("row"), "held")
    met = rows.where("held").join(special, "row", "left").where("coalesce(stays, true)")
    place = F.row_number().over(W.partitionBy("row").orderBy("row"))
    met = met.withColumn("place", place).where("stays is null or place = 1")
    return rows.where("not held").select("own").unionByName(met.select("own")).select("own.*")
