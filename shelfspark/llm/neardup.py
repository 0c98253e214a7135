"""Near-duplicate vectors by E8 lattice hashing with probes, verified by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import keep, mix64
from shelfspark.llm.components import components
from shelfspark.llm.vectors import is_usable, matrix


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers with an even sum)."""
    r = np.rint(x)
    odd = (r.sum(1).astype(np.int64) & 1).astype(bool)
    gap = x - r
    worst = np.abs(gap).argmax(1)
    rows = np.flatnonzero(odd)
    r[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1.0, -1.0)
    return r


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of the E8 lattice, doubled so that they are integers."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


class Lattice:
    """`tables` random projections to eight dimensions, decoded to E8 cells; `probes` neighbouring cells of each vector."""

    def __init__(self, dim: int, tables: int, width: float, probes: int, seed: int):
        rng = np.random.default_rng(seed + dim)
        self.axes = rng.standard_normal((tables, dim, 8)) / width
        self.shift = rng.random((tables, 8))
        self.tables, self.probes = tables, probes

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell keys, vectors x tables x (1 + probes): the own cell first, then the cells met by stepping outwards."""
        out = np.zeros((len(unit), self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            x = unit @ self.axes[t] + self.shift[t]
            home = e8(x)
            out[:, t, 0] = self._key(home, t)
            away = x - home / 2
            norm = np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
            # the first neighbour lies across the wall that the vector is nearest to; others behind single axes
            for p in range(self.probes):
                if p == 0:
                    step = x + away / norm * (1.01 - norm)
                else:
                    axis = np.argsort(-np.abs(away), axis=1)[:, p - 1]
                    step = x.copy()
                    rows = np.arange(len(x))
                    step[rows, axis] += np.sign(away[rows, axis]) * 0.75
                out[:, t, 1 + p] = self._key(e8(step), t)
        return out

    @staticmethod
    def _key(points: np.ndarray, table: int) -> np.ndarray:
        h = np.full(len(points), np.uint64(table + 1))
        for j in range(8):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + points[:, j].astype(np.uint64))
        return h.view(np.int64)


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(
    rows: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    tables: int = 6,
    probes: int = 1,
    width: float = 1.3,
    cell_rows: int = 4000,
    bucket_entries: int = 20_000,
    seed: int = 23,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of equal label whose cosine is at least `threshold` are linked.

    Equal vectors are one representative with a count. In each of `tables` tables a representative stands in its own E8
    cell and looks into `probes` neighbouring cells, too. Pairs that meet are verified by cosine in double precision;
    a pair is counted in one cell only of those where it meets, so counts need no list of pairs. Cells are dealt to
    tasks of about `bucket_entries` entries; a cell of more than `cell_rows` is cut into blocks and each pair of blocks
    meets in a task of its own: nothing is dropped. Tasks return a count for each vector and a shallow tree of links
    for each connected part, never all pairs. Recall depends on `tables`, `probes` and `width`; links that are found
    are exact.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or key, link with nothing.
    Repeated keys are rows of their own for n_links; component_id is the smallest key (null where the key is). Vectors of different lengths are not compared. Extra columns are ignored.
    """
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    usable = is_usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull()
    base = base.withColumn("usable", F.coalesce(F.when(usable, norm > 0), F.lit(False)))
    base = base.withColumn("rep", F.when(F.col("usable"), F.xxhash64("label", "v")))
    base = keep(base, "vectors")
    reps = base.where("usable").groupBy("rep").agg(
        F.first(F.struct("label", "v")).alias("x"), F.count("*").alias("copies"), F.min("id").alias("least")
    )
    reps = keep(reps.select("rep", F.xxhash64("x.label", F.size("x.v")).alias("kind"), F.col("x.v").alias("v"), "copies", "least"), "reps")

    def stand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf.v.map(len)):
                cells = _cells(part, tables, probes, width, seed)[1].reshape(len(part), -1)
                yield pd.DataFrame({"rep": np.repeat(part.rep.to_numpy(), cells.shape[1]), "cell": cells.reshape(-1)})

    entries = keep(reps.select("rep", "kind", "v").mapInPandas(stand, "rep long, cell long").distinct(), "entries")
    sizes = entries.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(sizes, "cell").withColumn("m", F.ceil(F.col("n") / cell_rows).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("m")).cast("int"))
    met = keep(met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))), "met")
    n_buckets = max(1, -(-met.count() // bucket_entries))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    bucket = F.when(F.col("m") == 1, F.pmod(F.xxhash64(F.lit(8), "cell"), F.lit(n_buckets))).otherwise(F.xxhash64("cell", i, j))
    met = met.select(bucket.alias("bucket"), "cell", i.alias("i"), j.alias("j"), "own", "rep")
    met = met.join(reps, "rep")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby(pdf.v.map(len)):
            reps_here, first, at = np.unique(part.rep.to_numpy(), return_index=True, return_inverse=True)
            x, cells = _cells(part.iloc[first], tables, probes, width, seed)
            cells = cells.reshape(len(cells), -1)
            copies, least = part.copies.to_numpy()[first], part.least.to_numpy()[first]
            links, pairs = np.zeros(len(first), np.int64), []
            for a, b, here in _meetings(part, at):
                ok = np.flatnonzero((x[a] * x[b]).sum(1) >= threshold)
                ok = ok[_first_meeting(cells, a[ok], b[ok]) == here[ok]]
                a, b = a[ok], b[ok]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                pairs.append((a, b))
            a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
            if not len(a):
                continue
            up = _tree(_union(len(first), a, b), least)
            out.append(pd.DataFrame({"rep": reps_here, "links": links, "a": least, "b": least[up]})[links > 0])
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "a": [], "b": []}, dtype="int64")

    found = keep(met.groupBy("bucket").applyInPandas(meet, "rep long, links long, a long, b long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("others"))
    nodes = components(found.select("a", "b"))
    known = reps.select("rep", "copies", "least").join(counts, "rep", "left").join(nodes, F.col("least") == F.col("node"), "left")
    known = known.select("rep", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "least").alias("component"))
    out = base.select("id", "rep").join(known, "rep", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce(F.col("others") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("id")).alias("kept"),
    )


def _cells(part: pd.DataFrame, tables: int, probes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and their cell keys in each table; vectors of other labels or lengths share no key."""
    x = matrix(part.v)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    cells = Lattice(x.shape[1], tables, width, probes, seed).cells(x)
    return x, mix64(cells.view(np.uint64) + part.kind.to_numpy().view(np.uint64)[:, None, None]).view(np.int64)


def _meetings(part: pd.DataFrame, at: np.ndarray, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of vector numbers that stand in one cell, with the cell, a bounded number at a time."""
    order = np.lexsort((part.j.to_numpy(), part.i.to_numpy(), part.cell.to_numpy()))
    cell, own, at = part.cell.to_numpy()[order], part.own.to_numpy()[order], at[order]
    split = (part.i.to_numpy() != part.j.to_numpy())[order]
    group = np.concatenate(([0], np.cumsum((np.diff(cell) != 0))))
    ends = np.searchsorted(group, group, "right")
    alive = np.arange(len(group))
    shift, held, n = 1, [], 0
    while len(alive):
        alive = alive[alive + shift < ends[alive]]
        for k in range(0, len(alive), chunk):
            p = alive[k : k + chunk]
            q = p + shift
            ok = ~split[p] | (own[p] != own[q])
            held.append((at[p[ok]], at[q[ok]], cell[p[ok]]))
            n += len(p)
            if n >= chunk:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, n = [], 0
        shift += 1
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _tree(root: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A parent for each node within its part: trees of sixteen children below the node with the smallest key."""
    order = np.lexsort((least, root))
    start = np.flatnonzero(np.diff(np.concatenate(([-1], root[order]))))
    rank = np.arange(len(root)) - np.repeat(start, np.diff(np.concatenate((start, [len(root)]))))
    up = np.empty(len(root), np.int64)
    up[order] = order[np.arange(len(root)) - rank + np.maximum(rank - 1, 0) // 16]
    return up


def _first_meeting(cells: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest cell key that both of each pair of vectors entered."""
    best = np.full(len(i), np.iinfo(np.int64).max)
    for at in range(0, len(i), 65_536):
        a, b = cells[i[at : at + 65_536]], cells[j[at : at + 65_536]]
        low = best[at : at + 65_536]
        for s in range(cells.shape[1]):
            same = (b == a[:, s : s + 1]).any(1)
            np.minimum(low, np.where(same, a[:, s], low), out=low)
    return best
