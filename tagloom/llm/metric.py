"""Exact range join of vectors: pivots make cells, the triangle inequality sets what a cell must borrow."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.staging import stage

SLACK = 1e-9
PAIRS = "cell int, kind int, a int, b int, left_side boolean, node long, copies long, vec binary"


@dataclass(frozen=True)
class Pivots:
    """Unit pivots by dimension, and the chord length within which vectors link."""

    by_dim: dict
    radius: float

    def cells(self, dim):
        return np.arange(len(self.by_dim[dim])) + sum(len(p) for d, p in self.by_dim.items() if d < dim)

    def assign(self, units):
        """(home cell, boolean matrix of the cells to lend to) of unit vectors of one dimension.

        A vector y at home in cell j is not farther from pivot j than from pivot
        i.  For x at home in i within the radius r of y, the triangle inequality
        gives d(x, p_j) - d(x, p_i) <= 2r; for unit vectors the distances to the
        bisecting plane sharpen it to x.p_i - x.p_j <= r * d(p_i, p_j).  Cells are
        joined with those before them, so x is lent to later cells only.
        """
        pivots = self.by_dim[units.shape[1]]
        near = units @ pivots.T
        home = near.argmax(axis=1)
        apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
        behind = near[np.arange(len(units)), home][:, None] - near
        lend = behind <= self.radius * apart[home] + SLACK
        lend &= np.arange(len(pivots))[None, :] > home[:, None]
        return home, lend


def _units(raw):
    """Unit rows in double precision; scaled first, so that squares neither overflow nor vanish."""
    doubles = raw.astype(np.float64)
    doubles /= np.abs(doubles).max(axis=1, keepdims=True)
    return doubles / np.linalg.norm(doubles, axis=1, keepdims=True)


def _forest(n, left, right):
    """Smallest index that each of ``n`` points reaches by the given pairs."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def compare_blocks(threshold, cells_at_once=1 << 22):
    """A pandas function over the two blocks of one group: links per vector, and a spanning forest."""

    def compare(group):
        group = group.sort_values("node", kind="stable")
        units = _units(np.stack([np.frombuffer(v, np.float64) for v in group["vec"]]))
        copies, node = group["copies"].to_numpy(), group["node"].to_numpy()
        first = np.flatnonzero(group["left_side"].to_numpy())
        same = int(group["kind"].iloc[0]) == 0 and int(group["a"].iloc[0]) == int(group["b"].iloc[0])
        second = first if same else np.flatnonzero(~group["left_side"].to_numpy())
        links = np.zeros(len(group), np.int64)
        label = np.arange(len(group))
        strip = max(1, cells_at_once // max(len(second), 1))
        for at in range(0, len(first), strip):
            mine = first[at : at + strip]
            near = units[mine] @ units[second].T >= threshold
            if same:
                near &= second[None, :] != mine[:, None]
            i, j = np.nonzero(near)
            if len(i):
                links += np.bincount(mine[i], weights=copies[second[j]], minlength=len(group)).astype(np.int64)
                if not same:
                    links += np.bincount(second[j], weights=copies[mine[i]], minlength=len(group)).astype(np.int64)
                # the forest so far and the new pairs
                all_points = np.arange(len(group))
                label = _forest(len(group), np.r_[mine[i], all_points], np.r_[second[j], label])
        found = links > 0
        return pd.DataFrame({"node": node[found], "links": links[found], "root": node[label[found]]})

    return compare


def near_duplicates(rows, id_col="vec_id", vec_col="embedding", threshold=0.9, cell_rows=16_384, max_pivots=1024):
    """(id, n_links, component) of every row; vectors link if their cosine is at least ``threshold``.

    Equal vectors are one weighted vector whatever their number.  Pivots, a
    bounded sample, partition the vectors; each vector is lent to the later
    cells that may hold a partner, and cells are joined on their own.  A cell of
    any size is cut into blocks of about ``cell_rows``, and each pair of blocks
    is one group, so no group is unbounded.  A group returns link counts and a
    spanning forest, not its pairs.  On data whose distances hardly differ, the
    bound lends nearly everything and the join compares nearly all vectors,
    still in blocks.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different length.  Ids should be
    unique; rows of one id are rows of their own.  Null ids count as links but
    never name a component.  Other columns are not read.
    """
    spark = rows.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    usable = F.coalesce(
        (F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(vec, lambda x: x != 0),
        F.lit(False),
    )
    given = stage(rows.select(F.col(id_col).alias("id"), F.when(usable, vec).alias("vec")), "vectors")
    distinct = stage(
        given.where("vec is not null").groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()), "distinct",
    )
    sizes = {r["dim"]: r["count"] for r in distinct.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(max_pivots).collect()}
    by_dim, left = {}, max_pivots
    for dim, size in sorted(sizes.items()):
        wanted = min(left, -(-size // cell_rows), max(1, max_pivots // len(sizes)))
        if wanted:
            chosen = distinct.where(F.size("vec") == dim).orderBy(F.xxhash64("node"), "node").limit(wanted).collect()
            by_dim[dim] = _units(np.array([r["vec"] for r in chosen]))
            left -= wanted
    pivots = Pivots(by_dim, float(np.sqrt(2 - 2 * threshold)))

    def place(batches):
        for batch in batches:
            for _, part in batch.groupby(batch["vec"].str.len()):
                raw = np.stack(part["vec"].tolist())
                if raw.shape[1] not in pivots.by_dim:  # lengths beyond the pivots: one cell for each
                    home, lend = np.full(len(raw), -raw.shape[1]), [[] for _ in range(len(raw))]
                else:
                    at, matrix = pivots.assign(_units(raw))
                    names = pivots.cells(raw.shape[1])
                    home, lend = names[at], [names[row].tolist() for row in matrix]
                yield pd.DataFrame({
                    "node": part["node"], "copies": part["copies"], "vec": [v.tobytes() for v in raw],
                    "home": np.asarray(home, np.int32), "lend": lend,
                })

    placed = stage(
        distinct.select("node", "copies", "vec").mapInPandas(place, "node long, copies long, vec binary, home int, lend array<int>"), "cells"
    )
    lent = placed.select(F.explode("lend").alias("cell"), F.lit(1).alias("kind"))
    counted = placed.select(F.col("home").alias("cell"), F.lit(0).alias("kind")).union(lent).groupBy("cell", "kind").count().collect()
    blocks = {(r["cell"], r["kind"]): -(-r["count"] // (cell_rows * (2 if r["kind"] else 1))) for r in counted}

    def deal(batches):
        for batch in batches:
            out = []
            for node, copies, vec, home, lend in batch.itertuples(index=False):
                homes, guests = blocks[home, 0], blocks.get((home, 1), 0)
                a = node % homes
                out += [(home, 0, min(a, b), max(a, b), a <= b, node, copies, vec) for b in range(homes)]
                out += [(home, 1, a, b, True, node, copies, vec) for b in range(guests)]
                for cell in lend:
                    homes = blocks.get((cell, 0), 0)
                    b = node % blocks[cell, 1]
                    out += [(cell, 1, a, b, False, node, copies, vec) for a in range(homes)]
            yield pd.DataFrame(out, columns=["cell", "kind", "a", "b", "left_side", "node", "copies", "vec"])

    compared = stage(
        placed.mapInPandas(deal, PAIRS).groupBy("cell", "kind", "a", "b")
        .applyInPandas(compare_blocks(threshold), "node long, links long, root long"), "compared",
    )
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (
        distinct.select("node", "vec", "least", "copies").join(found, "node", "left").join(links, "node", "left")
        .select("vec", "least", F.coalesce("component", "node").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    smallest = named.groupBy("top").agg(F.min("least").alias("component"))
    known = named.join(smallest, "top").select("vec", "n_links", "component")
    linked = given.where("vec is not null").join(known, "vec").select("id", "n_links", "component")
    alone = given.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone)
