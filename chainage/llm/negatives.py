"""Hard negatives by branch and bound on ball trees.

Rows are dealt by hash to groups of bounded bytes. A group builds a ball tree over its
vectors: each node has a centre, the greatest distance of its vectors from it and the
least and greatest label under it. For an anchor q, the inner products with a node's
vectors lie within |q| times that distance of the product with the centre, which bounds
them above and below. A search goes through the nodes and leaves out those

* whose upper bound is under the score window or whose lower bound is over it,
* whose upper bound is strictly under the current k-th score (an equal score could still
  win by its smaller id),
* whose labels can't be wanted.

Anchors travel to all groups in blocks (they are a stated share of the rows, and each has
to meet all rows); a group keeps the best k for each, and these are merged. Two such
searches run: one for the positives, one for the negatives in the windows that the
positives' scores give. Components are whole numbers, so all scores are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainage.llm.common import checkpoint, groups_of

#: Bytes of the vectors of one group, and of one block of anchors.
GROUP_BYTES = 8 << 20
#: Rows of a group, at most.
GROUP_ROWS = 16_384
#: Rows of a leaf.
LEAF = 128
#: Searches that go through a tree together.
TOGETHER = 1024


class Tree(NamedTuple):
    """Nodes from the root (0): the rows that they hold (a range of `order`), children (-1: a leaf), ball and labels."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    least: np.ndarray
    most: np.ndarray


def build(x: np.ndarray, label: np.ndarray, leaf: int = LEAF) -> Tree:
    """A ball tree over the rows of x. Nodes of several labels are cut between labels, others at the median of their widest dimension."""
    order = np.argsort(label, kind="stable")
    nodes: list[list] = []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        k, own = len(nodes), order[a:b]
        if parent >= 0:
            nodes[parent][2 + side] = k
        rows, labels = x[own], label[own]
        centre = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        nodes.append([a, b, -1, -1, centre, radius, int(labels.min()), int(labels.max())])
        if b - a <= leaf:
            continue
        if labels[0] != labels[-1]:
            # rows of one node are in the order of their labels until it has but one
            edges = np.flatnonzero(np.diff(labels)) + 1
            cut = int(edges[np.abs(edges - (b - a) / 2).argmin()])
        elif radius == 0:
            continue  # equal vectors: nothing to tell apart
        else:
            wide = int(np.ptp(rows, axis=0).argmax())
            order[a:b] = own[np.argsort(rows[:, wide], kind="stable")]
            cut = (b - a) // 2
        todo += [(a + cut, b, k, 1), (a, a + cut, k, 0)]
    columns = [np.array([n[i] for n in nodes]) for i in (0, 1, 2, 3)]
    return Tree(order, *columns, np.stack([n[4] for n in nodes]), np.array([n[5] for n in nodes]), np.array([n[6] for n in nodes]), np.array([n[7] for n in nodes]))


def product(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers: by floats where no sum leaves 2^53, else by 64-bit integers."""
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact else q @ x.T


class Search(NamedTuple):
    """Searches of one tree: vectors, wanted labels, score windows (both ends included) and the row that each leaves out (-1: none)."""

    q: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray
    skip: np.ndarray


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, label: np.ndarray, asked: Search, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(search, row, score) of the k best rows of each search among those of the same label (or of others), by score, then the smaller id; and how many leaves were visited by a search."""
    n = len(asked.q)
    dim = x.shape[1]
    biggest = max(int(np.abs(x).max(initial=0)), int(np.abs(asked.q).max(initial=0)))
    exact = dim * biggest * biggest < 1 << 53
    reach = np.sqrt((asked.q.astype(np.float64) ** 2).sum(axis=1))
    at_centre = asked.q.astype(np.float64) @ tree.centre.T
    # bounds are floats: a slack above their rounding
    slack = 1e-9 * (1 + np.abs(at_centre) + reach[:, None] * (tree.radius + np.sqrt((tree.centre**2).sum(axis=1)))[None, :])
    spread = reach[:, None] * tree.radius[None, :] + slack
    above, below = at_centre + spread, at_centre - spread
    fits = (above >= asked.low[:, None]) & (below <= asked.high[:, None])
    inside = (tree.least[None, :] <= asked.label[:, None]) & (asked.label[:, None] <= tree.most[None, :])
    fits &= inside if same else ~(inside & (tree.least == tree.most)[None, :])

    best = np.full((n, k), np.iinfo(np.int64).min)
    best_row = np.full((n, k), -1)
    id_of = np.append(ids, np.iinfo(np.int64).max)  # of row -1
    visited = 0
    todo = [(0, np.arange(n))]
    while todo:
        node, who = todo.pop()
        full = best_row[who, -1] >= 0
        who = who[fits[who, node] & ~(full & (above[who, node] < best[who, -1]))]
        if not len(who):
            continue
        if tree.left[node] >= 0:
            one, two = tree.left[node], tree.right[node]
            later, first = (one, two) if above[who, two].mean() > above[who, one].mean() else (two, one)
            todo += [(later, who), (first, who)]
            continue
        visited += len(who)
        rows = tree.order[tree.start[node] : tree.end[node]]
        for a in range(0, len(rows), LEAF):  # a leaf of equal vectors may be long
            own = rows[a : a + LEAF]
            score = product(asked.q[who], x[own], exact)
            wanted = (label[own][None, :] == asked.label[who][:, None]) == same
            wanted &= (score >= asked.low[who][:, None]) & (score <= asked.high[who][:, None]) & (own[None, :] != asked.skip[who][:, None])
            scores = np.concatenate([best[who], np.where(wanted, score, np.iinfo(np.int64).min)], axis=1)
            held = np.concatenate([best_row[who], np.where(wanted, own[None, :], -1)], axis=1)
            order = np.lexsort((id_of[held], -(scores + 1), held < 0), axis=1)[:, :k]  # + 1: the least integer has no negative
            best[who], best_row[who] = np.take_along_axis(scores, order, 1), np.take_along_axis(held, order, 1)
    i, j = np.nonzero(best_row >= 0)
    return i, best_row[i, j], best[i, j], visited


def whole_numbers(v: Column) -> Column:
    """floor(256 x) of each component, as long."""
    return F.transform(v.cast("array<double>"), lambda x: F.floor(256 * x).cast("long"))


def prepared(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shift_every: int = 7, labels: int = 10) -> tuple[DataFrame, int]:
    """(rid, vec_id, label, v) of the rows that take part, checkpointed, and the vectors' dimension (0: no rows).

    rid is a number of the row's own. See mine for what takes part.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("x")).where("vec_id is not null and label is not null and x is not null")
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    dims = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return checkpoint(rows.select(F.lit(0).cast("long").alias("rid"), "vec_id", "label", F.col("x").cast("array<bigint>").alias("v"))), 0
    dim = dims["dim"]
    # so that no inner product leaves 64 bits
    most = isqrt(((1 << 63) - 1) // max(1, dim))
    fitting = rows.where((F.size("x") == dim) & ~F.exists("x", lambda c: F.abs(c) * 256 >= float(most) / 2))
    label = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    own = fitting.select("vec_id", label.alias("label"), whole_numbers(F.col("x")).alias("v")).distinct()
    return checkpoint(own.select(F.monotonically_increasing_id().alias("rid"), "*")), dim


def _meet(rows: DataFrame, searches: DataFrame, dim: int, n_rows: int, n_searches: int, k: int, same: bool) -> DataFrame:
    """(anchor, positive, rid, vec_id, score) of the k best rows of each search in each group.

    searches: (rid, label, v, windows), the windows as array of (positive, low, high).
    """
    per_group = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * max(1, dim))))
    groups, blocks = groups_of(n_rows, per_group), groups_of(n_searches, per_group)
    of_group = F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")
    of_block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    left = rows.select(of_group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "rid", "vec_id", "label", "v")
    right = searches.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), of_block.alias("b"), F.col("rid").alias("anchor"), F.col("label").alias("own_label"), F.col("v").alias("q"), "windows")
    fields = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def flat(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(held) or not len(asked):
            return fields.empty_table()
        x, rid, ids, label = flat(held["v"]), held["rid"].to_numpy(), held["vec_id"].to_numpy(), held["label"].to_numpy()
        tree = build(x.astype(np.float64), label)
        by_rid = np.argsort(rid)
        windows = asked["windows"].combine_chunks()
        own = np.repeat(np.arange(len(asked)), windows.value_lengths().to_numpy())
        each = windows.flatten()
        positive, low, high = (each.field(c).to_numpy() for c in range(3))
        anchor = asked["anchor"].to_numpy()[own]
        place = np.minimum(np.searchsorted(rid, anchor, sorter=by_rid), len(rid) - 1)
        skip = np.where(rid[by_rid[place]] == anchor, by_rid[place], -1)
        q, wanted = flat(asked["q"]), asked["own_label"].to_numpy()
        out = []
        for a in range(0, len(own), TOGETHER):
            s = slice(a, a + TOGETHER)
            i, row, score, _ = search(tree, x, ids, label, Search(q[own[s]], wanted[own[s]], low[s], high[s], skip[s]), k, same)
            out.append(pa.table([anchor[s][i], positive[s][i], rid[row], ids[row], score], schema=fields))
        return pa.concat_tables(out) if out else fields.empty_table()

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, "anchor long, positive long, rid long, vec_id long, score long")


def mine(
    df: DataFrame, n_positives: int = 5, n_negatives: int = 10, every: int = 100, low: int = 30, high: int = 90, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shift_every: int = 7, labels: int = 10
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hardest rows of another label for each anchor and positive.

    Anchors are the rows whose id is divisible by `every`; the positives of one its
    n_positives nearest other rows of its label; the negatives of both its n_negatives
    nearest rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score. Rows whose id is divisible by shift_every take the next label
    (modulo labels) first. Nearness is the inner product of floor(256 x); ties go to the
    smaller id.

    Defined edge cases: rows without id or label, with a null vector or null or non-finite
    components take no part, nor do vectors whose dimension isn't the commonest (ties: the
    smaller) or with a component so large that products of such vectors could leave 64 bits
    (beyond 740,000 in 64 dimensions); rows equal in id, label and vector count once, rows
    that share only their id are different rows; an anchor without other rows of its label,
    or a window without rows, gives no rows; an empty table gives an empty result; other
    columns are ignored.
    """
    rows, dim = prepared(df, id_col, vec_col, label_col, shift_every, labels)
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    ends = (F.lit(-(1 << 63)).alias("low"), F.lit((1 << 63) - 1).alias("high"))
    everything = F.array(F.struct(F.lit(-1).cast("long").alias("positive"), *[e.cast("long") for e in ends]))
    found = _meet(rows, anchors.select("rid", "label", "v", everything.alias("windows")), dim, n_rows, n_anchors, n_positives, True)

    def best(of: list[str], most: int) -> Callable[[DataFrame], DataFrame]:
        order = Window.partitionBy(*of).orderBy(F.desc("score"), "vec_id", "rid")
        return lambda t: t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    positives = checkpoint(found.drop("positive").transform(best(["anchor"], n_positives)).select("anchor", F.col("rid").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 30 p <= 100 n <= 90 p over whole numbers, without leaving 64 bits
    up = -F.floor(-(F.col("positive_score").cast("decimal(38,0)") * low) / 100)
    down = F.floor((F.col("positive_score").cast("decimal(38,0)") * high) / 100)
    windows = positives.select("anchor", F.struct("positive", up.cast("long").alias("low"), down.cast("long").alias("high")).alias("w")).where("w.low <= w.high")
    asked = anchors.join(windows.groupBy(F.col("anchor").alias("rid")).agg(F.array_sort(F.collect_list("w")).alias("windows")), "rid")
    met = _meet(rows, asked.select("rid", "label", "v", "windows"), dim, n_rows, n_anchors, n_negatives, False)
    negatives = met.transform(best(["anchor", "positive"], n_negatives))
    named = positives.join(anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return negatives.join(named, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def oracle(n_positives: int = 5, n_negatives: int = 10, every: int = 100, low: int = 30, high: int = 90) -> str:
    """The same as DuckDB SQL, each anchor against each row."""
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= {n_positives}),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {n_negatives}
"""
