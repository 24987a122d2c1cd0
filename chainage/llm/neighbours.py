"""Approximate nearest neighbours by multiprobe p-stable hashing.

`tables` hash tables; in each a vector's bucket is the integer parts of `k` Gaussian
projections (p-stable for the Euclidean distance) of width `width`, of the vector scaled
to length 1, so that nearness is the cosine. A query visits buckets in the order of
their estimated chance to hold a near vector, the home bucket first, until these chances
add up to the table's share of the target recall. Buckets are dealt to groups by hash;
a query travels once to each group with the buckets it visits there, candidates are
scored there in double precision on the original vectors, and only the best of each
group are merged. Buckets are counted first; a large one is dealt to several groups, each
of which its queries visit, so a dense region doesn't meet in one task. A query whose buckets
held fewer rows than it asks for (a vector far from all others) is compared with all rows,
in blocks of such queries.

Equal vectors are one row of the index. Of their ids only the `top` + 1 smallest can
ever be among the nearest (ties go to the smaller id), found by a limit that Spark
applies before the shuffle: a vector that fills a third of the table costs one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import erf, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainage.llm.common import checkpoint, groups_of

#: Rows of one bucket that go to one group; larger buckets are split over several.
PART_ROWS = 3000
#: Entries of the list of split buckets that tasks get: in tables so large that there could be more, PART_ROWS grows instead.
SPLITS = 1_000_000
#: Queries of one block of the exact pass.
EXACT = 1024
#: Rows of the bounded sample from which the distance to near vectors is estimated.
SAMPLE = 4096


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of rows that take part: an id, no null or non-finite component, not all zero; v is array<double>."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))


def projections(dim: int, tables: int, k: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim, tables, k])
    return rng.normal(size=(tables, dim, k)), rng.uniform(0, width, (tables, k))


def bucket_ids(cells: np.ndarray, table: int) -> np.ndarray:
    """64-bit ids of cells (rows of integers) of one table."""
    h = np.full(len(cells), 0x9E3779B97F4A7C15 ^ table, np.uint64)
    for c in cells.T:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def probes(point: np.ndarray, width: float, sigma: float, mass: float) -> np.ndarray:
    """Cells of one table in descending estimated chance, until the chances add up to mass.

    point: the projections of a query; a near vector's projections are spread around
    them with deviation sigma (its distance).
    """
    home = np.floor(point / width).astype(np.int64)
    options = []
    reach = max(1, int(np.ceil(4 * sigma / width)))
    for x, c in zip(point.tolist(), home.tolist(), strict=True):
        edges = [0.5 * (1 + erf((width * (c + d) - x) / (sigma * sqrt(2)))) for d in range(-reach, reach + 2)]
        chances = sorted(((b - a, c + d) for d, (a, b) in zip(range(-reach, reach + 1), zip(edges, edges[1:], strict=False), strict=True)), key=lambda o: (-o[0], o[1]))
        options.append([o for o in chances if o[0] > 1e-9])
    k = len(options)
    out, total = [], 0.0
    heap = [(-float(np.prod([o[0][0] for o in options])), (0,) * k, 0)]
    while heap and total < mass:
        chance, at, last = heapq.heappop(heap)
        out.append([options[i][j][1] for i, j in enumerate(at)])
        total -= chance
        for i in range(last, k):
            j = at[i] + 1
            if j < len(options[i]):
                heapq.heappush(heap, (chance * options[i][j][0] / options[i][j - 1][0], (*at[:i], j, *at[i + 1 :]), i))
    return np.array(out, np.int64).reshape(-1, k)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which loses no digit, so that the largest component is between 1/2 and 1 and squares stay in range."""
    _, e = np.frexp(np.abs(v).max(axis=1))
    return np.ldexp(v, -e[:, None])


def units(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x and the row of y beside it; the same for the same two vectors, wherever they stand. Both are scaled."""
    dot = (x * y).sum(axis=1)
    return dot / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def near_distance(sample: np.ndarray, top: int) -> float:
    """Distance between unit vectors within which nine of ten rows of the sample have `top` others; over all rows it is smaller."""
    if len(sample) < 2:
        return 1.0
    u = units(sample)
    dots = u[:512] @ u.T
    np.fill_diagonal(dots, -1)
    k = min(top, len(u) - 1)
    nth = -np.partition(-dots, k - 1, axis=1)[:, k - 1]
    return float(np.clip(np.quantile(np.sqrt(np.maximum(0, 2 - 2 * nth)), 0.9), 0.05, 1.5))


def best_of(cos: np.ndarray, keep: int) -> np.ndarray:
    """Which entries of each row are among its `keep` largest, with all that tie with the last of them up to rounding."""
    if cos.shape[1] <= keep:
        return np.ones(cos.shape, bool)
    return cos >= -np.partition(-cos, keep - 1, axis=1)[:, keep - 1 : keep] - 1e-9


def nearest(df: DataFrame, top: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 4, width: float = 1.5, recall: float = 0.97, per_bucket: int = 20, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's nearest rows by cosine.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the
    query's own. Defined edge cases: vectors that are null, zero or hold null or
    non-finite components take no part, nor do those whose dimension isn't the commonest
    (ties: the smaller), nor rows without an id; a repeated id counts once for each
    vector; ties go to the smaller id; an empty table gives an empty result.
    """
    spark = df.sparkSession
    all_rows = usable(df, id_col, vec_col)
    dims = all_rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["dim"]
    rows = all_rows.where(F.size("v") == dim).distinct().withColumn("hash", F.xxhash64("v"))
    order = Window.partitionBy("hash", "v").orderBy("vec_id")
    ranked = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= top + 1).withColumn("rep", F.first("vec_id").over(order))
    members = checkpoint(ranked.select("rep", "vec_id", "i", "v"))
    index = members.where("i = 1").select("rep", "v")
    n = index.count()
    k = max(1, round(log(max(2.0, n / per_bucket)) / log(3.7)))
    mass = 1 - (1 - recall) ** (1 / tables)
    sample = [r["v"] for r in index.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()]
    sigma = near_distance(np.array(sample, np.float64), top)
    a, b = projections(dim, tables, k, width, seed)
    part_rows = max(PART_ROWS, -(-n * tables // SPLITS))
    groups = groups_of(n * tables, part_rows)
    query_vectors = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("hash", "v").distinct()
    queries = index.withColumn("hash", F.xxhash64("v")).join(query_vectors, ["hash", "v"], "left_semi").select("rep", "v")

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def buckets_of(u: np.ndarray, t: int) -> np.ndarray:
        return bucket_ids(np.floor((u @ a[t] + b[t]) / width).astype(np.int64), t)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(vectors(batch))
            names, n = np.unique(np.concatenate([buckets_of(u, t) for t in range(tables)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["bucket", "n"])

    sizes = index.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > part_rows)
    # at most n * tables / part_rows buckets are that large, SPLITS or fewer
    parts = {r["bucket"]: -(-r["n"] // part_rows) for r in sizes.collect()}

    def group(bucket: int, part: int) -> int:
        return (bucket + part * 0x9E3779B1) % groups

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(vectors(batch))
            for t in range(tables):
                bucket = buckets_of(u, t)
                g = (bucket % groups).astype(np.int64)
                for i in [i for i, x in enumerate(bucket.tolist()) if x in parts] if parts else []:
                    g[i] = group(int(bucket[i]), int(batch.column(0)[i].as_py() % parts[int(bucket[i])]))
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(bucket), batch.column(0), batch.column(1)], names=["g", "bucket", "rep", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(vectors(batch))
            out: list[tuple] = []
            for rep, v, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), u, strict=True):
                bucket = np.concatenate([bucket_ids(probes(x @ a[t] + b[t], width, sigma, mass), t) for t in range(tables)])
                g = bucket % groups
                for i, x in enumerate(bucket.tolist()) if parts else ():
                    if x in parts:
                        more = sorted({group(x, p) for p in range(parts[x])})
                        g[i] = more[0]
                        g, bucket = np.append(g, more[1:]), np.append(bucket, np.full(len(more) - 1, x, np.int64))
                by = np.argsort(g, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(g[by])) + 1):
                    out.append((int(g[part[0]]), rep, v, bucket[part]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64())), pa.array([o[3] for o in out], pa.list_(pa.int64()))], names=["g", "rep", "v", "buckets"])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best candidates of each query among the buckets of one group."""
        kinds = {"query": "int64", "rep": "int64", "score": "float64"}
        none = pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})
        if not len(left) or not len(right):
            return none
        left = left.sort_values(["bucket", "rep"], kind="stable")
        names, starts = np.unique(left["bucket"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(left))
        rep, x = left["rep"].to_numpy(), np.stack(left["v"].to_numpy())
        # a vector is in a group once for each table whose bucket the group has: one row stands for all
        row_at, rows_of = np.unique(rep, return_index=True, return_inverse=True)[1:]
        n_reps = len(row_at)
        query, y = right["rep"].to_numpy(), scaled(np.stack(right["v"].to_numpy()))
        x = scaled(x)
        norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        own = np.concatenate([np.full(len(p), i) for i, p in enumerate(right["buckets"])])
        seen = np.concatenate(right["buckets"].to_numpy())
        at = np.minimum(np.searchsorted(names, seen), len(names) - 1)
        hit = names[at] == seen
        own, at = own[hit], at[hit]
        by = np.argsort(at, kind="stable")
        asked, met = [], []
        for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1) if len(by) else []:
            s, e = starts[at[part[0]]], ends[at[part[0]]]
            q = own[part]
            # candidates by the matrix product; the score itself doesn't depend on where the vectors stand
            i, j = np.nonzero(best_of((y[q] @ x[s:e].T) / (norm_y[q][:, None] * norm_x[s:e][None, :]), top + 1))
            asked.append(q[i])
            met.append(s + j)
        if not asked:
            return none
        pairs = np.unique(np.concatenate(asked) * n_reps + rows_of[np.concatenate(met)])
        q, j = pairs // n_reps, row_at[pairs % n_reps]
        some = range(0, len(q), 1 << 14)  # ties can be many, so the vectors are paired in slices
        cos = np.concatenate([cosine(y[q[k : k + (1 << 14)]], x[j[k : k + (1 << 14)]]) for k in some])
        order = np.lexsort((rep[j], -cos, q))
        q, j, cos = q[order], j[order], cos[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) <= top
        return pd.DataFrame(dict(zip(kinds, (query[q[best]], rep[j[best]], cos[best]), strict=True)))

    placed = index.mapInArrow(place, "g int, bucket long, rep long, v array<double>")
    visits = queries.mapInArrow(visit, "g int, rep long, v array<double>, buckets array<long>")
    scored = placed.groupBy("g").cogroup(visits.groupBy("g")).applyInPandas(score, "query long, rep long, score double")
    merged = scored.groupBy("query", "rep").agg(F.max("score").alias("score"))
    nearest_reps = merged.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("i") <= top + 1).drop("i")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("hash", "v", F.col("vec_id").alias("query_id")).join(index.withColumn("hash", F.xxhash64("v")), ["hash", "v"]).select(F.col("rep").alias("query"), "query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def named(reps: DataFrame) -> DataFrame:
        """Ranked rows for all ids of the queries, from (query, rep, score)."""
        pairs = reps.join(members.select("rep", "vec_id"), "rep").select("query", "vec_id", "score")
        return asked.join(pairs, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top).select("query", "query_id", "rank", "vec_id", "score")

    found = checkpoint(named(nearest_reps))
    # a query whose buckets held too few rows (a lone vector, a tiny table) meets all of them
    full = found.where(F.col("rank") == top).select("query_id")
    short = checkpoint(queries.join(asked.join(full, "query_id", "left_anti").select(F.col("query").alias("rep")).distinct(), "rep"))
    n_short = short.count()
    columns = ["query_id", "rank", "vec_id", "score"]
    if not n_short:
        return found.select(*columns)

    def compare(block: int, n_blocks: int) -> DataFrame:
        """The best rows of all for each query of a block of about EXACT."""
        own = short.where(F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(n_blocks)) == block).orderBy("rep").collect()
        sent = spark.sparkContext.broadcast((np.array([r["rep"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64).reshape(-1, dim)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, y = sent.value[0], scaled(sent.value[1]) if len(sent.value[0]) else sent.value[1]
            norm = np.linalg.norm(y, axis=1)
            held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # query, rep, score of the best so far
            for batch in batches if len(names) else ():
                rep, x = batch.column(0).to_numpy(), scaled(vectors(batch))
                for a in range(0, len(rep), 1024):
                    i, j = np.nonzero(best_of((y @ x[a : a + 1024].T) / (norm[:, None] * np.linalg.norm(x[a : a + 1024], axis=1)[None, :]), top + 1))
                    q, r, c = (np.concatenate(p) for p in zip(held, (i, rep[a + j], cosine(y[i], x[a + j])), strict=True))
                    order = np.lexsort((r, -c, q))
                    q, r, c = q[order], r[order], c[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) <= top
                    held = [q[best], r[best], c[best]]
            yield pa.RecordBatch.from_arrays([pa.array(names[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query", "rep", "score"])

        return index.mapInArrow(run, "query long, rep long, score double")

    n_blocks = groups_of(n_short, EXACT)
    every = reduce(DataFrame.unionByName, [compare(b, n_blocks) for b in range(n_blocks)])
    best = every.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("i") <= top + 1).drop("i")
    exact = named(best)
    return found.join(short.select(F.col("rep").alias("query")), "query", "left_anti").select(*columns).unionByName(exact.select(*columns))
