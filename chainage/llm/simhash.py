"""SimHash near-duplicates through pivot distance tables.

1. Fingerprints: one pass over the texts (Arrow batches), 8 bytes a document,
   checkpointed because two later joins need them.
2. Equal fingerprints collapse to one node (a map-side combined minimum), so a
   group of exact copies of any size is one row from here on; a node is its fingerprint.
3. Pivot tables: the Hamming distances of a fingerprint to PIVOTS reference
   fingerprints, kept per block of bits, so that the distance to a pivot is the
   sum of its block coordinates. Two fingerprints that differ in at most d bits
   agree on all coordinates of n_blocks - d blocks (each differing bit touches one
   block), so they meet under the key of at least one choice of that many blocks.
4. Under a key, pairs whose coordinates (full distances to the pivots) differ by
   more than d anywhere are discarded, and the XOR of the survivors is counted.
   Only links to a class's smallest member leave the task: at most n - 1 of n
   rows, never all pairs. Large classes are split again by smaller blocks.
5. Connected components by alternating stars, checkpointed each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import checkpoint

SEED = 42
BITS = 64
PIVOTS = 16
#: Places to which a component's smallest id is sent.
SALTS = 16
#: Fingerprints under one key that are compared directly; larger classes are split first.
DIRECT = 2048


def splitmix64(n: int, seed: int = 20240229) -> list[int]:
    """n pseudo-random 64-bit values by the public splitmix64 rule: the reference fingerprints."""
    out, state, mask = [], seed, (1 << 64) - 1
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return out


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of width words, repeats included; of fewer words, of all of them. Null and wordless texts have none."""
    # bytes.lower() touches A-Z only and bytes.split() cuts at \x20 and \x09-\x0D only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    runs = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in runs), np.uint64, n - width + 1)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; without any, all are 0."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of one text. Null and wordless texts: 0."""
    return fingerprint(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def blocks(n: int) -> list[int]:
    """Masks of n runs of bits that together make 64."""
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def n_blocks_for(nodes: int, distance: int) -> int:
    """Blocks of the key: few for small sets, more (longer keys) as they grow, so that chance meetings stay rare."""
    return distance + (2 if nodes < 1 << 24 else 3 if nodes < 1 << 31 else 4)


def pivot_keys(nodes: DataFrame, distance: int, n_blocks: int) -> DataFrame:
    """(key, fp, node): one row for each choice of n_blocks - distance blocks."""
    masks = blocks(n_blocks)
    pivots = [_signed(p) for p in splitmix64(PIVOTS)]

    def coordinates(mask: int):
        return [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(_signed(mask)))) for p in pivots]

    tables = nodes.select("fp", "node", *[F.xxhash64(*coordinates(m)).alias(f"b{i}") for i, m in enumerate(masks)])
    keys = [F.xxhash64(F.lit(k), *[F.col(f"b{i}") for i in chosen]) for k, chosen in enumerate(combinations(range(n_blocks), n_blocks - distance))]
    return tables.select("fp", "node", F.explode(F.array(*keys)).alias("key"))


def _pairs(fp: np.ndarray, distance: int, pivots: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Join the classes of all pairs of fp within the distance; labels: class of each row, the smallest row number in it."""
    n = len(fp)
    first = np.bitwise_count(fp ^ pivots[0]).astype(np.int16)
    order = np.argsort(first, kind="stable")
    fp, first = fp[order], first[order]
    tables = np.stack([np.bitwise_count(fp ^ p) for p in pivots[1:]]).astype(np.int8)
    label = labels[order]
    # sorted by the first pivot: a row's partners end where that coordinate has grown by more than the distance
    ends = np.searchsorted(first, first + distance, side="right")
    for shift in range(1, int((ends - np.arange(n)).max(initial=1))):
        i = np.flatnonzero(ends[: n - shift] > np.arange(shift, n))
        i = i[label[i] != label[i + shift]]
        if len(i):
            i = i[(np.abs(tables[:, i] - tables[:, i + shift]) <= distance).all(axis=0)]
            i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= distance]
        if len(i):
            _join(label, i, i + shift)
    out = labels.copy()
    out[order] = label
    return out


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Classes of linked rows become one, in place."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            x = y
        return x

    for x, y in set(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    if root:
        old = np.fromiter(root, label.dtype, len(root))
        new = np.fromiter((find(x) for x in root), label.dtype, len(root))
        by = np.argsort(old)
        at = np.minimum(np.searchsorted(old[by], label), len(old) - 1)
        hit = old[by][at] == label
        label[hit] = new[by][at[hit]]


def classes(fp: np.ndarray, distance: int, pivots: np.ndarray, labels: np.ndarray | None = None, depth: int = 3) -> np.ndarray:
    """Classes of the rows of one key under links of at most the distance."""
    n = len(fp)
    labels = np.arange(n) if labels is None else labels
    if n <= DIRECT or depth == 0:
        return _pairs(fp, distance, pivots, labels)
    # distance + 1 pieces of the bits that still differ: a linked pair agrees on one of them
    differ = np.bitwise_or.reduce(fp ^ fp[0])
    positions = [p for p in range(BITS) if int(differ) >> p & 1]
    for piece in np.array_split(np.array(positions, dtype=np.int64), distance + 1):
        mask = np.uint64(sum(1 << int(p) for p in piece))
        value = fp & mask
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                sub, back = np.unique(labels[rows], return_inverse=True)
                if len(sub) > 1:
                    new = classes(fp[rows], distance, pivots, back.astype(np.int64), depth - 1)
                    _join(labels, rows, rows[_first_of(new)])
    return labels


def _first_of(label: np.ndarray) -> np.ndarray:
    """For each row the first row of its class."""
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    return first[back]


def links(nodes: DataFrame, distance: int = 3, n_blocks: int = 5) -> DataFrame:
    """(a, b), a > b: links that span every class of nodes (fp, node) under the distance."""
    pivots = np.array(splitmix64(PIVOTS), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def closed(key, fp, node):
            """Links of all whole keys in sorted rows."""
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            size = ends - starts
            a, b = [], []
            two = starts[size == 2]
            for p in pivots:
                two = two[np.abs(np.bitwise_count(fp[two] ^ p).astype(np.int8) - np.bitwise_count(fp[two + 1] ^ p).astype(np.int8)) <= distance]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            a.append(np.maximum(node[two], node[two + 1]))
            b.append(np.minimum(node[two], node[two + 1]))
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                by = np.argsort(node[s:e], kind="stable")
                own = node[s:e][by]
                top = own[_first_of(classes(fp[s:e][by], distance, pivots))]
                a.append(own[own != top])
                b.append(top[own != top])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            key, fp, node = (batch.column(i).to_numpy() for i in range(3))
            held.append((key, fp.view(np.uint64), node))
            if len(key) and held[0][0][0] != key[-1]:  # all keys but the last are whole
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                yield closed(*(x[:cut] for x in rows))
                held = [tuple(x[cut:] for x in rows)]
        if held and sum(len(x[0]) for x in held):
            yield closed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    keyed = pivot_keys(nodes, distance, n_blocks).repartition("key").sortWithinPartitions("key", "fp")
    return keyed.select("key", "fp", "node").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have an edge (a, b).

    Alternating large and small stars; each round is checkpointed. A star's centre
    is found by a map-side combined minimum, so no neighbourhood is gathered.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: a node's larger neighbours move to its smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours move to the smallest of them
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = checkpoint(small.where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def smallest_ids(linked: DataFrame) -> DataFrame:
    """(node, component_id) of linked (node, component, least): the smallest of a component's least.

    The components go to SALTS places each, so a component with many nodes is no hot key.
    """
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    # repeated rows compress well, so their size would be taken for small: not to be broadcast
    salted = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return linked.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(salted, ["component", "salt"]).select("node", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Classes are those of fingerprints, so every row links. Defined edge cases: null and
    empty texts have fingerprint zero and link like any other; a row with a null id links
    as well and gets the smallest id of its class (null if the class has none); repeated
    rows stay repeated, and one id with several texts is in several classes; an empty
    table gives an empty result; other columns of docs are ignored. Ids have to be whole
    numbers.
    """
    marked = checkpoint(fingerprints(docs, id_col, text_col))
    nodes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), distance, n_blocks_for(nodes.count(), distance)))
    # nodes of a component, its smallest node included; all others keep their own smallest id
    known = found.union(found.select(F.col("component").alias("node"), "component").distinct())
    linked = smallest_ids(known.join(nodes.withColumnRenamed("fp", "node"), "node"))
    component_id = F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")
    # kept, so that Spark can split a fingerprint of many rows in the join
    reached = checkpoint(nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", component_id))
    return marked.join(reached, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
