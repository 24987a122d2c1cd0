"""Benchmark decontamination by q-gram lemma filtering.

An item of n characters lies in a document within k edits only if some band of
diagonals (document position minus item position) of width k holds at least
n - q + 1 - k * q shared q-grams. q is 8, or less for items so short that the bound would
not be positive (q <= n / (k + 1)), so no item within the budget is lost. Shared q-grams
are counted in overlapping bands of width 2k, a step of k apart, so that each such band
lies whole in one of them; bands that reach the bound are retained and verified by banded
alignment, neighbouring ones at once.

A q-gram that stands again and again in a text (rules, fillers) counts as one run of
diagonals, so a long filler costs a run for each place of the gram in the items and not one
count for each of its characters.

The benchmark is a query set against all documents. It goes to the tasks in blocks of a
fixed size, each block in a pass of its own over the documents: what is sent at once
doesn't grow with the benchmark, and nothing is shuffled.

Texts are compared lower-cased, with each run of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import plain_names

#: Characters of the benchmark in one block (about 16 bytes each in a task).
BLOCK_CHARS = 4_000_000
#: Items shorter than this allow no edit and are found as whole words only: "yes" isn't in "eyes".
LEAST_CHARS = 8
#: Characters of documents that are filtered at a time.
CHUNK = 1 << 20
_TABLE_BITS = 22
#: Counts that are held at a time; a text that needs more is counted for some of the items after the other.
HELD = 2_000_000
#: Diagonals that are aligned at a time.
WIDE = 1 << 16


class Hit(NamedTuple):
    item: int
    start: int
    end: int
    edits: int
    similarity: float


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """32-bit hash of the q code points from each place on; equal grams have equal hashes."""
    base = 0x9E3779B1
    h, span = (x + np.uint32(1)) * np.uint32(0x85EBCA6B), 1
    while span < q:
        step = min(span, q - span)
        h = h[: len(h) - step] * np.uint32(base) + (h[step:] ^ (h[step:] >> np.uint32(15)))
        base = (base * base + 2) & 0xFFFFFFFF
        span += step
    return h


def banded(item: np.ndarray, region: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Fewest edits of the whole item in the region, and where it ends there.

    The diagonals low to high (region position minus item position) are searched; the
    ends of the region are free. An array over diagonals is a row of the table.
    """
    width = high - low + 1
    far = len(item) + len(region) + 1
    padded = np.full(len(item) + len(region) + 2 * width + 2 * abs(low) + 2, 0xFFFFFFFF, np.uint32)
    shift = max(0, -low)
    padded[shift : shift + len(region)] = region
    diagonal = np.arange(width, dtype=np.int32)
    start = low + diagonal
    row = np.where((start >= 0) & (start <= len(region)), 0, far).astype(np.int32)
    for i, c in enumerate(item):
        at = i + low + shift
        now = row + (padded[at : at + width] != c)
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)
        row = np.minimum.accumulate(now - diagonal) + diagonal
    end = len(item) + start
    row = np.where((end >= 0) & (end <= len(region)), row, far)
    best = int(row.argmin())
    return int(row[best]), len(item) + low + best


def gram_length(n: int, edits: int, q: int) -> int:
    """The length of q-grams, at most q, for an item of n characters: its bound n - q + 1 - edits * q is 1 or more."""
    return max(1, min(q, n // (edits + 1)))


class Index:
    """The items of a block: their q-grams by the length of gram that they need."""

    def __init__(self, items: list[str], q: int, max_edit_share: float):
        every = [codes(t) for t in items]
        of: dict[int, list[int]] = {}
        for i, c in enumerate(every):
            if len(c):
                of.setdefault(gram_length(len(c), int(len(c) * max_edit_share), q), []).append(i)
        self.parts = [Grams([every[i] for i in own], own, g, max_edit_share) for g, own in sorted(of.items())]

    def search(self, texts: list[str]) -> list[list[Hit]]:
        """The best place of each item that lies in each text (normalised)."""
        out: list[list[Hit]] = [[] for _ in texts]
        if not self.parts or not texts:
            return out
        whole = codes("\n".join(texts) + "\n")  # no normalised text holds a line end
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        for part in self.parts:
            part.search(whole, begins, lengths, out)
        for hits in out:
            hits.sort()
        return out


class Grams:
    """q-grams of items with one q: sorted hashes with their places. own: the items' numbers."""

    def __init__(self, items: list[np.ndarray], own: list[int], q: int, max_edit_share: float):
        self.q, self.own, self.codes = q, own, items
        self.n = np.array([len(c) for c in items], np.int64)
        self.edits = (self.n * max_edit_share).astype(np.int64)
        self.least = self.n - q + 1 - self.edits * q
        self.step = np.maximum(1, self.edits)
        hashes = [grams(c, q) for c in items]
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")  # places of one gram stay in the order of the items
        self.hash, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(every)))
        self.owner, self.place = owner[order], place[order]
        # grams are this far apart where they count as two: so one counts once in a band
        self.gap = max(64, 3 * int(self.step.max()))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hash >> np.uint32(32 - _TABLE_BITS)] = True

    def runs(self, whole: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """(gram, text, first, last): the places of grams of the items, those near each other in one text as one run."""
        h = grams(whole, self.q)
        at = np.flatnonzero(self.table[h >> np.uint32(32 - _TABLE_BITS)])
        g = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[g] == h[at]
        at, g = at[ok], g[ok]
        order = np.argsort(g, kind="stable")
        at, g = at[order], g[order]
        text = np.searchsorted(begins, at, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1]) | (np.diff(at) > self.gap)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(at)) - 1 if len(start) else start
        order = np.argsort(text[start], kind="stable")
        return tuple(x[order] for x in (g[start], text[start], at[start], at[end]))

    def bands(self, runs: tuple[np.ndarray, ...], n_texts: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(item, text, first band, last band) of bands that reach the bound; each text in one piece."""
        if not len(runs[0]):
            return
        # texts are taken together until they need HELD counts
        load = np.cumsum(self.count[runs[0]])
        ends = np.flatnonzero(np.append(np.diff(runs[1]) > 0, True)) + 1
        start, before = 0, 0
        for e, after in zip(ends.tolist(), np.append(ends[1:], ends[-1]).tolist(), strict=True):
            if e == ends[-1] or load[after - 1] - before > HELD:
                yield from self._counted([x[start:e] for x in runs], n_texts, size, int(load[e - 1] - before))
                start, before = e, int(load[e - 1])

    def _counted(self, runs: list[np.ndarray], n_texts: int, size: int, load: int) -> Iterator[tuple[int, int, int, int]]:
        slices = max(1, -(-load // HELD))
        cuts = np.linspace(0, len(self.codes), min(slices, len(self.codes)) + 1).astype(int)
        most = int(self.n.max())
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first, count = self.first[runs[0]], self.count[runs[0]]
            if slices > 1:  # the places of the items low to high only
                among = np.concatenate(([0], np.cumsum((self.owner >= low) & (self.owner < high))))
                until = np.concatenate(([0], np.cumsum(self.owner < low)))
                first, count = first + until[first + count] - until[first], among[first + count] - among[first]
            run = np.repeat(np.arange(len(count)), count)
            posting = np.repeat(first, count) + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            item = self.owner[posting]
            shift, step = most - self.place[posting], self.step[item]
            bands = size + most + 3  # more than there are, so that ranges of bands never touch those of the next text
            base = (item * n_texts + runs[1][run]) * bands + 1
            begin, end = base + (runs[2][run] + shift) // step - 1, base + (runs[3][run] + shift) // step + 1
            key = np.concatenate((begin, end))
            change = np.concatenate((np.ones(len(begin), np.int64), -np.ones(len(end), np.int64)))
            names, back = np.unique(key, return_inverse=True)
            votes = np.cumsum(np.bincount(back, weights=change, minlength=len(names)).astype(np.int64))
            kept = votes >= np.maximum(1, self.least[np.minimum(names // (n_texts * bands), len(self.codes) - 1)])
            edge = np.diff(np.concatenate(([0], kept.astype(np.int8), [0])))
            for a, b in zip(names[np.flatnonzero(edge == 1)].tolist(), names[np.flatnonzero(edge == -1)].tolist(), strict=True):
                (i, t), band = divmod(a // bands, n_texts), a % bands - 1
                yield i, t, band, b - a + band - 1

    def search(self, whole: np.ndarray, begins: np.ndarray, lengths: np.ndarray, out: list[list[Hit]]) -> None:
        """Adds the best place of each item in each text to out."""
        if len(whole) < self.q:
            return
        found: dict[tuple[int, int], Hit] = {}
        most = int(self.n.max())
        for i, t, first, last in self.bands(self.runs(whole, begins), len(begins), len(whole)):
            best = found.get((t, i))
            if best and not best.edits:
                continue
            k, step, n = int(self.edits[i]), int(self.step[i]), int(self.n[i])
            begin, end = int(begins[t]), int(begins[t] + lengths[t] - 1)
            # the last band reaches to last * step + 2 * step
            low, high = max(first * step - most, begin - n - k), min((last + 2) * step - most, end + k)
            for part in range(low, high + 1, WIDE):
                till = min(high, part + WIDE)
                a, b = max(begin, part - k), min(end, till + n + k)
                if b <= a:
                    continue
                hit = self.verify(i, whole[a:b], part - k - a, till + k - a, k)
                if hit and (not best or (hit[0], hit[1] + a - begin) < (best.edits, best.start)):
                    found[t, i] = best = Hit(self.own[i], hit[1] + a - begin, hit[2] + a - begin, hit[0], 1 - hit[0] / n)
                    if not hit[0]:
                        break
        for (t, _), hit in found.items():
            out[t].append(hit)

    def verify(self, i: int, region: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
        """(edits, start, end) in the region, or None beyond k edits."""
        item, n = self.codes[i], len(self.codes[i])
        data, wanted = region.tobytes(), item.tobytes()
        exact = data.find(wanted)
        while exact > 0 and exact % 4:
            exact = data.find(wanted, exact + 1)
        if exact >= 0:
            return 0, exact // 4, exact // 4 + n
        edits, end = banded(item, region, low, high)
        if edits > k:
            return None
        # the same alignment from its end backwards gives the start
        part = region[max(0, end - n - k) : end][::-1]
        _, back = banded(item[::-1], part, -k, k)
        return edits, end - back, end


class Short:
    """Items that are too short for edits: found exactly, where no letter, digit or underscore is beside them."""

    def __init__(self, items: list[str]):
        self.items = items
        self.automaton = ahocorasick.Automaton()
        for text in set(items) - {""}:
            self.automaton.add_word(text, text)
        if len(self.automaton):
            self.automaton.make_automaton()

    def search(self, text: str) -> list[Hit]:
        """The first place of each item in a normalised text."""
        if not len(self.automaton):
            return []
        inner = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        first: dict[str, int] = {}
        for end, found in self.automaton.iter(text):
            start = end + 1 - len(found)
            beside = (inner(start - 1) and inner(start)) or (inner(end + 1) and inner(end))
            if not beside and found not in first:
                first[found] = start
        return [Hit(k, first[t], first[t] + len(t), 0, 1.0) for k, t in enumerate(self.items) if t in first]


class Searcher:
    """Items by their length: short ones as words, others within edits."""

    def __init__(self, items: list[tuple[int | None, str]], least_chars: int, q: int, max_edit_share: float):
        self.short = [k for k, (_, t) in enumerate(items) if 0 < len(t) < least_chars]
        self.long = [k for k, (_, t) in enumerate(items) if t and len(t) >= least_chars]
        self.words = Short([items[k][1] for k in self.short])
        self.index = Index([items[k][1] for k in self.long], q, max_edit_share)

    def search(self, texts: list[str]) -> list[list[Hit]]:
        """The best place of each item in each normalised text, by the item's number."""
        near = self.index.search(texts) if self.long else [[] for _ in texts]
        return [[h._replace(item=self.long[h.item]) for h in hits] + [h._replace(item=self.short[h.item]) for h in self.words.search(t)] for hits, t in zip(near, texts, strict=True)]


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items, normalised, in blocks of about block_chars characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield [(r["item_id"], normalised(r["text"])) for r in own]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def matches(docs: DataFrame, benchmark: DataFrame, q: int = 8, max_edit_share: float = 0.1, block_chars: int = BLOCK_CHARS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits, similarity): the best place of each item in each document that holds it.

    start and end are positions in the normalised text; of places with as few edits, the
    first. Every item that lies whole in a text within max_edit_share of its length is
    found; items shorter than least_chars normalised characters are found exactly and as
    whole words. Defined edge cases: null and empty texts and items match nothing; a null doc_id or item_id is carried as null;
    repeated documents repeat their matches, repeated items count once; an empty
    benchmark or table gives an empty result; other columns are ignored. Ids have to be
    whole numbers.
    """
    fields = "doc_id long, item_id long, start long, end long, edits int, similarity double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def searcher(items: list[tuple[int | None, str]]):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            index = Searcher(own, least_chars, q, max_edit_share)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [normalised(t.as_py()) for t in batch.column(1)]
                for a, b in _chunks(texts):
                    out = [(i, own[h.item][0], h.start, h.end, h.edits, h.similarity) for i, hits in zip(ids[a:b], index.search(texts[a:b]), strict=True) for h in hits]
                    if out:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

        return rows.mapInArrow(run, fields)

    return reduce(DataFrame.unionByName, [searcher(items) for items in item_blocks(benchmark, block_chars)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 8, max_edit_share: float = 0.1, block_chars: int = BLOCK_CHARS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of docs whose text holds no item (as in matches), all columns kept.

    Defined edge cases: rows without text stay; a null id, repeated rows and columns of
    any name are carried as they are; an empty benchmark or table changes nothing.
    """

    def searcher(kept: DataFrame, items: list[tuple[int | None, str]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Searcher(sent.value, least_chars, q, max_edit_share)
            for batch in batches:
                texts = [normalised(t.as_py()) for t in batch.column("text")]
                clean = [not hits for a, b in _chunks(texts) for hits in index.search(texts[a:b])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return kept.mapInArrow(run, kept.schema)

    rows, given = plain_names(docs, ("text",))
    return reduce(searcher, item_blocks(benchmark, block_chars), rows).toDF(*given)
