"""Removal of repeated word windows by super-k-mer partitioning.

Each window of `width` consecutive words has a minimiser: the smallest hash of its
runs of `m` words. Consecutive windows that share it travel together as one packed
string to the bucket of that minimiser, so a window's every occurrence reaches the
same bucket while a word is sent about three times instead of `width` times. In the
bucket the windows are sorted and equal neighbours compared byte for byte.

Hot content is taken care of in two ways. A map task combines equal packed strings: only
the occurrence of the smallest document goes on to the bucket, all others are known to
be repeats at once. So copies and common passages, however many documents hold them,
cost a bucket one string per task. And runs of words that are frequent in the whole
corpus (counted in a pass of their own) become minimisers only of windows that have no
other run, so that the surroundings of a common passage spread over many buckets. That
changes the load alone, never the result.

Packed strings of one map task and bucket are sent as one zstd block. What a bucket
finds are word ranges per document; they are joined back to the texts.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import groups_of

#: Odd multiplier of the rolling hash modulo 2^64 (Knuth's MMIX multiplier).
BASE = 6364136223846793005
#: Bytes of text hashed at a time.
CHUNK = 1 << 20
#: Bytes of packed strings and of what is known of their repeats that a map task holds before it sends blocks.
HELD = 12 << 20
_ENTRY = 64
#: A run of words is frequent if it makes up one in so many of all runs; at most so many are.
FREQUENT = 20_000


class _Powers:
    """BASE^i and its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.p = self.inv = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.p) < n:
            n = max(n, 2 * len(self.p))
            for name, base in (("p", BASE), ("inv", pow(BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.p, self.inv


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Text:
    """Bytes with words parted by single spaces and lines; hashes of any run of words."""

    def __init__(self, data: bytes, powers: _Powers):
        b = np.frombuffer(data, np.uint8)
        p, self.inv = powers.upto(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=self.sums[1:])
        seps = np.flatnonzero((b == 32) | (b == 10))
        self.line_end = b[seps] == 10
        self.ends = seps
        self.starts = np.concatenate(([0], seps[:-1] + 1)) if len(seps) else seps

    def runs(self, width: int) -> np.ndarray:
        """Hash of the width words from each word on."""
        s, e = self.starts[: len(self.starts) - width + 1], self.ends[width - 1 :]
        return _mixed((self.sums[e] - self.sums[s]) * self.inv[s])


def super_kmers(texts: list[bytes], width: int, m: int, powers: _Powers, frequent: np.ndarray | None = None):
    """Of texts (words joined by single spaces): row, first word, windows, minimiser, and first and last byte of each super-k-mer, and the bytes."""
    data = b"\n".join(texts) + b"\n"
    t = _Text(data, powers)
    n = len(t.starts)
    if n < width:
        return None
    line = np.cumsum(np.concatenate(([0], t.line_end[:-1])))
    first = np.searchsorted(line, np.arange(len(texts)))
    h = t.runs(m)
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        h = (h >> np.uint64(1)) | ((frequent[at] == h).astype(np.uint64) << np.uint64(63))
    span, w = 1, width - m + 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < w:
        h = np.minimum(h[: len(h) - (w - span)], h[w - span :])
    whole = line[: n - width + 1] == line[width - 1 :]
    edge = np.ones(len(h), bool)
    edge[1:] = (h[1:] != h[:-1]) | (whole[1:] != whole[:-1]) | (line[1 : len(h)] != line[: len(h) - 1])
    at = np.flatnonzero(edge)
    last = np.concatenate((at[1:], [len(h)])) - 1
    keep = whole[at]
    at, last = at[keep], last[keep]
    row = line[at]
    return row, at - first[row], last - at + 1, h[at], t.starts[at], t.ends[last + width - 1], data


def _chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """(Id, variant) and text of `least` words or more, words joined by single spaces, about CHUNK bytes at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, variant, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            if i is None or len(words) < least:
                continue
            ids.append((i, variant))
            texts.append(b" ".join(words))
            size += len(texts[-1])
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def frequent_runs(docs: DataFrame, width: int, m: int, share: int = FREQUENT) -> np.ndarray:
    """Sorted hashes of the runs of m words that make up 1 / share of all or more: at most `share` of them.

    A task keeps the runs that could reach that share in it, so little is shuffled; the sums
    are lower bounds, which suffices for what they are used for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = _Powers(), 0
        kept, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for _, texts in _chunks(batches, width):
            h = _Text(b"\n".join(texts) + b"\n", powers).runs(m)
            total += len(h)
            new, n = np.unique(h, return_counts=True)
            both, number = np.concatenate((kept, new[n > 1])), np.concatenate((counts, n[n > 1]))
            kept, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, weights=number, minlength=len(kept)).astype(np.int64)
            if len(kept) > 4 * share:
                top = np.sort(np.argpartition(-counts, 2 * share)[: 2 * share])
                kept, counts = kept[top], counts[top]
        top = counts >= max(2, total // share)
        kept, counts = np.concatenate((kept[top], [np.uint64(0)])), np.concatenate((counts[top], [0]))
        yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(counts), pa.array([0] * (len(kept) - 1) + [total], pa.int64())], names=["run", "n", "total"])

    found = docs.select("doc_id", "text", "variant").mapInArrow(run, "run long, n long, total long").groupBy("run").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = found.orderBy(F.desc("total"), F.desc("n"), "run").limit(share + 1).collect()
    total = max((r["total"] for r in rows), default=0)
    return np.sort(np.array([r["run"] for r in rows if r["n"] >= max(2, -(-total // share))], np.int64).view(np.uint64))


#: Kinds of blocks: packed strings, and ranges of words that a map task has found.
_STRINGS, _RANGES = b"\0", b"\1"


def _planes(x: np.ndarray) -> bytes:
    """Differences of whole numbers, first bytes first: mostly zeros, which compress away."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _whole(data: memoryview, n: int, kind: type) -> np.ndarray:
    """The numbers that _planes has written."""
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind).ravel(), dtype=kind)


class _Held:
    """Packed strings of a map task, equal ones combined."""

    def __init__(self, width: int, n_buckets: int):
        self.width, self.n_buckets, self.turn = width, n_buckets, 0
        self.clear()

    def clear(self):
        self.known: dict[bytes, list[tuple[tuple[int, int], int, int, int]]] = {}  # (doc, word, windows, bucket), all of one id
        self.ranges: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, string: bytes, doc: tuple[int, int], word: int, windows: int, bucket: int) -> None:
        own = self.known.get(string)
        if own is None:
            self.known[string] = [(doc, word, windows, bucket)]
            self.size += len(string)
            return
        self.size += _ENTRY  # an occurrence more, or a range
        if doc[0] == own[0][0][0]:
            own.append((doc, word, windows, bucket))
        elif doc[0] > own[0][0][0]:  # a smaller document has all of these windows
            self.ranges.append((*doc, word, word + windows + self.width - 2))
        else:
            self.ranges += [(*d, w, w + n + self.width - 2) for d, w, n, _ in own]
            own[:] = [(doc, word, windows, bucket)]

    def sent(self, packer: zstandard.ZstdCompressor) -> pa.RecordBatch:
        by: dict[int, list[tuple[bytes, tuple[int, int], int]]] = {}
        for string, own in self.known.items():
            for doc, word, _, bucket in own:
                by.setdefault(bucket, []).append((string, doc, word))
        names, out = [], []
        for bucket, rows in by.items():
            ids, words = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int32)
            ids, variants = np.ascontiguousarray(ids[:, 0]), np.ascontiguousarray(ids[:, 1])
            names.append(bucket)
            out.append(packer.compress(b"".join((_STRINGS, len(rows).to_bytes(8, "little"), _planes(ids), _planes(variants), _planes(words), b"\n".join(r[0] for r in rows), b"\n"))))
        for at in range(0, len(self.ranges), 4096):  # any bucket will do for what is known already
            names.append(self.turn % self.n_buckets)
            self.turn += 1
            out.append(packer.compress(_RANGES + np.array(self.ranges[at : at + 4096], np.int64).tobytes()))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "block"])


def blocks(docs: DataFrame, n_buckets: int, width: int, m: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(bucket, block): the packed strings of docs (doc_id, text), and the ranges found on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, packer, held = _Powers(), zstandard.ZstdCompressor(level=6), _Held(width, n_buckets)
        held.turn = random.Random(TaskContext.get().partitionId()).randrange(n_buckets)
        for ids, texts in _chunks(batches, width):
            got = super_kmers(texts, width, m, powers, frequent)
            if got is None:
                continue
            row, word, windows, minimum, a, b, data = got
            bucket = ((minimum >> np.uint64(17)) % np.uint64(n_buckets)).tolist()
            add = held.add
            for i, w, n, g, x, y in zip(row.tolist(), word.tolist(), windows.tolist(), bucket, a.tolist(), b.tolist(), strict=True):
                add(data[x:y], ids[i], w, n, g)
                if held.size >= HELD:
                    yield held.sent(packer)
        yield held.sent(packer)

    return docs.select("doc_id", "text", "variant").mapInArrow(run, "bucket int, block binary")


def _repeated(parts: list[bytes], width: int, powers: _Powers):
    """(doc, variant, word) of each window in opened blocks of strings that a smaller document has too."""
    hashes, docs, variants, words, froms, tos, source, texts = [], [], [], [], [], [], [], []
    for k, raw in enumerate(parts):
        n = int.from_bytes(raw[:8], "little")
        view = memoryview(raw)
        ids, forms = (_whole(view[8 + 8 * k * n : 8 + 8 * (k + 1) * n], n, np.int64) for k in (0, 1))
        pos, data = _whole(view[8 + 16 * n : 8 + 20 * n], n, np.int32), raw[8 + 20 * n :]
        t = _Text(data, powers)
        line = np.cumsum(np.concatenate(([0], t.line_end[:-1])))
        first = np.searchsorted(line, np.arange(n))
        ok = np.flatnonzero(line[: len(line) - width + 1] == line[width - 1 :])
        row = line[ok]
        hashes.append(t.runs(width)[ok])
        docs.append(ids[row])
        variants.append(forms[row])
        words.append((pos[row] + (ok - first[row])).astype(np.int32))
        froms.append(t.starts[ok].astype(np.int32))
        tos.append(t.ends[ok + width - 1].astype(np.int32))
        source.append(np.full(len(ok), k, np.int32))
        texts.append(data)
    h, doc, word, a, b, src = (np.concatenate(x) for x in (hashes, docs, words, froms, tos, source))
    order = np.lexsort((word, doc, h))
    h, doc = h[order], doc[order]
    same = np.concatenate((h[1:] == h[:-1], [False]))
    same[1:] |= same[:-1].copy()  # every row of a hash that has two rows or more
    start = np.concatenate(([True], h[1:] != h[:-1]))
    lead = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
    cand = np.flatnonzero(same & (doc > doc[lead]))
    out = []
    leader, window, others = -1, b"", {}
    for c, ld in zip(cand.tolist(), lead[cand].tolist(), strict=True):
        o = order[c]
        text = texts[src[o]][a[o] : b[o]]
        if ld != leader:
            q = order[ld]
            leader, window, others = ld, texts[src[q]][a[q] : b[q]], {}
        if text == window:
            out.append(o)
        else:  # two texts with one hash: sorted by document, so the first seen is the smallest
            if not others:
                for r in range(ld, c):
                    q = order[r]
                    others.setdefault(texts[src[q]][a[q] : b[q]], doc[r])
            if others.setdefault(text, doc[c]) < doc[c]:
                out.append(o)
    out = np.array(out, np.int64)
    return np.concatenate(docs)[out], np.concatenate(variants)[out], word[out]


def repeated_ranges(docs: DataFrame, n_buckets: int, width: int = 13, m: int = 3) -> DataFrame:
    """(doc_id, variant, lo, hi): runs of words, both ends in, covered by windows that a smaller document has too."""

    def run(keys, found):
        import pandas as pd

        opener = zstandard.ZstdDecompressor()
        strings, ranges = [], [np.empty((0, 4), np.int64)]
        for block in found["block"]:
            raw = opener.decompress(block)
            if raw[:1] == _STRINGS:
                strings.append(raw[1:])
            else:
                ranges.append(np.frombuffer(raw, np.int64, offset=1).reshape(-1, 4))
        known = np.concatenate(ranges)
        known = pd.DataFrame({"doc_id": known[:, 0], "variant": known[:, 1], "lo": known[:, 2].astype(np.int32), "hi": known[:, 3].astype(np.int32)})
        if not strings:
            return known
        doc, variant, word = _repeated(strings, width, _Powers())
        order = np.lexsort((word, variant, doc))
        doc, variant, word = doc[order], variant[order], word[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1]) | (word[1:] > word[:-1] + 1)
        at = np.flatnonzero(new)
        end = np.concatenate((at[1:], [len(doc)])) - 1 if len(at) else at
        new = pd.DataFrame({"doc_id": doc[at], "variant": variant[at], "lo": word[at].astype(np.int32), "hi": (word[end] + width - 1).astype(np.int32)})
        return pd.concat([known, new], ignore_index=True) if len(known) else new

    return blocks(docs, n_buckets, width, m, frequent_runs(docs, width, m)).groupBy("bucket").applyInPandas(lambda key, pdf: run(key, pdf), "doc_id long, variant long, lo int, hi int")


def with_variants(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with variant: 0, but for ids that bear several texts, whose texts are told apart by a hash. Only ids and hashes are shuffled to find these."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("several"))
    if several.isEmpty():
        return docs.withColumn("variant", F.lit(0).cast("long"))
    return docs.join(several, "doc_id", "left").select("doc_id", "text", F.when(F.col("several"), own).otherwise(F.lit(0)).cast("long").alias("variant"))


def remove_repeats(docs: DataFrame, width: int = 13, m: int = 3, docs_per_bucket: int = 1000, n_buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text.

    A word goes if a window over it also starts in a document with a smaller doc_id.
    Defined edge cases: a null or empty text has no words (sha256 of nothing); a null
    doc_id is neither smaller nor larger than another, so its row stays whole; repeated
    rows of one id and text get the same result; rows that share an id but not their
    text are judged each by itself, and none of them is a smaller document to the others;
    other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_buckets = n_buckets or groups_of(docs.count(), docs_per_bucket)
    docs = with_variants(docs)
    spans = repeated_ranges(docs, n_buckets, width, m).groupBy("doc_id", "variant").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if spans:
                    gone = bytearray(n)
                    for x in spans:
                        gone[x["lo"] : x["hi"] + 1] = b"\1" * (x["hi"] + 1 - x["lo"])
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                kept = b" ".join(words)
                rows.append((i, n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if with_text else [])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (4 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=[x.split()[0] for x in fields.split(", ")])

    return docs.join(spans, ["doc_id", "variant"], "left").select("doc_id", "text", "spans").mapInArrow(run, fields)
