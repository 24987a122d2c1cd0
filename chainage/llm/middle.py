"""Fill-in-the-middle transformation of documents by a whole-batch kernel on Arrow's UTF-8 buffers.

A document is cut into units (blanks and the word after them; blanks at its end are one
unit). For all rows of a batch together: a lookup table gives each byte its class, adjacent
classes give the mask of units' last bytes, its running sums, taken from each document's
start, number the units, and one searchsorted finds the byte at which each document's
prefix and middle end. No text is decoded or cut by itself.

Where a document is cut, and in which order its parts stand, comes from the SHA-256 of a
seed and its id, so a task that is run again gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text that the kernel takes at a time (a longer document goes alone); its arrays take about 12 bytes for each.
CHUNK = 8 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


class Batch(NamedTuple):
    """The text of several documents: bytes, and where each starts (one entry more than documents)."""

    data: np.ndarray
    offsets: np.ndarray


def batch_of(texts: pa.Array) -> Batch:
    """The buffers of an array of strings, nulls as empty texts; nothing is copied where there are no nulls."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = at.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Batch(whole[at[0] : at[-1]], at - at[0])


def unit_ends(b: Batch) -> np.ndarray:
    """Mask of the bytes that end a unit: a word's last byte, and a document's last byte."""
    word = _IS_WORD[b.data]
    ends = np.zeros(len(b.data), bool)
    ends[:-1] = word[:-1] & ~word[1:]
    starts, stops = b.offsets[:-1], b.offsets[1:]
    ends[stops[stops > starts] - 1] = True
    return ends


def running(mask: np.ndarray) -> np.ndarray:
    """Running sums with a zero in front."""
    return np.concatenate(([0], np.cumsum(mask, dtype=np.int32 if len(mask) < 1 << 31 else np.int64)))


def holds_mark(b: Batch) -> np.ndarray:
    """Whether each document holds one of the three marks."""
    d = b.data
    if len(d) < 3:
        return np.zeros(len(b.offsets) - 1, bool)
    letter = d[1:-1]
    at = np.flatnonzero((d[:-2] == ord("<")) & (d[2:] == ord(">")) & ((letter == ord("P")) | (letter == ord("S")) | (letter == ord("M"))))
    doc = np.searchsorted(b.offsets, at, "right") - 1
    inside = at + 3 <= b.offsets[doc + 1]
    return np.bincount(doc[inside], minlength=len(b.offsets) - 1).astype(bool)


class Cuts(NamedTuple):
    """For each document: units, bytes at which its prefix and its middle end, code points of both, whether it holds a mark."""

    n: np.ndarray
    first: np.ndarray
    second: np.ndarray
    prefix_chars: np.ndarray
    middle_chars: np.ndarray
    marked: np.ndarray


def cuts(b: Batch, one: np.ndarray, two: np.ndarray) -> Cuts:
    """Where the documents are cut: after the smaller and the larger of one % (n + 1) and two % (n + 1) units."""
    starts, stops = b.offsets[:-1], b.offsets[1:]
    units = running(unit_ends(b))
    n = (units[stops] - units[starts]).astype(np.int64)
    a, c = one % (n + 1), two % (n + 1)
    # the first place in the batch by which so many units have ended; none have at the document's start
    goal = units[starts] + np.stack([np.minimum(a, c), np.maximum(a, c)])
    first, second = np.maximum(np.searchsorted(units, goal.ravel()).reshape(goal.shape), starts)
    chars = running((b.data & 0xC0) != 0x80)
    return Cuts(n, first, second, (chars[first] - chars[starts]).astype(np.int64), (chars[second] - chars[first]).astype(np.int64), holds_mark(b))


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    """The output of a form other than plain."""
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(form: str, output: bytes) -> bytes:
    """The text, from an output and its form alone. Texts that hold a mark are plain, so each mark stands once."""
    if form == "plain":
        return output
    front, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = front[len(PREFIX) :].split(SUFFIX)
    else:
        suffix, prefix = front[len(SUFFIX) :].split(PREFIX)
    return prefix + middle + suffix


def _pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about size bytes or are one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_share: int = 80, with_output: bool = True, digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix_chars, middle_chars and, if asked for, output and the digests output_sha256, restored_sha256.

    rate of 100 documents are transformed, spm_share of 100 of these into the form spm
    (suffix, prefix, middle), the others into psm. restored_sha256 is that of the text
    rebuilt from output and form. Defined edge cases: null and empty texts and texts that
    hold a mark are plain, their output is the text, and prefix_chars and middle_chars are
    null; a null id is hashed as empty; repeated rows are transformed alike; ids of any
    type are hashed as text; an empty table stays empty; other columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", digest)
    rows = rows.select("doc_id", "text", *[part(k).alias(f"h{k + 1}") for k in range(4)])
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long" + ", output string" * with_output + ", output_sha256 string, restored_sha256 string" * digests
    names = [f.split()[0] for f in schema.split(", ")]

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = batch_of(batch.column(1))
        h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in range(2, 6))
        c = cuts(b, h1, h2)
        plain = (np.diff(b.offsets) == 0) | c.marked | (h3 % 100 >= rate)
        form = np.where(plain, "plain", np.where(h4 % 100 < spm_share, "spm", "psm"))
        columns = [batch.column(0), pa.array(c.n), pa.array(form.tolist(), pa.string()), pa.array(c.prefix_chars, mask=plain), pa.array(c.middle_chars, mask=plain)]
        if with_output or digests:
            data, outputs, backs = b.data.tobytes(), [], []
            for f, s, x, y, e in zip(form.tolist(), b.offsets[:-1].tolist(), c.first.tolist(), c.second.tolist(), b.offsets[1:].tolist(), strict=True):
                out = data[s:e] if f == "plain" else arranged(f, data[s:x], data[x:y], data[y:e])
                if with_output:
                    outputs.append(out)
                if digests:
                    backs.append((hashlib.sha256(out).hexdigest(), hashlib.sha256(restored(f, out)).hexdigest()))
            if with_output:
                columns.append(pa.array(outputs, pa.binary()).cast(pa.string()))
            if digests:
                columns += [pa.array([d[k] for d in backs], pa.string()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e in _pieces(batch_of(batch.column(1)).offsets, CHUNK):
                yield some(batch.slice(a, e - a))

    return rows.mapInArrow(run, schema)


def oracle(seed: int = 42, rate: int = 50, spm_share: int = 80) -> str:
    """The same as DuckDB SQL: units by a pattern, parts by joining slices of their list."""
    part = lambda k: f"CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * k + 1}, 8) AS BIGINT)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {", ".join(f"{part(k)} AS h{k + 1}" for k in range(4))} FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm_share} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(len(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
