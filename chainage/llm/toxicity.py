"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Folding: lower case, homoglyphs and letters with marks to their plain letter, digit and
sign substitutions to the letter they stand for (l, 1 and | share the letter i), other
signs to spaces. The lexicon has whole words and beginnings of words, weighted by the
log-odds of documents that hold them among labelled rows. A word counts once, by its
heaviest entry, unless an exception phrase covers it. The sum of the weights, normalised
by a power of the text's length in words, goes through a logistic curve; power and curve
are fitted on labelled rows that the lexicon hasn't seen.

The lexicon and the curve are fitted on a bounded sample of labelled rows
(`SAMPLE_ROWS`); scoring is one narrow pass over all rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import checkpoint, plain_names

#: Most labelled rows that a fit uses.
SAMPLE_ROWS = 12_000
#: Most lexicon entries.
ENTRIES = 4_000
#: Powers of the length among which the fit chooses.
POWERS = (0.1, 0.2, 0.3, 0.5, 1.0)
#: Lengths of word beginnings that can become entries.
PREFIXES = (4, 5, 6, 7, 8)
#: Letters of other scripts that look like a Latin one, and substitutions.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "i", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
#: Phrases in which an entry's words are harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown", "idiot proof", "sore loser rule", "stupid simple", "not an idiot", "not stupid", "not worthless")


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))
        out[c] = plain
    out |= {c: "" for c in range(0x300, 0x370)}  # combining marks
    out |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible characters
    out |= {ord(k): v for k, v in HOMOGLYPHS.items()}
    out |= {c: " " for c in range(128) if not chr(c).isalnum()}
    out |= {ord(k): v for k, v in SUBSTITUTES.items()}
    return {k: "".join(SUBSTITUTES.get(x, x) for x in v) for k, v in out.items()}


_FOLD = _table()


def folded(text: str | None) -> str:
    """The text's folded words, each with one space before and after it."""
    return f" {' '.join((text or '').lower().translate(_FOLD).split())} "


def entries_of(text: str | None) -> set[str]:
    """All possible lexicon entries in a text: ' word ' and ' begin'."""
    out = set()
    for w in set(folded(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if len(w) > n)
    return out


class Model(NamedTuple):
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    power: float
    bias: float
    slope: float


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for e, w in lexicon.items():
            self.automaton.add_word(e, (w, len(e)))
        for p in exceptions:
            # an exception replaces an equal entry; a negative weight marks it
            self.automaton.add_word(folded(p), (-1.0, len(folded(p))))
        self.any = len(self.automaton) > 0
        self.automaton.make_automaton()

    def measure(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of a text's words, and its length in words, at least 1."""
        t = folded(text)
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        if self.any:
            for end, (w, n) in self.automaton.iter(t):
                start = end - n + 1
                if w < 0:
                    excused.append((start, end))
                elif w > best.get(start, 0.0):
                    best[start] = w
        for a, b in excused:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sum(best.values()), max(1, t.count(" ") - 1)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def learning_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic, part) of a bounded sample of labelled rows outside the held-out fold: those of smallest hash.

    part 0 is for the lexicon, part 1 for the curve.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    sample = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    part = (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(10)) >= 7).cast("int")
    # the sample's size is a parameter, so it may be broadcast; of a repeated id one text is used
    found = texts.where("text is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return found.select("text", "toxic", part.alias("part"))


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES, least_docs: int = 4, least_share: float = 0.02, least_weight: float = 2.5, smooth: float = 1.0) -> dict[str, float]:
    """Weights of entries by their log-odds in rows (text, toxic), for entries in enough of the toxic rows.

    The three constants were chosen by four-fold cross-validation inside learning rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def sent() -> pa.RecordBatch:
            own = list(both[0].keys() | both[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *[pa.array([c[x] for x in own], pa.int64()) for c in (both[1], both[0])]], names=["entry", "bad", "good"])
            both[0].clear()
            both[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                both[1 if toxic else 0].update(entries_of(text.as_py()))
                both[1 if toxic else 0][""] += 1
                if len(both[0]) + len(both[1]) > 50_000:
                    yield sent()
        yield sent()

    counts = rows.select("text", "toxic").mapInArrow(count, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = counts.where("entry = ''").select(F.col("bad").alias("all_bad"), F.col("good").alias("all_good")).first()
    if total is None or not total["all_bad"] or not total["all_good"]:
        return {}
    weight = F.log((F.col("bad") + smooth) / (total["all_bad"] + 2 * smooth)) - F.log((F.col("good") + smooth) / (total["all_good"] + 2 * smooth))
    chosen = counts.where("entry <> ''").where(F.col("bad") >= max(least_docs, least_share * total["all_bad"])).withColumn("w", weight).where(F.col("w") >= least_weight)
    return {r["entry"]: r["w"] for r in chosen.orderBy(F.desc(F.col("w") * F.col("bad")), "entry").limit(entries).collect()}


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Loss, bias and slope of a logistic curve, by Newton's method."""
    if not len(y) or y.min() == y.max():
        return (0.0, -2.0, 4.0) if not len(y) or not y.max() else (0.0, 2.0, 4.0)
    a = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ beta, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most `rows` labelled rows outside the held-out fold."""
    # one pass over docs; the lexicon and the curve read the sample's texts
    sample = checkpoint(learning_rows(docs, labels, rows))
    lexicon = learn_lexicon(sample.where("part = 0"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for b in batches:
            found = [matcher.measure(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), b.column(1)], names=["total", "words", "toxic"])

    points = sample.where("part = 1").select("text", "toxic").mapInArrow(measure, "total double, words long, toxic int").collect()
    total, words, y = (np.array([p[k] for p in points], np.float64) for k in range(3))
    (_, bias, slope), power = min((fit_curve(total / words**e, np.minimum(1, y)), e) for e in POWERS)
    return Model(lexicon, exceptions, power, bias, slope)


def scorer(model: Model):
    """A function from texts to scores, to be made once in a task."""
    matcher = Matcher(model.lexicon, model.exceptions)

    def run(texts: pa.Array) -> np.ndarray:
        found = [matcher.measure(t.as_py()) for t in texts]
        x = np.array([f[0] for f in found], np.float64) / np.array([f[1] for f in found], np.float64) ** model.power
        return 1 / (1 + np.exp(-np.clip(model.bias + model.slope * x, -700, 700)))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Defined edge cases: null and empty texts score as a text without an entry; a null id
    is not held out; repeated rows stay repeated; without labels of both kinds nothing is
    in the lexicon; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(model)
        for b in batches:
            s = own(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score under the threshold, all columns kept; nothing is shuffled.

    Defined edge cases: null and empty texts score as a text without an entry; null ids,
    repeated rows and columns of any name are carried as they are; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(model)
        for b in batches:
            yield b.filter(pa.array(own(b.column("text")) < threshold))

    rows, given = plain_names(docs, ("text",))
    return rows.mapInArrow(run, rows.schema).toDF(*given)
