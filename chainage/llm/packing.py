"""Packing of token sequences: first-fit decreasing on a tournament tree.

Documents go to randomised groups (a seeded hash of the id, so the input's order and
its hot sources don't matter); each group is one task's work and holds about
`docs_per_group` documents, fewer where they are long. In a group a document's full sequences are cut off first,
the rests are placed first-fit decreasing, a tournament tree of bin capacities finding
the first bin with room in logarithmic time. Documents may be cut, so the emptiest
bins are then dissolved into the gaps of the others, and a group's last open bin is
written as sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import groups_of

#: Distinct pieces of text whose ids a Python worker remembers at once.
REMEMBERED = 1_000_000


class Piece(NamedTuple):
    doc: int
    start: int
    length: int


class Tournament:
    """Complete binary tree over bins; an inner node has the largest room below it."""

    def __init__(self, capacity: int, bins: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.capacity = capacity
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first bin with room for need, which is then taken; the tree doubles when none has."""
        room = self.room
        if room[1] < need:
            self._double()
            return self.place(need)
        i = 1
        while i < self.size:
            i *= 2
            if room[i] < need:
                i += 1
        room[i] -= need
        at = i - self.size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at

    def _double(self):
        old, self.size = self.room[self.size :], 2 * self.size
        leaves = old + [self.capacity] * (self.size - len(old))
        self.room = [0] * self.size + leaves
        for i in range(self.size - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])


def first_fit_decreasing(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Bins of pieces, none longer than the capacity; ties go by document and start."""
    tree = Tournament(capacity, max(1, -(-sum(p.length for p in pieces) // capacity)))
    bins: list[list[Piece]] = []
    for p in sorted(pieces, key=lambda p: (-p.length, p.doc, p.start)):
        at = tree.place(p.length)
        while len(bins) <= at:
            bins.append([])
        bins[at].append(p)
    return [b for b in bins if b]


def fill_gaps(bins: list[list[Piece]], capacity: int, least: int) -> list[list[Piece]]:
    """Dissolve the emptiest bins into gaps of at least `least` tokens; the last open bin comes out in powers of two."""
    used = [sum(p.length for p in b) for b in bins]
    full = [b for b, u in zip(bins, used, strict=True) if capacity - u < least]
    open_ = sorted(((u, b) for b, u in zip(bins, used, strict=True) if capacity - u >= least), key=lambda x: -x[0])
    left, right = 0, len(open_) - 1
    donor: list[Piece] = list(open_[right][1]) if open_ else []
    while left < right:
        room = capacity - sum(p.length for p in open_[left][1])
        while room and (donor or left < right - 1):
            if not donor:
                right -= 1
                donor = list(open_[right][1])
            p = donor.pop()
            if p.length > room:
                donor.append(Piece(p.doc, p.start + room, p.length - room))
                p = Piece(p.doc, p.start, room)
            open_[left][1].append(p)
            room -= p.length
        if not room:
            full.append(open_[left][1])
            left += 1
        if not donor and left < right:
            right -= 1
            donor = list(open_[right][1])
        elif not donor:
            return full
    rest, total = donor, sum(p.length for p in donor)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out: list[Piece] = []
        while size:
            p = rest.pop(0)
            if p.length > size:
                rest.insert(0, Piece(p.doc, p.start + size, p.length - size))
                p = Piece(p.doc, p.start, size)
            out.append(p)
            size -= p.length
        full.append(out)
    return full


class Encoder:
    """Token ids of whole texts as little-endian bytes, end id included.

    For a tokenizer that composes and lower-cases, cuts at PIECE, drops white space and
    ends each piece with a token marked `</w>`: texts are cut the same way here, and each
    distinct piece is encoded once and remembered (the memory is emptied when it is full).
    Texts that hold a special token's string are encoded whole.
    """

    #: Fixed value: the tokenizer's own rule for pieces.
    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: The same for texts without numerals other than decimal digits; re.findall is several times faster.
    SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|[_\x1c-\x1f])+"

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id.to_bytes(4, "little")
        self.known: dict[str, bytes] = {}
        self.simple, self.exact = re.compile(self.SIMPLE).findall, regex.compile(self.PIECE.replace(r"[^\s", r"[^\t-\r \x85\p{Z}")).findall
        self.odd = regex.compile(r"[\p{No}\p{Nl}]").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def chunks(self, text: str) -> tuple[list[str], bool]:
        """The text composed and lower-cased, cut at spaces, tabs and line ends; whether it has odd numerals."""
        odd = False
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()  # lower() would give a last sigma its own form
            odd = self.odd(text) is not None
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), odd

    def learn(self, new: list[str]) -> None:
        """Encode pieces, about a thousand in a call; a piece's tokens end at the next marked one."""
        known = self.known
        for at in range(0, len(new), 1000):
            own = new[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(own) or ends[-1] != len(ids):
                for w, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4").tobytes()
                continue
            data, a = ids.tobytes(), 0
            for w, b in zip(own, (4 * ends).tolist(), strict=True):
                known[w] = data[a:b]
                a = b

    def remember(self, chunks: set[str], odd: bool) -> None:
        """Encode chunks that aren't known, by their pieces."""
        known, cut = self.known, self.exact if odd else self.simple
        parts = {c: p for c in chunks if (p := cut(c)) != [c]}
        new = (chunks - parts.keys()).union(*parts.values()).difference(known)
        if new:
            self.learn(list(new))
        for c, p in parts.items():
            known[c] = b"".join([known[x] for x in p])

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        for at in range(0, len(texts), 64):
            held: list[list[str] | bytes] = []
            new: dict[bool, set[str]] = {False: set(), True: set()}
            for text in texts[at : at + 64]:
                if "<|" in text and any(s in text for s in self.special):
                    held.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes())
                else:
                    chunks, odd = self.chunks(text)
                    new[odd].update(chunks)
                    held.append(chunks)
            if len(known) > REMEMBERED:
                known.clear()
            for odd, chunks in new.items():
                self.remember(chunks.difference(known), odd)
            for p in held:
                yield (p if isinstance(p, bytes) else b"".join(map(known.__getitem__, p))) + self.end


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a Python worker: kept with the tokenizers module, which stays loaded."""
    import tokenizers

    made = tokenizers.__dict__.setdefault("_chainage_encoders", {})
    if (path, end_id) not in made:
        made[path, end_id] = Encoder(path, end_id)
    return made[path, end_id]


def pack_group(lengths: list[int], capacity: int, least: int = 8) -> list[list[Piece]]:
    """Sequences of the documents of one group, by their numbers of tokens."""
    whole, rests = [], []
    for doc, n in enumerate(lengths):
        cut = n - n % capacity
        whole += [[Piece(doc, s, capacity)] for s in range(0, cut, capacity)]
        if n > cut:
            rests.append(Piece(doc, cut, n - cut))
    return whole + fill_gaps(first_fit_decreasing(rests, capacity), capacity, least)


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, docs_per_group: int = 2000, bytes_per_group: int = 16 << 20, seed: int = 7, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence.

    Groups hold about docs_per_group documents, and about bytes_per_group of text where
    documents are long. Defined edge cases: null and empty texts are the end id alone; a
    null id and repeated rows are documents of their own (rows that repeat both id and text
    share a group); other columns are ignored; an empty table gives an
    empty result. sequence_id is group * 2^32 + number in the group. with_ids adds the
    piece's ids as an array.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(groups_of(n, docs_per_group), groups_of(size, bytes_per_group))
    # the whole text takes part in the hash, so rows that repeat an id, or have none, spread as well
    grouped = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups)))
    fields = FIELDS + ", ids array<int>" * with_ids

    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        names, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (names[i] is None, names[i] or 0, texts[i]))
        names = [names[i] for i in order]
        ids = list(encoder(tokenizer_path, end_id)([texts[i] for i in order]))
        out = []
        for k, sequence in enumerate(pack_group([len(x) // 4 for x in ids], capacity)):
            offset = 0
            for p in sequence:
                own = memoryview(ids[p.doc])[4 * p.start : 4 * (p.start + p.length)]
                out.append((names[p.doc], p.start, p.length, zlib.crc32(own), len(ids[p.doc]) // 4, (key[0].as_py() << 32) + k, offset, *([np.frombuffer(own, "<i4")] if with_ids else [])))
                offset += p.length
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in fields.split(", ")])

    return grouped.groupBy("g").applyInArrow(run, fields)
