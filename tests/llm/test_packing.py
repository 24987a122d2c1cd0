import random
import zlib

import numpy as np
import pytest

from chainage.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start long, g string"


def ids_of(text):
    return tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    own, plain = P.Encoder(PATH, 2), tokenizers.Tokenizer.from_file(PATH)
    letters = "abcXYZ 's'll're't 12²½Ⅷ_-.,!?́éÉßΣσİıǅ中文  \x1c\x85\t\n\r😀<|>__ΑΣ Ⅷx'M"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|startoftext|>b c", "It's 'tis we'll", ""]
    for text, got in zip(texts, own(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids + [2], text


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 5)
    own = P.Encoder(PATH, 2)
    texts = [f"word{i} other{i % 3} thing" for i in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [ids_of(t) for t in texts]


def test_first_fit_equals_a_plain_search():
    rng = random.Random(2)
    for _ in range(30):
        pieces = [P.Piece(i, 0, rng.randint(1, 100)) for i in range(rng.randint(0, 200))]
        room, bins = [], []
        for p in sorted(pieces, key=lambda p: (-p.length, p.doc)):
            at = next((i for i, r in enumerate(room) if r >= p.length), None)
            if at is None:
                room.append(100)
                bins.append([])
                at = len(room) - 1
            room[at] -= p.length
            bins[at].append(p)
        assert P.first_fit_decreasing(pieces, 100) == bins


def test_groups_lose_nothing():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.choice([1, 2, 5, 63, 64, 65, rng.randint(1, 400)]) for _ in range(rng.randint(0, 120))]
        got = P.pack_group(lengths, 64, 4)
        seen = {}
        for sequence in got:
            total = sum(p.length for p in sequence)
            assert 0 < total <= 64 and (64 - total < 4 or total & (total - 1) == 0)
            for p in sequence:
                assert p.length > 0
                seen.setdefault(p.doc, []).append((p.start, p.length))
        for doc, n in enumerate(lengths):
            at = 0
            for s, k in sorted(seen[doc]):
                assert s == at
                at += k
            assert at == n


def test_each_token_once_with_few_open_bins():
    rng = random.Random(9)
    cases = [([60, 60, 60], 100), ([2400] * 3, 4096)] + [([rng.randint(1, 200) for _ in range(rng.randint(1, 8))], 100) for _ in range(500)]
    for lengths, capacity in cases:
        got = P.pack_group(lengths, capacity, 8)
        tokens = sorted((p.doc, t) for sequence in got for p in sequence for t in range(p.start, p.start + p.length))
        assert tokens == [(doc, t) for doc, n in enumerate(lengths) for t in range(n)], lengths


def test_pack(spark):
    texts = ["one two three", None, "", "again " * 6000, "Ünïcode 中文", "one two three"]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)] + [(None, "no id", 0, ""), (2**60 + 1, "a large id", 0, ""), (0, "one two three", 5, "x")]
    got = P.pack(spark.createDataFrame(rows, DOCS), PATH, with_ids=True).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        want = ids_of(t)
        if i:
            assert [x for r in own for x in r.ids] == want
        assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(want) for r in own)
    assert {r.doc_id for r in got} == {*range(len(texts)), None, 2**60 + 1}
    assert sum(r.length for r in got) == sum(len(ids_of(t)) for _, t, *_ in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert P.pack(spark.createDataFrame([], DOCS), PATH).count() == 0
