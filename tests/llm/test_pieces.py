"""Pieces of texts that are encoded together."""

import random

import pyarrow as pa

from tidewrit.llm import kernels, shards

PARTS = ["foo", " the", "!", "...", "'s", "12", "é", "国", "🙂", "　", "\x85", "\x0b", "\x1c", "\x00", "  ", "\n", "\r\n", "\t", "a" * 600]


class Counting:
    def __init__(self, bpe):
        self.bpe, self.calls = bpe, 0

    def encode_ordinary(self, text):
        self.calls += 1
        return self.bpe.encode_ordinary(text)


def test_new_pieces_of_a_chunk_are_encoded_in_one_call():
    p = shards.Pieces(shards.read_vocabulary(shards.VOCABULARY))
    whole, p.bpe = p.bpe, Counting(p.bpe)
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(50)) for i in range(20)])
    ids, off = p.encode(*kernels.raw(texts))
    assert p.bpe.calls <= 25  # 20 texts begin without a blank
    assert all(ids[off[i] : off[i + 1]].tolist() == [*whole.encode_ordinary(t), shards.END] for i, t in enumerate(texts.to_pylist()))


def test_counts_are_those_of_the_ids():
    p, r = shards.Pieces(shards.read_vocabulary(shards.VOCABULARY)), random.Random(2)
    for turn in range(30):
        texts = pa.array([None, "", *("".join(r.choice(PARTS if r.random() < 0.2 else PARTS[:9]) + r.choice(["", " "]) for _ in range(r.randint(0, 30))) for _ in range(40))])
        assert p.count(*kernels.raw(texts)) == len(p.encode(*kernels.raw(texts))[0])
        ids, off = p.encode(*kernels.raw(texts))
        assert all(ids[off[i] : off[i + 1]].tolist() == [*p.bpe.encode_ordinary(t or ""), shards.END] for i, t in enumerate(texts.to_pylist()))
    assert p.count(*kernels.raw(pa.array([], pa.string()))) == 0
