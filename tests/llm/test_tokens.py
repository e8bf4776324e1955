"""Encoding many texts at once."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import packing, rans, tokens


class Counting:
    """A tokenizer that counts its calls."""

    def __init__(self, real):
        self.real, self.calls = real, 0

    def encode_batch_fast(self, *args, **options):
        self.calls += 1
        return self.real.encode_batch_fast(*args, **options)


@pytest.fixture
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "eau", "ß", "é", "ing", "Qu", "'s", "7", ".", "ó"]) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(200)]


def own_ids(own, texts):
    raw = [t.encode() for t in texts]
    return [x.tolist() for x in own.texts(b"".join(raw), np.cumsum([0, *map(len, raw)]))]


def test_words_of_many_texts_go_to_the_library_in_one_call(texts):
    own = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    own.merges = Counting(own.merges)
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    assert own_ids(own, texts) == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.merges.calls == 1


@pytest.mark.parametrize("cache", [1, 20_000, 1 << 27])
def test_odd_words_among_plain_ones_and_small_caches_change_nothing(texts, cache, monkeypatch):
    monkeypatch.setattr(tokens, "TEXT_BYTES", 3000)
    own = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    own.cache_bytes = cache
    odd = ["", "中文 text x éa İI", "<|endoftext|> a<|startoftext|>b", " \u0085\x1c\x00 ", "don''t're"]
    mixed = [t for pair in zip(texts, odd * 40) for t in pair]
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    for _ in range(3):
        assert own_ids(own, mixed) == [x.ids for x in whole.encode_batch(mixed, add_special_tokens=False)]


def test_only_the_query_keeps_many_words():
    assert packing.encoder(tokens.VOCABULARY, packing.LARGE_CACHE).cache_bytes == 1 << 27
    assert packing.encoder(tokens.VOCABULARY).cache_bytes == tokens.CACHE_BYTES == 32 << 20  # as in the pipeline


@pytest.mark.parametrize("sizes", [[4096 * 9 + 5], [rans.BLOCK_IDS, rans.BLOCK_IDS, 77], [1], [64], [rans.BLOCK_IDS, 65]])
def test_blocks_that_end_earlier_keep_their_states_to_the_end(sizes):
    rng = np.random.default_rng(3)
    cuts = [rng.zipf(1.3, n).clip(1, 40_000).astype(np.uint16) for n in sizes]
    counts = np.bincount(np.concatenate(cuts), minlength=1 << 16)
    coder = rans.Coder(rans.shares(np.flatnonzero(counts), counts[counts > 0]))
    steps = -(-max(sizes) // rans.LANES)
    grid = np.full((len(cuts), steps * rans.LANES), -1, np.int32)
    for row, ids in zip(grid, cuts):
        row[: len(ids)] = ids
    coded = coder.encode(grid.reshape(len(cuts), steps, rans.LANES), len(cuts), steps)
    alone = [coder.encode(g[: -(-n // rans.LANES) * rans.LANES].reshape(1, -1, rans.LANES), 1, -(-n // rans.LANES))[0] for g, n in zip(grid, sizes)]
    assert [x[0] for x in coded] == [x[0] for x in alone]
    assert all(np.array_equal(a, b) for a, b in zip(coder.decode([(n, *x) for n, x in zip(sizes, coded)]), cuts))
