"""What an encoder does for units that it knows, or has no room for, and the bits of packed ids."""

import random
import time

import numpy as np
import pyarrow as pa

from tessera.llm import token_ids

PATH = token_ids.public_tokenizers.path(token_ids.TOKENIZER)


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(" " + "".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n))


def ids(encoder, text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return encoder.ids(data, np.array([0, len(data)]))[0].tolist()


def want(text: str) -> list[int]:
    return [*token_ids.tokenizer(PATH).encode(text, add_special_tokens=False).ids, token_ids.END]


def test_units_without_room_are_encoded_without_a_copy_of_all_known_ids(monkeypatch):
    monkeypatch.setattr(token_ids, "KNOWN", 2000)
    encoder, text = token_ids.Encoder(PATH), words(2000, 1)
    assert ids(encoder, text) == want(text)
    assert ids(encoder, words(50, 2)) == want(words(50, 2))
    held, known = encoder.flat, dict(encoder.known)
    for seed in range(3, 8):
        assert ids(encoder, words(50, seed)) == want(words(50, seed))
        assert encoder.flat is held and encoder.known == known
    assert ids(encoder, text) == want(text)


def test_room_that_a_call_has_taken_is_given_back(monkeypatch):
    monkeypatch.setattr(token_ids, "KNOWN", 20)
    monkeypatch.setattr(token_ids, "PIECE", 64)
    encoder = token_ids.Encoder(PATH)
    for n, seed in ((10, 1), (3000, 2), (10, 1), (3000, 3)):
        assert ids(encoder, words(n, seed)) == want(words(n, seed))
        assert len(encoder.flat) <= 256 and len(encoder.first) <= 256


def test_known_units_take_less_time_than_arrow_scalars_of_them():
    """Cutting, finding and putting together all of them takes less than to_pylist alone."""
    encoder, text = token_ids.Encoder(PATH), words(60_000, 1)
    data = np.frombuffer(text.encode(), np.uint8)
    units = pa.array([f" {x}".encode() for x in text.split()], pa.large_binary())

    def least(call) -> float:
        taken = []
        for _ in range(7):
            start = time.process_time()
            call()
            taken.append(time.process_time() - start)
        return min(taken)

    assert ids(encoder, text) == want(text)
    assert least(lambda: encoder.ids(data, np.array([0, len(data)]))) < least(units.to_pylist)


def test_packed_bits_are_the_codes_in_a_row():
    r = np.random.default_rng(5)
    for n, most in ((1, 1), (31, 2), (33, 3), (700, 40), (5000, 3000)):
        some = (r.integers(0, most, n) * r.random(n)).astype("<u2")
        lengths = token_ids.code_lengths(np.bincount(some))
        codes = token_ids.canonical(lengths)
        text = "".join(f"{codes[i]:0{lengths[i]}b}" for i in some)
        bits, checkpoints = token_ids.packed(some, lengths, codes)
        assert "".join(f"{x:08b}" for x in bits) == text.ljust(8 * len(bits), "0") and len(bits) == len(text) // 8 + 9
        assert checkpoints.tolist() == [sum(lengths[some[:k]].tolist()) for k in range(0, n, token_ids.BLOCK)]
        assert (token_ids.unpacked(bits, checkpoints, n, token_ids.table(lengths, codes)) == some).all()
