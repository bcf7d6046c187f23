"""Ids by units are the library's ids of whole texts, whatever stands around spaces, marks and line ends."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import token_ids

PATH = token_ids.public_tokenizers.path(token_ids.TOKENIZER)
PARTS = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "a", "b'", "'s", "'ll", "word", "Zoë", "日本", "。", " ", "　", " ", " ", "\x85", "\x1c", "\x0b", "12", "3.5", "!", "<|endoftext|>", "ß", "×", "ü,", "👍", "\x00"]


def test_units_give_the_ids_of_whole_texts(monkeypatch):
    r = random.Random(3)
    texts = [None, ""] + ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(4000)]
    want = [[*x.ids, token_ids.END] for x in token_ids.tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    for piece, known in ((1 << 20, 1 << 20), (64, 300)):
        monkeypatch.setattr(token_ids, "PIECE", piece)
        monkeypatch.setattr(token_ids, "KNOWN", known)
        token_ids.kept_encoder.cache_clear()
        got = [np.frombuffer(x, "<u2").tolist() for b in token_ids.encoded(PATH, iter([rows])) for x in b.column(1).to_pylist()]
        assert got == want
    token_ids.kept_encoder.cache_clear()
