"""The encoder gives the library's ids for every text."""

import random

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from quarry.llm import tokens  # noqa: E402

MARKS = [*"aZéßŉṩ.,;:!?'s\n\t\x0b 9%&", "İ", "ı", "Å", "क़", "́", "क़", "ṩ", " ", " ", "ﬁ", "Ǆ", "Ω", "ς", "Ж", " the", " and", ". ", "'t", "<|endoftext|>", "\x02"]


@pytest.mark.parametrize(("name", "keep_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("pieces", [40, 10_000])
def test_ids_equal_the_library(name, keep_space, pieces):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = ["".join(rng.choices(MARKS, k=rng.randint(0, 40))) for _ in range(6000)]
    texts += ["abİ. x", "क़. a", "", " ", "\n\n", "a" * 20_000, "word " * 5000, "\n".join(["a line."] * 900), "ünï " * 300]
    tok, enc = Tokenizer.from_file(public.path(name)), tokens.Encoder(public.path(name), keep_space, pieces)
    got = enc.encode(texts[:3000]) + enc.encode(texts[3000:])
    want = [np.array(e.ids, enc.dtype).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == want
    assert enc.encode([None, "a", float("nan")]) == [b"", enc.encode(["a"])[0], b""]
