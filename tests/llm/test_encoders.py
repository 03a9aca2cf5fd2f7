"""The encoders against the tokenizers library on random texts: combining marks, contractions, new letters, odd spaces."""

from __future__ import annotations

import random

import numpy as np
import pytest

from forkline.llm.bpe import Bpe
from forkline.llm.id_store import id_store
from forkline.llm.pieces import BYTE_PIECES, WORD_PIECES, LibraryEncoder
from forkline.llm.queries import BYTE_BPE, WORD_BPE, tokenizer

PARTS = ["'s", "'t", "'re", "'VE", "'ll", "'m", "'d", "'", "́", "̀", "̧", "e", "a", "E", "r", " ", "  ", "\n", "1", "22", "!", "漢", "字", "é", "ñ", "‍", "😀", "K", "ſ", "İ", "ß", "ŉ", " ", "Ṭ8"]
#: Planes where newer versions of Unicode have added letters, and common ones.
RANGES = [(32, 0x3000), (0x10000, 0x20000), (0x1E600, 0x1E700), (0x11D00, 0x11E00), (0x18F00, 0x19000), (0x1DF00, 0x1E000)]


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    one = lambda: r.choice(PARTS) if r.random() < 0.7 else chr(r.randrange(*r.choice(RANGES)))
    return ["".join(one() for _ in range(r.randrange(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("name, own", [(BYTE_BPE, lambda p: Bpe(p).encode), (BYTE_BPE, lambda p: LibraryEncoder(p, BYTE_PIECES).ids), (WORD_BPE, lambda p: LibraryEncoder(p, WORD_PIECES).ids)])
def test_ids_are_the_librarys(name, own):
    from tokenizers import Tokenizer

    given, encode, library = texts(11, 200_000), own(tokenizer(name)), Tokenizer.from_file(tokenizer(name))
    for k in range(0, len(given), 4000):
        part = given[k : k + 4000]
        wanted = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch_fast(part, add_special_tokens=False)]
        assert [t for t, a, b in zip(part, encode(part), wanted) if a != b] == []


def test_stored_ids_of_composed_and_decomposed_texts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(WORD_BPE))
    given = ["l'régime", "l'régime", "qu'ilş s'éte", "'llŉ x", "don't 'ḿ"]
    rows = id_store(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), tokenizer(WORD_BPE)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(given)}
