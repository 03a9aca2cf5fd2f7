"""Edits just behind a border of two leaves."""

from __future__ import annotations

import pytest

from forkline.llm import token_counts
from forkline.llm.queries import BYTE_BPE, tokenizer


@pytest.mark.parametrize("tail, removed, inserted", [("  b c", 1, ""), ("  b c", 1, "  "), ("'l", 0, "l"), ("'v", 0, "e"), ("'r", 0, "e")])
def test_cut_before_a_leaf_moves(tail, removed, inserted):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(BYTE_BPE))
    t.encode_special_tokens = True
    text = "x" + " x" * (token_counts.LEAF - 2) + tail
    border = len(text) - len(tail) + 1
    d = token_counts.Document(text, token_counts.Counter(tokenizer(BYTE_BPE)))
    assert d.tree.find(border) == (1, border)
    d.edit(border + 1, removed, inserted)
    assert d.text == text[: border + 1] + inserted + text[border + 1 + removed :]
    assert d.tokens == len(t.encode(d.text).ids)
