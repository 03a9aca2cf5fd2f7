"""Cutting texts into pieces that a tokenizer encodes on their own, and remembering what the pieces encode to.

``BYTE_PIECES`` cuts as the byte-level pattern does where a run of known characters (ASCII, Latin-1 letters) ends before
an ASCII character, so that the piece is one pre-token for sure.  Anything else is cut at white space only, and is left
to the encoder of the piece.  ``WORD_PIECES`` does the same for the lower-casing word tokenizer, which drops white space and
composes characters before it cuts, so that a contraction may be none if a combining mark follows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

from forkline.llm.memory import kept

# White space of Unicode, letters of Latin-1, ASCII characters that are neither letter, digit nor space.
SPACE = r"\t-\r \x85\xa0  -     　"
LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
MARK = r"\x00-\x08\x0e-\x1f!-/:-@\[-`{-~\x7f"
PLAIN = r"(?![^\x00-\x7f])"

BYTE_PIECES = re.compile(
    rf"'(?:[stmd]|ll|ve|re)| ?[{LETTER}]++{PLAIN}| ?[0-9]++{PLAIN}| ?[{MARK}]++{PLAIN}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
SHORT = r"'(?:[stmdSTMD]|[lL][lL]|[vV][eE]|[rR][eE])"
WORD_PIECES = re.compile(rf"{SHORT}{PLAIN}|{SHORT}[^{SPACE}]*|[{LETTER}]++{PLAIN}|[0-9]++{PLAIN}|[{MARK}]++{PLAIN}|[^{SPACE}]+")

#: Bytes of pieces that a worker remembers, and what Python needs for one beside its text and ids; rarer ones are encoded again with each batch.
REMEMBERED, EACH = 64 << 20, 200
LETTERS = re.compile(f" ?[{LETTER}]+")
LATIN = re.compile(r"[\x00-\xff]*+")
JOINED = 64


class PieceCache:
    """What pieces encode to, as little-endian unsigned 32-bit ids."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]]) -> None:
        self.encode, self.known, self.held = encode, {}, 0

    def ids(self, documents: list[list[str]]) -> list[bytes]:
        """Ids of each document, given as its pieces."""
        flat = list(chain.from_iterable(documents))
        ids = list(map(self.known.get, flat))
        missing = [k for k, v in enumerate(ids) if v is None]
        if missing:
            new = list({flat[k] for k in missing})
            found = dict(zip(new, self.encode(new)))
            for k in missing:
                ids[k] = found[flat[k]]
            size = EACH * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
            if self.held + size <= REMEMBERED:
                self.known.update(found)
                self.held += size
        out, at = [], 0
        for n in map(len, documents):
            out.append(b"".join(ids[at : at + n]))
            at += n
        return out


class LibraryEncoder:
    """Texts to ids by a tokenizers file, with the pieces of most texts remembered; ``plain``: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: re.Pattern, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = pattern
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = PieceCache(self._encode)

        self.lowers = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("WORD ÀÉ", "word àé")]
        self.lowers = self.lowers[0] == self.lowers[1]
        self.separator = "\x01"
        self.border = self.tokenizer.encode("a\x01a", add_special_tokens=False).ids[1]
        joined = self.tokenizer.encode("a\x01 a\x01a", add_special_tokens=False).ids
        self.joins = joined.count(self.border) == 2 and self.tokenizer.encode("\x01", add_special_tokens=False).ids == [self.border]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Pieces of letters go ``JOINED`` to a call, a control character between them, which is one id and joins nothing."""
        out: list[bytes] = [b""] * len(pieces)
        plain: list[int] = []
        rest: list[int] = []
        for k, p in enumerate(pieces):
            (plain if self.joins and LETTERS.fullmatch(p) else rest).append(k)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            texts = [self.separator.join([pieces[k] for k in some[i : i + JOINED]]) for i in range(0, len(some), JOINED)]
            for i, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                ends = np.append(np.flatnonzero(ids == self.border), len(ids)).tolist()
                data, start = ids.tobytes(), 0
                for k, end in zip(some[i * JOINED : (i + 1) * JOINED], ends):
                    out[k] = data[4 * start : 4 * end]
                    start = end + 1
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([pieces[k] for k in some], add_special_tokens=False)):
                out[k] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def folded(self, text: str) -> str:
        """Where the tokenizer lower-cases, a text of Latin-1 alone may be lower-cased at once, and has fewer distinct pieces."""
        return text.lower() if self.lowers and LATIN.fullmatch(text) else text

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of little-endian unsigned 32-bit integers.  Texts that name a special token go whole."""
        odd = [k for k, text in enumerate(texts) if any(s in text for s in self.special)]
        whole = set(odd)
        rest = [[] if k in whole else self.pattern.findall(self.folded(t)) for k, t in enumerate(texts)]
        out = self.cache.ids(rest)
        for k, ids in zip(odd, self._encode([texts[k] for k in odd]) if odd else ()):
            out[k] = ids
        return out


_encoders: dict[tuple[str, re.Pattern, bool], LibraryEncoder] = {}
kept(_encoders)


def library_encoder(path: str, pattern: re.Pattern, plain: bool = False) -> LibraryEncoder:
    """The worker's encoder for a tokenizer file; tasks of other kinds give it back (see ``memory.tidy``)."""
    key = path, pattern, plain
    if key not in _encoders:
        _encoders[key] = LibraryEncoder(*key)
    return _encoders[key]
