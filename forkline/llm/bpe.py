"""Byte-level BPE by speculation: propose by greedy longest match, verify adjacent pairs, merge exactly where they fail.

A token sequence is what BPE gives if and only if each adjacent pair is what BPE gives for the pair's own bytes: merges
on either side of a border proceed as if alone until a merge crosses it, and the first crossing merge joins the last
part of the left token with the first part of the right one at that time.  The check walks both tokens back through
their merges, latest first, and looks up whether a merge of the two parts that stood at the border at one time would
have come before each of them was merged on.  All pairs of a batch are walked at once in numpy.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.llm.hashing import string_buffers
from forkline.llm.pieces import BYTE_PIECES, LETTERS, PieceCache
from forkline.llm.memory import kept, tidy
from forkline.session import ship

FAR = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself if printable in Latin-1, else from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    names = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Bpe:
    """A vocabulary with merges.  Tokens are numbered by the order in which merging makes them: bytes, then merges by rank."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocab = content["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in content["model"]["merges"]]
        characters = byte_characters()
        to_byte = {c: b for b, c in enumerate(characters)}
        names = characters + [a + b for a, b in merges]
        if len(set(names)) != len(names):
            raise ValueError("two merges make one token")
        number = {name: k for k, name in enumerate(names)}
        self.ids = np.array([vocab[name] for name in names], dtype=np.uint32)
        self.bytes_of = [bytes(to_byte[c] for c in name) for name in names]
        self.number = {b: k for k, b in enumerate(self.bytes_of)}
        self.left = np.array([-1] * 256 + [number[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([-1] * 256 + [number[b] for _, b in merges], dtype=np.int64)
        self.made = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(self.left, self.right)) if k > 255}
        keys = self.left[256:] * len(names) + self.right[256:]
        order = np.argsort(keys)
        self.keys, self.results = keys[order], order + 256
        self.longest: dict[bytes, int] = {}
        for b in self.bytes_of:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", ())}
        self.by_id = {int(i): b for i, b in zip(self.ids, self.bytes_of)} | {i: name.encode() for name, i in self.special.items()}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pretokens = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.cache = PieceCache(self._encode_pieces)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        at, out, number, longest = 0, [], self.number, self.longest
        while at < len(word):
            for width in range(min(longest.get(word[at : at + 2], 1), len(word) - at), 0, -1):
                if (token := number.get(word[at : at + width])) is not None:
                    break
            out.append(token)
            at += width
        return out

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of the token that merging makes of a and b; FAR if there is none."""
        keys = a * len(self.ids) + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.results[at], FAR)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the bytes of a and b is a, b; for arrays of tokens."""
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        a_next, b_next = np.full(len(a), FAR), np.full(len(a), FAR)  # the merges that end the two parts
        while len(at):
            crossing = self.merge_of(a, b)
            bad = (crossing < a_next) & (crossing <= b_next)  # of equal merges the left one comes first
            good[at[bad]] = False
            go = ~bad & ((a > 255) | (b > 255))
            at, a, b, a_next, b_next = at[go], a[go], b[go], a_next[go], b_next[go]
            later = a > b  # made later than b; of equal ones the right one
            a_next, b_next = np.where(later, a, a_next), np.where(later, b_next, b)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the earliest merge, of equal ones the leftmost, over a linked list of parts."""
        parts: list[int] = [self.number[word[k : k + 1]] for k in range(len(word))]
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(m, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (m := self.made.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, k, x, y = heapq.heappop(heap)
            n = after[k]
            if parts[k] != x or n < 0 or parts[n] != y:
                continue
            parts[k], parts[n] = m, -1
            after[k] = after[n]
            if after[k] >= 0:
                before[after[k]] = k
                if (z := self.made.get((m, parts[after[k]]))) is not None:
                    heapq.heappush(heap, (z, k, m, parts[after[k]]))
            if before[k] >= 0 and (z := self.made.get((parts[before[k]], m))) is not None:
                heapq.heappush(heap, (z, before[k], parts[before[k]], m))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Speculate and verify, for many words at once."""
        proposed = [self.propose(w) for w in words]
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64)
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(proposed))
        owner = np.repeat(np.arange(len(proposed)), sizes)
        pairs = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        keys, back = np.unique(flat[pairs] * len(self.ids) + flat[pairs + 1], return_inverse=True) if len(pairs) else (pairs, pairs)
        good = self.compatible(keys // len(self.ids), keys % len(self.ids))[back] if len(pairs) else np.zeros(0, bool)
        for k in np.unique(owner[pairs[~good]]).tolist():
            proposed[k] = self.merge(words[k])
        return proposed

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces to ids; those with characters beyond the fast pattern are cut first, as the file says: by its Unicode tables."""
        words: list[str] = []
        counts: list[int] = []
        for piece in pieces:
            cut = [piece] if piece.isascii() or LETTERS.fullmatch(piece) else [piece[a:b] for _, (a, b) in self.pretokens(piece)]
            words += cut
            counts.append(len(cut))
        encoded = self.encode_words([w.encode() for w in words])
        ids, at, out = self.ids, 0, []
        for n in counts:
            out.append(ids[[t for e in encoded[at : at + n] for t in e]].astype("<u4").tobytes())
            at += n
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.special or not any(s in t for t in texts for s in self.special):
            return self.cache.ids([BYTE_PIECES.findall(t) for t in texts])
        segments = [self.split.split(t) for t in texts]
        plain = iter(self.cache.ids([BYTE_PIECES.findall(s) for parts in segments for s in parts[::2]]))
        out = []
        for parts in segments:
            out.append(b"".join(next(plain) if k % 2 == 0 else np.array([self.special[s]], dtype="<u4").tobytes() for k, s in enumerate(parts)))
        return out

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD, ids beyond the vocabulary are left out."""
        values = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
        get = self.by_id.get
        return b"".join([get(i, b"") for i in values.tolist()]).decode("utf-8", errors="replace")


_loaded: dict[str, Bpe] = {}
kept(_loaded)


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def text_slices(column: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """Texts of a column in lists of about ``size`` bytes; null is empty."""
    _, offsets = string_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end


def id_lists(encoded: list[bytes]) -> pa.Array:
    """Ids (bytes of 32-bit integers) of documents as an Arrow list<int> column, without a Python object for each."""
    offsets = np.concatenate(([0], np.cumsum([len(e) // 4 for e in encoded]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


def bpe_encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row a document: doc_id, ids (array<int>), and with ``decoded`` the text that decoding these ids gives.

    Ids are those of the file's byte-level BPE without special tokens added; the strings of its special tokens in a text
    are these tokens.  Null and empty texts have no ids and decode to the empty text.  doc_id may be null or repeated;
    other columns are not read.  No shuffle: texts are encoded where they are read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in batches:
            at = 0
            for texts in text_slices(part.column(1)):
                encoded = bpe.encode(texts)
                columns = [part.column(0).slice(at, len(texts)), id_lists(encoded)]
                if decoded:
                    columns.append(pa.array([bpe.decode(e) for e in encoded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
                at += len(texts)

    schema = "doc_id long, ids array<int>" + (", decoded string" if decoded else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run, caches=True), schema)


def bpe_decode(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row a document: doc_id, decoded (text of an array<int> of ids; null and empty give the empty text)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in batches:
            texts = [bpe.decode(np.array(x or (), dtype=np.int64)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(tidy(run, caches=True), "doc_id long, decoded string")
