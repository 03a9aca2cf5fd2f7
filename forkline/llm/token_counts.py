"""Edit-aware token counts: a segment tree over each document's pre-tokens, re-encoded only where edits touch it.

A leaf is a run of ``LEAF`` pre-tokens; nodes hold characters and tokens below them.  An edit replaces some characters.
Descending by characters finds the leaf of the second character before it: a cut depends on the two characters behind it
at most (white space before a word, ``'l`` that may be ``'ll``), so the leaf's start stays a cut whatever the edit does.  From there the new text is cut again
until, behind the edit, a cut falls on an old leaf border; leaves between are encoded anew and put in their place, and
the sums above them are updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.llm.bpe import text_slices
from forkline.llm.memory import tidy
from forkline.llm.pieces import BYTE_PIECES, library_encoder
from forkline.session import ship

LEAF = 64


class SegmentTree:
    """Sums of characters and tokens over leaves; node 1 is the root, leaves start at ``base``."""

    def __init__(self, leaves: np.ndarray) -> None:
        self.build(leaves)

    def build(self, leaves: np.ndarray) -> None:
        self.count = len(leaves)
        self.base = 1 << max(0, (self.count - 1).bit_length())
        self.sums = np.zeros((2 * self.base, 2), dtype=np.int64)
        self.sums[self.base : self.base + self.count] = leaves
        low = self.base
        while low > 1:
            level = self.sums[low : 2 * low]
            low //= 2
            self.sums[low : 2 * low] = level[::2] + level[1::2]

    def find(self, character: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before the leaf."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if character - before >= self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.base, before

    def replace(self, first: int, last: int, leaves: np.ndarray) -> None:
        """Put ``leaves`` in the place of leaves first to last (not included)."""
        if len(leaves) != last - first:
            own = self.sums[self.base : self.base + self.count]
            self.build(np.concatenate((own[:first], leaves, own[last:])))
            return
        self.sums[self.base + first : self.base + last] = leaves
        low, high = (self.base + first) // 2, (self.base + last - 1) // 2
        while low:
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2 : 2] + self.sums[2 * low + 1 : 2 * high + 2 : 2]
            low, high = low // 2, high // 2


class Counter:
    """Counts of pieces, remembered; the strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        self.cache = library_encoder(path, BYTE_PIECES, plain=True).cache

    def leaves(self, groups: list[list[str]]) -> np.ndarray:
        """Characters and tokens of each group of pieces."""
        encoded = self.cache.ids(groups)
        return np.array([(sum(map(len, g)), len(e) // 4) for g, e in zip(groups, encoded)], dtype=np.int64).reshape(-1, 2)


def grouped(pieces: list[str]) -> list[list[str]]:
    return [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)]


class Document:
    """A text with its tree."""

    def __init__(self, text: str, counter: Counter, leaves: np.ndarray | None = None) -> None:
        self.text, self.counter, self.encoded = text, counter, 0
        self.tree = SegmentTree(counter.leaves(grouped(BYTE_PIECES.findall(text))) if leaves is None else leaves)

    @property
    def tokens(self) -> int:
        return int(self.tree.sums[1, 1])

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` by ``inserted``; what is beyond the text is cut off."""
        at = min(max(at, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - at)
        first, start = self.tree.find(max(at - 2, 0)) if self.tree.count else (0, 0)
        self.text = self.text[:at] + inserted + self.text[at + removed :]
        shift, behind = len(inserted) - removed, at + len(inserted)
        sizes = self.tree.sums[self.tree.base : self.tree.base + self.tree.count, 0]
        last = first
        border = start + shift  # where old leaf ``last`` starts, in the new text
        pieces, spot = [], start
        for match in BYTE_PIECES.finditer(self.text, start):
            while last < self.tree.count and (border < spot or border < behind):
                border += int(sizes[last])
                last += 1
            if border == spot >= behind and last > first:
                break
            pieces.append(match.group())
            spot = match.end()
        else:
            last = self.tree.count
        groups = grouped(pieces)
        self.encoded += len(groups)
        self.tree.replace(first, last, self.counter.leaves(groups))


EDITS = "array<struct<at:long,removed:long,inserted:string>>"


def token_counts(docs: DataFrame, path: str, edits: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, n_leaves, edited_tokens, encoded_leaves, edited_text.

    ``edits`` is a column of type ``EDITS``: replacements in order, each in characters of the text as the ones before left
    it; positions beyond the text count as its end, null members as 0 or empty, and a null list as none.  Without edits
    the edited columns repeat the text and its count.  Null texts are empty and have no tokens; strings of special tokens
    are ordinary text.  doc_id may be null or repeated; an empty table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    edits = F.lit(None).cast(EDITS) if edits is None else edits.cast(EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for part in batches:
            at = 0
            for texts in text_slices(part.column(1)):
                cut = [grouped(BYTE_PIECES.findall(t)) for t in texts]
                flat = count.leaves([g for groups in cut for g in groups])
                rows, leaf = [], 0
                for text, groups, changes in zip(texts, cut, part.column(2).slice(at, len(texts)).to_pylist()):
                    document = Document(text, count, flat[leaf : leaf + len(groups)])
                    leaf += len(groups)
                    before = document.tokens
                    for change in changes or ():
                        if change is not None:
                            document.edit(change["at"] or 0, change["removed"] or 0, change["inserted"] or "")
                    rows.append((before, len(groups), document.tokens, document.encoded, document.text))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(texts)), *[pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)]], names=["doc_id", "n_tokens", "n_leaves", "edited_tokens", "encoded_leaves", "edited_text"])
                at += len(texts)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), edits.alias("edits"))
    return source.mapInArrow(tidy(run, caches=True), "doc_id long, n_tokens long, n_leaves long, edited_tokens long, encoded_leaves long, edited_text string")
