"""The operators' results by plain Python, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None) -> set:
    w = SPACE.findall((text or "").translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(rows: list[tuple]) -> set[tuple]:
    """(doc_id, n_shingles, component) of rows (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    component = list(range(len(sets)))

    def root(k):
        while component[k] != k:
            k = component[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                component[root(i)] = root(j)
    least = {}
    for k, (d, s) in enumerate(sets):
        if s and d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return {(d, len(s), least.get(root(k)) if s else d) for k, (d, s) in enumerate(sets)}


def substrings(rows: list[tuple], width: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text)."""
    first: dict[tuple, int] = {}
    words = [(d, SPACE.findall(t or "")) for d, t in rows]
    for d, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if d is not None and first[tuple(w[k : k + width])] < d:
                gone[k : k + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def judged(url: str | None, rules: list[tuple]) -> tuple:
    """(host, path, rule, verdict) of a url."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(FOLD)
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def nearest(rows: list[tuple], k: int = 5) -> set[tuple]:
    clean = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i in {i for i, _ in clean if i % 50 == 0}:
        q = min((v for j, v in clean if j == i), key=lambda v: v.tolist())
        found = sorted((-int(v @ q), j) for j, v in clean if j != i and len(v) == len(q))[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(found, 1)}
    return out


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % 576 if data else 576)


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def trie(rows):
    """Nodes of the prefix trie of conversations (conv_id, turn, role, text), by the definition; distinct turns in a conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, len(whole)))
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = ",".join(str(c) for c, n in sorted(who) if n == len(node))
        parent = min(members[node[:-1]])[0] if node else None
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(who)[0], len(node), parent, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def filled(doc_id, text, seed=7, rate=100, spm=50):
    """doc_id, n, form, prefix_chars, middle_chars, output of one document."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm_form = h[3] % 100 < spm
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm_form else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if spm_form else "psm", len(prefix), len(middle), output


def mix(rows, weights=(1, 2, 3), most=3):
    """What each document (doc_id, text, source) gives: doc_id, size, source_size, target, taken; rows of equal (doc_id, text) in any order."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in order}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, at_limit = {}, set()
    while True:
        rest = [s for s in order if s not in at_limit]
        if not rest:
            break
        level = (sum(sizes.values()) - most * sum(sizes[s] for s in at_limit)) / float(sum(weight[s] for s in rest))
        target = {s: min(most * float(sizes[s]), weight[s] * level) for s in order}
        more = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not more:
            break
        at_limit |= more
    out = []
    for s in order:
        whole = min(most, int(target[s] // sizes[s])) if sizes[s] else 0
        budget = target[s] - whole * sizes[s] if whole < most else 0
        own = sorted((hashlib.sha256(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], k) for k, (d, t, x) in enumerate(rows) if x == s)
        taken, full = {}, budget <= 0
        for _, k in own:
            n = size(rows[k][1])
            fits = not full and (n <= budget or n - budget <= budget)
            full = full or n > budget
            taken[k] = whole + fits
            budget -= n
        out += [(rows[k][0], size(rows[k][1]), sizes[s], target[s], taken[k] * size(rows[k][1])) for k in taken]
    return out
