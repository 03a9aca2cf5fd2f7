"""Documents with what real ones hold: nulls, blanks, repeated rows, near copies, very long texts, clashing columns."""

from __future__ import annotations

import random

import pytest

CLASHING = ("n_words", "bucket", "payload", "kind", "ids", "score", "kept_text", "carried", "n_shingles", "component_id", "cid", "label", "x", "start", "none")


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(("th", "er", "on", "an", "re", "in", "ou")) for _ in range(r.randrange(1, 4))).capitalize() if r.random() < 0.1 else "".join(r.choice("etaoinshr") for _ in range(r.randrange(1, 8))) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    passage, other, long = prose(1, 70), prose(2, 120), prose(3, 9000)
    near = list(other)
    near[60] = "changed"
    apart = list(other)
    for k in range(0, 120, 6):
        apart[k] = f"w{k}"
    return [
        (1, ""), (2, None), (3, " \t\n \r"), (4, "four words are here"), (4, "four words are here"), (5, " ".join(other)), (6, " ".join(near)), (7, "  ".join(other).upper()), (8, " ".join(apart)),
        (9, " ".join(prose(4, 30) + passage + prose(5, 20))), (10, "\n".join(passage + prose(6, 40))), (11, " ".join(passage + passage)), (None, " ".join(other)), (None, None), (12, " ".join(long)),
        (13, " ".join(long[:8990] + prose(7, 10))), (14, "a <|endoftext|> b's DON'T 漢字かな é 😀 ́x ½ ²\u2003\x85 !!??"), (15, "x" * 70_000), (16, "one two three four five"), (17, "ONE two three four five"),
        (100, "repeat " * 300), (-5, " ".join(passage)), (2**40, " ".join(near)),
    ]


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = [(d, t, "en", f"src{k % 3}", None if t is None else len(t), *([k] * len(CLASHING))) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
