"""Fill-in-middle: texts are cut between lines into prefix, middle and suffix and put out in another order.

Lines are found by a parallel automaton scan.  A chunk of a text does not know in which state the automaton enters it, so
it emits its transition function (the state it ends in, for each state it may begin in) and, for each of these, how many
lines begin in it.  Functions compose associatively: folding them over the chunks of a text resolves each chunk's entry
state and the number of lines before it, from which the line numbers of the cuts follow; the chunks that hold these lines
select the places.  Texts of up to ``chunk`` bytes are one chunk and never leave their task.  The chunks of longer ones are
rows of their own, of which only the functions meet; their outputs are rows of at most ``chunk`` bytes, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.llm.memory import tidy
from forkline.session import materialised, ship

CHUNK = 1 << 16
#: The marks that begin prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PREFIX, SUFFIX, MIDDLE = range(3)
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

#: States: at the start of a line; in a line; in a line after ``<``; after ``<`` and a letter of a mark; a mark was met, at the
#: start of a line; a mark was met, in a line.
START, INSIDE, OPEN, LETTER, MET_START, MET = range(6)
_HELD = {START: b"", INSIDE: b"", OPEN: b"<", LETTER: b"<P"}
_MARKS = tuple(m.encode() for m in MARKS)
_BEFORE_LAST = tuple(m[:2] for m in _MARKS)

Function = tuple[tuple[int, ...], tuple[int, ...]]
IDENTITY: Function = (tuple(range(6)), (0,) * 6)


def transition(data: bytes) -> Function:
    """States that ``data`` leads to, and lines that begin in it, for each state it may be entered in."""
    if not data:
        return IDENTITY
    ended = data.endswith(b"\n")
    met = any(m in data for m in _MARKS)
    later = data.count(b"\n") - ended
    to = []
    for state in range(6):
        held = _HELD.get(state)
        if held is None or met or any(m in held + data[:3] for m in _MARKS):
            to.append(MET_START if ended else MET)
            continue
        tail = (held + data)[-2:]
        to.append(START if ended else LETTER if tail in _BEFORE_LAST else OPEN if tail.endswith(b"<") else INSIDE)
    return tuple(to), tuple(later + (state in (START, MET_START)) for state in range(6))


def composed(first: Function, then: Function) -> Function:
    """The function of two stretches of text, one after the other."""
    return tuple(then[0][s] for s in first[0]), tuple(n + then[1][s] for s, n in zip(first[0], first[1]))


def place(data: bytes, state: int, before: int, line: int) -> int:
    """Where in ``data``, entered in ``state`` after ``before`` lines have begun, line number ``line`` begins; its ends stand for places outside."""
    k = line - before
    if k < 0:
        return 0
    at = 0
    if state not in (START, MET_START):
        k += 1
    while k:
        at = data.find(b"\n", at) + 1
        if not at:
            return len(data)
        k -= 1
    return at


def plan(key: str, lines: int, met: bool, seed: int, rate: int, spm: int) -> tuple[str, int, int]:
    """Form and the two cuts (numbers of lines before them) of a text by the hash of its key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not lines or met or h[2] % 100 >= rate:
        return "plain", 0, 0
    a, b = sorted((h[0] % (lines + 1), h[1] % (lines + 1)))
    return "spm" if h[3] % 100 < spm else "psm", a, b


def code_points(data: bytes) -> int:
    return len(data.decode())


def pieces_of(data: bytes, chunk: int) -> Iterator[bytes]:
    """Stretches of at most ``chunk`` bytes (four at least), none of which cuts a character."""
    at, chunk = 0, max(4, chunk)
    while at < len(data):
        end = min(len(data), at + chunk)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


WHOLE = "row long, doc_id long, n long, form string, prefix_chars long, middle_chars long, at long, output string"
CHUNKS = "row long, doc_id long, i long, data binary, to array<int>, begun array<long>"
ENTRIES = "row long, i long, state int, before long, n long, form string, a long, b long"
PARTS = "row long, doc_id long, n long, form string, part int, i long, chars long, output string"


def _arrow(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [pa.field(*(lambda n, k: (n, kinds[k]))(*f.split(" "))) for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _sent(schema: str, rows: Iterator[tuple], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``size`` bytes of strings."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if weight >= size:
            yield _arrow(schema, held)
            held, weight = [], 0
    if held:
        yield _arrow(schema, held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in batches:
        for k in range(part.num_rows):
            yield tuple(c[k].as_py() for c in part.columns)


def _key(doc_id: int | None) -> str:
    return "" if doc_id is None else str(doc_id)


def _numbered(batches: Iterator[pa.RecordBatch], long: bool) -> Iterator[tuple[int, int | None, bytes]]:
    """Rows by number of task and place in it; long texts have the upper half of a task's numbers."""
    first = (TaskContext.get().partitionId() << 40) + (long << 39)
    for k, (doc_id, text) in enumerate(_rows(batches)):
        yield first + k, doc_id, (text or "").encode()


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, doc_id, n, form, prefix_chars, middle_chars, at, output): the outputs of the texts, in one or more rows.

    ``row`` tells rows of ``docs`` apart; ``at`` is null where ``output`` is the whole output, else outputs of one row in the
    order of ``at`` make up the whole one.  A text of n lines (``[^\\n]*\\n|[^\\n]+``) is cut before two lines that the hash of
    ``seed`` and doc_id chooses.  ``form`` is plain (the text as it is) for empty texts, texts that hold a mark and all but
    ``rate`` percent of the others; spm for ``spm`` percent of the rest, psm for what remains.  prefix_chars and middle_chars
    count code points and are null where the form is plain.  Null texts count as empty ones, a null doc_id has the empty
    string as its decimal; rows are dealt with one by one, so that repeated ones give equal outputs.  An empty table gives an
    empty result; other columns are not read.
    """
    short, long = outputs(docs, seed, rate, spm, chunk, doc_id, text)
    return short.unionByName(long)


def outputs(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of fill_in_middle for texts of one chunk, and those for longer ones."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    long = F.octet_length("text") > chunk

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put_out() -> Iterator[tuple]:
            for row, doc, data in _numbered(batches, False):
                to, begun = transition(data)
                form, a, b = plan(_key(doc), begun[START], to[START] in (MET_START, MET), seed, rate, spm)
                if form == "plain":
                    yield row, doc, begun[START], form, None, None, None, data.decode()
                    continue
                a, b = place(data, START, 0, a), place(data, START, 0, b)
                parts = {PREFIX: data[:a].decode(), MIDDLE: data[a:b].decode(), SUFFIX: data[b:].decode()}
                yield row, doc, begun[START], form, len(parts[PREFIX]), len(parts[MIDDLE]), None, "".join(MARKS[p] + parts[p] for p in ORDERS[form])

        yield from _sent(WHOLE, put_out())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(CHUNKS, ((row, doc, i, data, *map(list, transition(data))) for row, doc, whole in _numbered(batches, True) for i, data in enumerate(pieces_of(whole, chunk))))

    def entered(table: pa.Table) -> pa.Table:
        """Of the functions of one text: each chunk's entry state and lines begun before it, the form and the cuts."""
        known = sorted(zip(*(table.column(c).to_pylist() for c in ("i", "to", "begun"))))
        so_far, entry = IDENTITY, []
        for i, to, begun in known:
            entry.append((i, so_far[0][START], so_far[1][START]))
            so_far = composed(so_far, (tuple(to), tuple(begun)))
        n = so_far[1][START]
        row, doc = table.column("row")[0].as_py(), table.column("doc_id")[0].as_py()
        form, a, b = plan(_key(doc), n, so_far[0][START] in (MET_START, MET), seed, rate, spm)
        return pa.Table.from_batches([_arrow(ENTRIES, [(row, i, state, before, n, form, a, b) for i, state, before in entry])])

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stretches() -> Iterator[tuple]:
            for row, doc, i, data, state, before, n, form, a, b in _rows(batches):
                if form == "plain":
                    yield row, doc, n, form, PREFIX, i + 1, 0, data.decode()
                    continue
                if i == 0:
                    for part, mark in enumerate(MARKS):
                        yield row, doc, n, form, part, 0, 0, mark
                a, b = place(data, state, before, a), place(data, state, before, b)
                for part, own in ((PREFIX, data[:a]), (MIDDLE, data[a:b]), (SUFFIX, data[b:])):
                    if own:
                        yield row, doc, n, form, part, i + 1, code_points(own), own.decode()

        yield from _sent(PARTS, stretches())

    chunks = materialised(rows.where(long).mapInArrow(tidy(cut), CHUNKS))
    entries = chunks.select("row", "doc_id", "i", "to", "begun").groupBy("row").applyInArrow(entered, ENTRIES)
    parts = materialised(chunks.select("row", "doc_id", "i", "data").join(entries, ["row", "i"]).select("row", "doc_id", "i", "data", "state", "before", "n", "form", "a", "b").mapInArrow(tidy(divided), PARTS))
    counted = parts.where("form <> 'plain'").groupBy("row").agg(F.sum(F.when(F.col("part") == PREFIX, F.col("chars")).otherwise(0)).alias("prefix_chars"), F.sum(F.when(F.col("part") == MIDDLE, F.col("chars")).otherwise(0)).alias("middle_chars"))
    ranks = lambda form: F.element_at(F.array(*[F.lit(ORDERS[form].index(p)) for p in range(3)]), F.col("part") + 1)
    rank = F.when(F.col("form") == "spm", ranks("spm")).otherwise(ranks("psm"))
    at = F.shiftleft(rank.cast("long"), 40) + F.col("i")
    ordered = parts.join(counted, "row", "left").select("row", "doc_id", "n", "form", "prefix_chars", "middle_chars", at.alias("at"), "output")
    return rows.where(F.coalesce(~long, F.lit(True))).mapInArrow(tidy(short), WHOLE), ordered


def _restored_text(output: Column, form: Column) -> Column:
    """The text of a whole output: what stands between the marks, in the order of the text."""
    inner = lambda first, then: F.substring_index(F.substring_index(output, first, -1), then, 1)
    psm = F.concat(inner("<P>", "<S>"), F.substring_index(output, "<M>", -1), inner("<S>", "<M>"))
    spm = F.concat(inner("<P>", "<M>"), F.substring_index(output, "<M>", -1), inner("<S>", "<P>"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restored(found: DataFrame) -> DataFrame:
    """The texts again, from outputs and forms alone: columns row, doc_id, form, at, text; ``at`` as in fill_in_middle."""
    whole = found.where("at is null").select("row", "doc_id", "form", "at", _restored_text(F.col("output"), F.col("form")).alias("text"))
    return whole.unionByName(_restored_rows(found.where("at is not null")))


def _restored_rows(rows: DataFrame) -> DataFrame:
    """In an output of several rows a mark is a row of its own, since a text that holds one is plain."""
    mark = lambda p: F.min(F.when(F.col("output") == MARKS[p], F.col("at"))).alias(f"from_{p}")
    begins = rows.where("form <> 'plain'").where(F.col("output").isin(*MARKS)).groupBy("row").agg(*[mark(p) for p in range(3)])
    after = lambda p: F.col("at") > F.col(f"from_{p}")
    first, second = (F.when(F.col("form") == "psm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    part = F.when(after(MIDDLE), MIDDLE).when(F.when(F.col("form") == "psm", after(SUFFIX)).otherwise(after(PREFIX)), second).otherwise(first)
    rank = F.when(F.col("form") == "plain", 0).when(part == PREFIX, 0).when(part == MIDDLE, 1).otherwise(2)
    parts = rows.join(begins, "row", "left").where((F.col("form") == "plain") | ~F.col("output").isin(*MARKS))
    return parts.select("row", "doc_id", "form", (F.shiftleft(rank.cast("long"), 44) + F.col("at")).alias("at"), F.col("output").alias("text"))


def digests(rows: DataFrame, column: str) -> DataFrame:
    """SHA-256 of each text that is spread over several rows (row, at, ``column``): columns row, sha256.  A task streams the rows of
    one text, in order, through the hash, and holds one batch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state = None, None
        for now, _, data in _rows(batches):
            if now != row:
                if state is not None:
                    yield _arrow("row long, sha256 string", [(row, state.hexdigest())])
                row, state = now, hashlib.sha256()
            state.update(data.encode())
        if state is not None:
            yield _arrow("row long, sha256 string", [(row, state.hexdigest())])

    ordered = rows.select("row", "at", column).repartition("row").sortWithinPartitions("row", "at")
    return ordered.mapInArrow(tidy(run), "row long, sha256 string")


def fill_in_middle_digests(short: DataFrame, rows: DataFrame) -> DataFrame:
    """Of what ``outputs`` gives, one row a document: doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of its output and of the text restored from it."""
    facts = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    whole = short.select(*facts, F.sha2("output", 256).alias("output_sha256"), F.sha2(_restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    once = rows.groupBy("row").agg(*[F.first(c).alias(c) for c in facts])
    hashed = once.join(digests(rows, "output").withColumnRenamed("sha256", "output_sha256"), "row").join(digests(_restored_rows(rows), "text").withColumnRenamed("sha256", "restored_sha256"), "row")
    return whole.unionByName(hashed.select(*facts, "output_sha256", "restored_sha256"))
