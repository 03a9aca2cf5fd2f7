"""Token-ID output: a content-addressed store of chunks, recipes of documents and Merkle manifests.

Writing.  Map tasks tokenize documents and cut each id stream where a rolling hash of the last ``WINDOW`` ids says so, so
that equal passages give equal chunks wherever they stand.  A task writes each chunk it meets once to a staging pack and
returns its address; one address is chosen for each digest, and chunks are copied from there to the packs of the store,
so that the store holds each chunk once, whoever met it.  Recipes (document, digests and sizes of its chunks) are written
in ascending doc_id order, a file for each range of ids; each file has a Merkle root over its documents, the manifest a
root over its files and the running count of ids.

Reading.  Tasks parse recipe files and verify their roots; chunks are fetched by range reads and verified by digest.

Recipe file: ``FKR1``, then for each document: flag and doc_id (``<Bq``; flag 1: null), number of ids and of chunks
(``<QI``), then digest (16 bytes) and number of ids (``<I``) of each chunk.  Pack: ``FKP1``, then chunks, each the bytes of an id and
of all of them (``<BI``), then Zstandard of the ids as little-endian integers of 16 bits if all fit, else of 32.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forkline.llm.bpe import text_slices
from forkline.llm.files import NewFile, Readers, delete, located
from forkline.llm.hashing import mix, rolled
from forkline.llm.memory import tidy
from forkline.llm.pieces import WORD_PIECES, library_encoder
from forkline.session import materialised, new_folder, partitions, ship

END = np.array([1], dtype="<u4").tobytes()
WINDOW, LEAST, MEAN, MOST = 16, 512, 2048, 16384
ZSTD = pa.Codec("zstd", compression_level=1)
PACK = 128 << 20
RECIPES, PACKS = b"FKR1", b"FKP1"


def cuts(streams: list[bytes], least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each id stream (32-bit ids); ``mean`` is a power of two.

    The rolling hash runs over all streams laid end to end; marks whose window begins before the stream are left out.
    """
    sizes = np.array([len(s) // 4 for s in streams])
    ends = np.cumsum(sizes)
    ids = np.frombuffer(b"".join(streams), dtype="<u4")
    hashes = rolled(mix(ids.astype(np.uint64)), WINDOW)
    marks = np.flatnonzero(hashes >> np.uint64(64 - mean.bit_length() + 1) == 0) + WINDOW
    spans = np.searchsorted(marks, ends - sizes + WINDOW), np.searchsorted(marks, ends)
    out = []
    for n, start, lo, hi in zip(sizes.tolist(), (ends - sizes).tolist(), spans[0].tolist(), spans[1].tolist()):
        own, at = [], 0
        for mark in (marks[lo:hi] - start).tolist() if n > least else ():
            while mark - at > most:
                at += most
                own.append(at)
            if mark - at >= least and mark < n:
                at = mark
                own.append(at)
        while n - at > most:
            at += most
            own.append(at)
        out.append([*own, n])
    return out


def squeezed(ids: bytes) -> bytes:
    values = np.frombuffer(ids, dtype="<u4")
    small = values.astype("<u2") if values.max(initial=0) < 1 << 16 else values
    return struct.pack("<BI", small.itemsize, small.nbytes) + ZSTD.compress(small.tobytes(), asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    width, size = struct.unpack_from("<BI", data)
    return np.frombuffer(ZSTD.decompress(data[5:], size, asbytes=True), dtype=f"<u{width}").astype("<u4").tobytes()


def digest_of(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


MET = "doc_id long, n_tokens long, chunks array<struct<digest:binary,size:int>>, new array<struct<digest:binary,pack:string,offset:long,length:int>>"
_CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32())]))
_NEW = pa.list_(pa.struct([("digest", pa.binary()), ("pack", pa.string()), ("offset", pa.int64()), ("length", pa.int32())]))


def _chunked(path: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path, WORD_PIECES)
        file, met = None, set()
        for part in batches:
            at = 0
            for texts in text_slices(part.column(1)):
                sizes, recipes, fresh = [], [], []
                streams = [ids + END for ids in encoder.ids(texts)]
                for ids, ends in zip(streams, cuts(streams)):
                    start, chunks, new = 0, [], []
                    for end in ends:
                        chunk = ids[4 * start : 4 * end]
                        digest = digest_of(chunk)
                        chunks.append({"digest": digest, "size": end - start})
                        if digest not in met:
                            if file is None:
                                file = NewFile(f"{folder}/staging", ".pack")
                            met.add(digest)
                            data = squeezed(chunk)
                            new.append({"digest": digest, "pack": file.uri, "offset": file.write(data), "length": len(data)})
                        start = end
                    sizes.append(len(ids) // 4)
                    recipes.append(chunks)
                    fresh.append(new)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(recipes, _CHUNKS), pa.array(fresh, _NEW)], names=["doc_id", "n_tokens", "chunks", "new"])
                at += len(texts)
                if file is not None and file.size >= PACK:
                    file.close()
                    file, met = None, set()
        if file is not None:
            file.close()

    return run


def _copied(folder: str):
    """Rows (digest, pack, offset, length) in order of place: copy to new packs of the store, return the new places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers, file = Readers(4), None
        for part in batches:
            packs, offsets = [], []
            for pack, offset, length in zip(*(part.column(n).to_pylist() for n in ("pack", "offset", "length"))):
                if file is None or file.size >= PACK:
                    if file is not None:
                        file.close()
                    file = NewFile(f"{folder}/packs", ".pack")
                    file.write(PACKS)
                packs.append(file.uri)
                offsets.append(file.write(readers.read(pack, offset, length)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packs, pa.string()), pa.array(offsets, pa.int64()), part.column(3)], names=["digest", "pack", "offset", "length"])
        if file is not None:
            file.close()
        readers.close()

    return run


def _record(doc_id: int | None, n: int, chunks: list[dict]) -> bytes:
    return struct.pack("<BqQI", doc_id is None, doc_id or 0, n, len(chunks)) + b"".join(c["digest"] + struct.pack("<I", c["size"]) for c in chunks)


MANIFEST = "file string, first long, documents long, n_tokens long, root binary"


def _recipes(folder: str):
    """Sorted rows (doc_id, n_tokens, chunks) of a task: one recipe file and its line of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, first, leaves, total = None, None, [], 0
        for part in batches:
            for doc_id, n, chunks in zip(*(part.column(k).to_pylist() for k in range(3))):
                if file is None:
                    file, first = NewFile(f"{folder}/recipes", ".recipes"), doc_id
                    file.write(RECIPES)
                record = _record(doc_id, n, chunks)
                file.write(record)
                leaves.append(hashlib.sha256(record).digest())
                total += n
        if file is not None:
            row = ([file.close()], [first], [len(leaves)], [total], [merkle(leaves)])
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "first", "documents", "n_tokens", "root"])

    return run


def write_ids(docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write the ids of all texts (then id 1 each) to a store in ``folder``; returns the root of its manifest in hex.

    Null and empty texts have id 1 alone.  Documents stand in ascending order of doc_id, nulls first; of rows with one
    doc_id the order is not defined.  Tables ``folder``/index (digest, pack, offset, length) and ``folder``/manifest
    (file, first, documents, n_tokens, root, start) are Parquet.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    met = materialised(source.mapInArrow(tidy(_chunked(path, folder), caches=True), MET))
    new = met.select(F.explode("new").alias("n")).select("n.*")
    chosen = new.groupBy("digest").agg(F.min(F.struct("pack", "offset", "length")).alias("at")).select("digest", "at.*")
    # Ranges of places spread evenly over tasks, and each task reads few packs.
    placed = chosen.repartitionByRange(partitions(spark), "pack", "offset").sortWithinPartitions("pack", "offset")
    placed.mapInArrow(_copied(folder), "digest binary, pack string, offset long, length int").write.parquet(f"{folder}/index")
    ordered = met.select("doc_id", "n_tokens", "chunks").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    lines = materialised(ordered.mapInArrow(_recipes(folder), MANIFEST))
    order = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    lines.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).write.parquet(f"{folder}/manifest")
    # One line for each recipe file, and those are as many as the partitions above.
    root = merkle([bytes(r.root) for r in lines.orderBy(F.col("first").asc_nulls_first(), "file").select("root").toLocalIterator()])
    for pack in new.select("pack").distinct().toLocalIterator():
        delete(pack["pack"])
    system, at = located(f"{folder}/manifest.json")
    with system.open_output_stream(at) as out:
        out.write(json.dumps({"format": "FKR1", "tokenizer": path.rpartition("/")[2], "root": root.hex()}).encode())
    return root.hex()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the manifest to the chunks of their documents: file, row, doc_id, start, n_tokens, seq, digest, size."""
    for part in batches:
        for file, start, root in zip(*(part.column(k).to_pylist() for k in range(3))):
            system, path = located(file)
            with system.open_input_file(path) as data:
                raw = data.readall()
            if raw[:4] != RECIPES:
                raise ValueError(f"{file} is no recipe file")
            at, leaves, rows = 4, [], []
            while at < len(raw):
                null, doc_id, n, count = struct.unpack_from("<BqQI", raw, at)
                end = at + 21 + 20 * count
                leaves.append(hashlib.sha256(raw[at:end]).digest())
                for k in range(count):
                    spot = at + 21 + 20 * k
                    rows.append((file, len(leaves), None if null else doc_id, start, n, k, raw[spot : spot + 16], struct.unpack_from("<I", raw, spot + 16)[0]))
                at, start = end, start + n
            if merkle(leaves) != root:
                raise ValueError(f"{file} differs from its manifest")
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows[k : k + 10_000]), kinds)], names=["file", "row", "doc_id", "start", "n_tokens", "seq", "digest", "size"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunks with their places, sorted by document and seq: doc_id, start, n_tokens, ids (binary)."""
    readers = Readers()
    key, head, parts, rows = None, None, [], []

    def done() -> None:
        ids = b"".join(parts)
        if len(ids) != 4 * head[2]:
            raise ValueError(f"document {head[0]} has {len(ids) // 4} ids, its recipe {head[2]}")
        rows.append((*head, ids))

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])
        rows.clear()
        return out

    for part in batches:
        for file, row, doc_id, start, n, digest, pack, offset, length in zip(*(part.column(k).to_pylist() for k in ("file", "row", "doc_id", "start", "n_tokens", "digest", "pack", "offset", "length"))):
            if (file, row) != key:
                if key:
                    done()
                key, head, parts = (file, row), (doc_id, start, n), []
            chunk = unsqueezed(readers.read(pack, offset, length))
            if digest_of(chunk) != digest:
                raise ValueError(f"chunk {digest.hex()} differs from its digest")
            parts.append(chunk)
        if len(rows) >= 500:
            yield batch()
    if key:
        done()
    if rows:
        yield batch()
    readers.close()


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document of a store: doc_id, start (ids of all documents before it), n_tokens, ids (binary, 32-bit)."""
    ship(spark)
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "start", "root").repartition(partitions(spark), "file")
    chunks = manifest.mapInArrow(_parsed, "file string, row long, doc_id long, start long, n_tokens long, seq int, digest binary, size int")
    index = spark.read.parquet(f"{folder}/index").withColumnRenamed("digest", "key")
    # The size of what the recipes hold is not known from the manifest's: no broadcast.
    placed = chunks.join(index.hint("merge"), F.col("digest") == F.col("key")).drop("key", "size")
    rows = placed.repartition("file", "row").sortWithinPartitions("file", "row", "seq")
    return rows.mapInArrow(_rebuilt, "doc_id long, start long, n_tokens long, ids binary")


def id_store(docs: DataFrame, path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of ``docs`` and read the files back: doc_id, start, n_tokens, ids.  An empty table gives an empty result."""
    folder = folder or new_folder(docs.sparkSession, "ids")
    write_ids(docs, path, folder, doc_id, text)
    return read_ids(docs.sparkSession, folder)
