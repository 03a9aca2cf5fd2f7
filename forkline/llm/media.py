"""Media columns: content-addressed payloads in tar shards, described by rows of digest, shard, offset and length.

A payload (bytes) is stored as an 8-bit greyscale PNG of ``WIDTH`` samples a row, named by its SHA-256.  Map tasks
write shards of ustar members, each content once a task, and return rows; the least (shard, offset) of a digest is its
place, for all tasks alike, so that equal payloads have one address.  (A copy that another task wrote of the same content
is not referred to.)  Metadata columns are filled by range reads of the header bytes only; features and digests of the
payload by reading the whole member back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.llm.bpe import text_slices
from forkline.llm.files import NewFile, Readers
from forkline.llm.memory import tidy
from forkline.session import materialised, new_folder, ship

WIDTH = 576
SHARD = 256 << 20
HEADER = 33  # signature (8), IHDR: length, name, 13 bytes, CRC (25)
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with bytes 255 appended up to a positive multiple of ``width``."""
    return data + b"\xff" * (-len(data) % width if data else width)


def to_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """Rows of ``width`` 8-bit grey samples, unfiltered."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    raw = np.concatenate((np.zeros((len(rows), 1), dtype=np.uint8), rows), axis=1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first bytes of a PNG."""
    if header[:8] != SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", header[16:25])


def from_png(data: bytes) -> bytes:
    """The payload of a PNG that ``to_png`` made; its checksums are verified."""
    width, height, _ = png_size(data)
    at, parts = 8, []
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("bad checksum")
        if name == b"IDAT":
            parts.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def member(name: str, data: bytes) -> tuple[bytes, bytes]:
    """ustar header and padding of a member, without owner or time."""
    info = tarfile.TarInfo(name)
    info.size = len(data)
    return info.tobuf(tarfile.USTAR_FORMAT), b"\0" * (-len(data) % 512)


def features(payload: bytes) -> str:
    """Mean, deviation and entropy (bits) of the samples, and the share of equal neighbours."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    level = np.arange(256)
    mean = float((counts * level).sum() / len(samples))
    deviation = float(np.sqrt((counts * (level - mean) ** 2).sum() / len(samples)))
    same = float((samples[1:] == samples[:-1]).mean())
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={-float((share * np.log2(share)).sum()):.4f};flat={same:.4f}"


STORED = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"


def store(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD) -> DataFrame:
    """Write the texts' payloads to shards in ``folder``; rows doc_id, n_bytes, digest, shard, offset, length.

    Null texts are empty.  Each row that goes in comes out once, with null or repeated doc_ids too.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, places = None, {}
        for part in batches:
            at = 0
            for texts in text_slices(part.column(1)):
                rows = []
                for text in texts:
                    data = text.encode()
                    payload = padded(data)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in places:
                        if file is None:
                            file = NewFile(folder, ".tar")
                        media = to_png(payload)
                        head, tail = member(f"{digest.hex()}.png", media)
                        file.write(head)
                        places[digest] = (file.uri, file.write(media), len(media))
                        file.write(tail)
                    rows.append((len(data), digest, *places[digest]))
                    if file is not None and file.size >= shard_bytes:
                        file.write(b"\0" * 1024)
                        file.close()
                        file, places = None, {}
                n, digest, shard, offset, length = (list(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
                at += len(texts)
        if file is not None:
            file.write(b"\0" * 1024)
            file.close()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialised(source.mapInArrow(tidy(run), STORED))


def described(places: DataFrame) -> DataFrame:
    """Metadata columns of rows (digest, shard, offset, length) by reads of header bytes alone: width, height, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = Readers()
        for part in batches:
            _, shard, offset, _ = (c.to_pylist() for c in part.columns)
            sizes = [png_size(readers.read(s, o, HEADER)) for s, o in zip(shard, offset)]
            yield pa.RecordBatch.from_arrays(part.columns + [pa.array([s[k] for s in sizes], pa.int32()) for k in range(3)], names=[*part.schema.names, "width", "height", "bits"])
        readers.close()

    return places.select("digest", "shard", "offset", "length").mapInArrow(run, "digest binary, shard string, offset long, length long, width int, height int, bits int")


def computed(places: DataFrame) -> DataFrame:
    """Features of described rows, computed from the stored bytes; a payload that does not match its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = Readers()
        for part in batches:
            columns = {n: part.column(n).to_pylist() for n in ("digest", "shard", "offset", "length", "width", "height")}
            out = []
            for digest, shard, offset, length, width, height in zip(*columns.values()):
                media = readers.read(shard, offset, length)
                payload = from_png(media)
                if hashlib.sha256(payload).digest() != digest or len(payload) != width * height:
                    raise ValueError(f"{digest.hex()} differs from what was stored")
                out.append((digest, shard, offset, length, len(payload), payload[-32:], len(media), hashlib.sha256(media).hexdigest(), f"width={width};height={height};{features(payload)}"))
            values = [list(c) for c in zip(*out)] if out else [[]] * 9
            kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["digest", "shard", "offset", "length", "payload_bytes", "tail", "media_bytes", "media_sha256", "feature"])
        readers.close()

    return places.mapInArrow(run, "digest binary, shard string, offset long, length long, payload_bytes long, tail binary, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Store the texts of ``docs`` as media and return, for each row: doc_id, n_bytes, digest, shard, offset, length,
    payload_bytes, tail (the payload's last 32 bytes), media_bytes, media_sha256, feature.

    Null and empty texts have a payload of padding.  Equal texts have equal values throughout.  An empty table gives an
    empty result; doc_id may be null or repeated; other columns are not read.
    """
    folder = folder or new_folder(docs.sparkSession, "media")
    rows = store(docs, folder, doc_id, text)
    least = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    places = least.select("digest", "at.shard", "at.offset", "at.length").sortWithinPartitions("shard", "offset")
    known = materialised(computed(described(places)))
    return rows.select("doc_id", "n_bytes", F.col("digest").alias("key")).join(known, F.col("digest") == F.col("key")).drop("key")
