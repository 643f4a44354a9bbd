"""Token ids as length-delimited binary records.

A shard file is a run of records, each framed as

    uint64 length | uint32 masked crc32c(length) | payload | uint32 masked crc32c(payload)

(little-endian; the mask rotates the checksum by 15 bits and adds 0xa282ead8).
The payload is ``int64 doc_id | uint8 flags | ids``; ids take two bytes each
where the vocabulary fits, else four.  Beside each shard lies an offset index
with one entry (int64 offset, int64 length, int64 tokens before it in the
shard) per record, so a reader can fetch any record without a scan.  A small
``_manifest`` table (one row per shard) is written last and names the files
that count: what a lost task attempt left behind is never read.

Rows are range-partitioned by id, so shards follow each other in ascending
order (null ids first); a task streams its rows, one batch of tokens at a time.

Defined cases: a null or empty text is the end id alone; rows that repeat get
a record each (an id that fills many rows may span shards); a null id is kept
as null; an empty table gives no shard and no rows; a text of any length is
encoded whole; strings of special tokens are what the
tokenizer's own defaults make of them; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptforge.llm.byte_bpe import encoder, with_end
from promptforge.llm.common import slices_by_bytes

ENTRY = np.dtype([("offset", "<i8"), ("length", "<i8"), ("before", "<i8")])
HEAD = struct.Struct("<qB")
_NULL_ID, _WIDE = 1, 2
_FLUSH = 4 << 20
MANIFEST = "shard int, file string, records long, tokens long, bytes long"

# ---------------------------------------------------------------- checksums

_POLY = 0x82F63B78  # crc32c, reflected
_LANE = 4096


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


_T0 = _byte_table()
_T1 = _T0[_T0 & 255] ^ (_T0 >> 8)


def _two_bytes() -> np.ndarray:
    """Register after two bytes, by its low 16 bits xor the bytes."""
    x = np.arange(1 << 16, dtype=np.uint32)
    x = _T0[x & 255] ^ (x >> 8)
    return _T0[x & 255] ^ (x >> 8)


_PAIR = _two_bytes()


def _advance(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _zeros(n: int) -> np.ndarray:
    """Tables that move a register past ``n`` zero bytes."""
    bits = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    for _ in range(n):
        bits = _T0[bits & 255] ^ (bits >> 8)
    out = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for b in range(8):
            on = (np.arange(256) >> b & 1).astype(bool)
            out[k][on] ^= bits[8 * k + b]
    return out


_SKIP_LANE = _zeros(_LANE)
_POWERS = [_zeros(1 << k) for k in range(12)]  # by single bits of a length below a lane


def _lanes(data: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Registers after the rows of ``data`` (lanes x an even number of bytes)."""
    pairs = np.ascontiguousarray(np.ascontiguousarray(data).view("<u2").T).astype(np.intp)
    crc, at, got = crc.astype(np.intp), np.empty(len(data), np.intp), np.empty(len(data), np.intp)
    table = _PAIR.astype(np.intp)
    for pair in pairs:
        np.bitwise_xor(crc, pair, out=at)
        np.bitwise_and(at, 0xFFFF, out=at)
        np.take(table, at, out=got, mode="clip")
        np.right_shift(crc, 16, out=crc)
        np.bitwise_xor(crc, got, out=crc)
    return crc.astype(np.uint32)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings, computed in parallel lanes."""
    whole = [len(p) // _LANE for p in parts]
    lanes = [np.frombuffer(p, np.uint8, w * _LANE).reshape(w, _LANE) for p, w in zip(parts, whole) if w]
    done: np.ndarray = _lanes(np.concatenate(lanes), np.zeros(sum(whole), np.uint32)) if lanes else np.zeros(0, np.uint32)
    # the rest of each string, aligned to the right of a lane: leading zeros leave a zero register as it is
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]) % _LANE)
    tail = np.zeros(len(parts), dtype=np.uint32)
    for at in range(0, len(order), 1024):
        some = order[at:at + 1024]
        width = len(parts[some[-1]]) % _LANE
        width += width & 1
        rows = np.zeros((len(some), width), dtype=np.uint8)
        for r, i in enumerate(some):
            n = len(parts[i]) % _LANE
            if n:
                rows[r, width - n:] = np.frombuffer(parts[i], np.uint8, n, whole[i] * _LANE)
        tail[some] = _lanes(rows, np.zeros(len(some), np.uint32)) if width else 0
    crc = np.full(len(parts), 0xFFFFFFFF, dtype=np.uint32)
    count = np.array(whole, dtype=np.int64)
    begin = np.cumsum(count) - count
    for lane in range(max(whole, default=0)):
        on = np.flatnonzero(count > lane)
        crc[on] = _advance(_SKIP_LANE, crc[on]) ^ done[begin[on] + lane]
    left = np.array([len(p) % _LANE for p in parts], dtype=np.int64)
    for k, tables in enumerate(_POWERS):
        on = np.flatnonzero(left >> k & 1)
        crc[on] = _advance(tables, crc[on])
    return crc ^ tail ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


# ---------------------------------------------------------------- writing


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def payload(doc_id: int | None, codes: bytes, flag: int) -> bytes:
    return HEAD.pack(doc_id or 0, flag | (doc_id is None) * _NULL_ID) + codes


def _write(path: str, tokenizer: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = np.dtype(dtype).itemsize
        flag = _WIDE if width == 4 else 0
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:05d}-{uuid.uuid4().hex}"  # every attempt has files of its own
        fs, base = _open(path)
        data = None
        offset = tokens = records = 0
        for batch in (part for whole in batches for part in slices_by_bytes(whole, "text", _FLUSH)):
            if data is None:
                fs.create_dir(base, recursive=True)
                data, index = fs.open_output_stream(f"{base}/{name}.bin"), fs.open_output_stream(f"{base}/{name}.idx")
            ids, n = with_end(*encode(batch.column("text")), end_id)
            codes, at = ids.astype(dtype).tobytes(), np.concatenate([[0], np.cumsum(n) * width]).tolist()
            body = [payload(i, codes[a:b], flag) for i, a, b in zip(batch.column("doc_id").to_pylist(), at, at[1:])]
            sizes = [struct.pack("<Q", len(b)) for b in body]
            crc = masked(crc32c(sizes + body)).astype("<u4")
            entry = np.zeros(len(body), dtype=ENTRY)
            entry["length"] = [len(b) for b in body]
            framed = entry["length"] + 16
            entry["offset"] = offset + np.cumsum(framed) - framed
            entry["before"] = tokens + np.cumsum(n) - n
            index.write(entry.tobytes())
            half = len(body)
            data.write(b"".join([x for i in range(half) for x in (sizes[i], crc[i].tobytes(), body[i], crc[half + i].tobytes())]))
            offset, tokens, records = offset + int(framed.sum()), tokens + int(n.sum()), records + half
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "records": records, "tokens": tokens, "bytes": offset}],
                                             schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()),
                                                               ("tokens", pa.int64()), ("bytes", pa.int64())]))

    return run


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 2, vocabulary: int = 50_257) -> None:
    """Encode and write all rows in ascending order of id under ``path`` (a
    folder that all executors share).  The manifest is written last."""
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       # rows of one id are told apart so that a common id can span shards
                       F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_t"), F.monotonically_increasing_id().alias("_r"))
    order = ["doc_id", "_t", "_r"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(_write(path, tokenizer, end_id, dtype), MANIFEST).write.parquet(f"{path}/_manifest")


# ---------------------------------------------------------------- reading


def unframe(data: bytes, entry: np.ndarray, base: int) -> list[bytes]:
    """Payloads of the records of ``entry`` in ``data`` (which starts at byte
    ``base`` of the shard); a wrong length or checksum is an error."""
    at = (entry["offset"] - base).tolist()
    sizes = [data[a:a + 8] for a in at]
    body = [data[a + 12:a + 12 + n] for a, n in zip(at, entry["length"].tolist())]
    crc = masked(crc32c(sizes + body))
    want = np.array([struct.unpack_from("<I", data, a + 8)[0] for a in at] +
                    [struct.unpack_from("<I", data, a + 12 + n)[0] for a, n in zip(at, entry["length"].tolist())], dtype=np.uint32)
    if [struct.unpack("<Q", s)[0] for s in sizes] != entry["length"].tolist() or (crc != want).any():
        raise ValueError("record checksum or length does not match")
    return body


def parse(body: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = HEAD.unpack_from(body)
    ids = np.frombuffer(body, "<u4" if flags & _WIDE else "<u2", offset=HEAD.size)
    return (None if flags & _NULL_ID else doc_id), ids


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        for shard in (row for batch in batches for row in batch.to_pylist()):
            with fs.open_input_file(f"{base}/{shard['file']}.idx") as f:
                entry = np.frombuffer(f.read(), dtype=ENTRY)
            with fs.open_input_file(f"{base}/{shard['file']}.bin") as f:
                at = 0
                while at < len(entry):
                    first = int(entry["offset"][at])
                    to = max(at + 1, int(np.searchsorted(entry["offset"], first + _FLUSH)))
                    last = entry[to - 1]
                    data = f.read_at(int(last["offset"] + last["length"]) + 16 - first, first)
                    out = [parse(b) for b in unframe(data, entry[at:to], first)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i for i, _ in out], pa.int64()), pa.array(entry["before"][at:to] + shard["start"]),
                        pa.array([len(x) for _, x in out], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for _, x in out], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    at = to

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32 bytes) of all records,
    read back shard by shard with both checksums verified."""
    shards = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row per shard
    shards = shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    tasks = max(1, min(10_000, shards.count()))
    return shards.repartitionByRange(tasks, "shard").mapInArrow(_read(path), "doc_id long, start long, n_tokens long, ids binary")


def fetch(path: str, file: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number in a shard, through the offset index: the read
    of a shuffled loader."""
    fs, base = _open(path)
    with fs.open_input_file(f"{base}/{file}.idx") as f:
        entry = np.frombuffer(f.read_at(ENTRY.itemsize, number * ENTRY.itemsize), dtype=ENTRY)
    with fs.open_input_file(f"{base}/{file}.bin") as f:
        data = f.read_at(int(entry["length"][0]) + 16, int(entry["offset"][0]))
    return parse(unframe(data, entry, int(entry["offset"][0]))[0])


def crc_of_ids(rows: DataFrame) -> DataFrame:
    """``read`` rows with ``ids_crc32`` instead of the ids."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def zlib_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
