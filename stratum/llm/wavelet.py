"""Token ids in wavelet matrices, one compressed file for each shard.

Documents are range-partitioned by id, so shard follows shard in ascending order of ids. A shard's ids are written as
bit-planes, the highest bit first; behind each plane the ids are reordered, stably, those with a 0 before those with
a 1. A plane is cut into frames that are compressed one by one, and the head of the file says where each frame begins
and how many ones come before it. So a reader gets any id, counts an id in any stretch, or finds its k-th occurrence
from a few frames of each plane. The number of levels follows the largest id of the shard.

Defined cases: ids of documents are integers; a null text counts as empty and is one end id; null ids come first; rows that tie in their id are
ordered by their text's hash; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import ByteTokens
from .common import materialize, shared_path, text_arrays
from .files import new_name, place

MAGIC = b"WVMX0001"
#: Bits of a frame of a plane. A shard is closed when it has so many ids.
FRAME_BITS, SHARD_IDS = 1 << 18, 6_000_000
#: Ids that are moved at a time, so that they stay in the processor's cache.
CACHED = 1 << 15
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
MANIFEST = "part int, seq int, file string, documents long, ids long"


def _parted(now: np.ndarray, bit: np.ndarray, zeros: int) -> np.ndarray:
    """now, stably, those without the bit first."""
    out, zero, one = np.empty_like(now), 0, zeros
    for s in range(0, len(now), CACHED):
        part, at = now[s : s + CACHED], bit[s : s + CACHED]
        ones = int(np.count_nonzero(at))
        rest = len(at) - ones
        np.compress(~at, part, out=out[zero : zero + rest])
        np.compress(at, part, out=out[one : one + ones])
        zero, one = zero + rest, one + ones
    return out


def build(ids: np.ndarray, doc_ids: np.ndarray, no_id: np.ndarray, lengths: np.ndarray, level: int = 3) -> bytes:
    """The bytes of a shard's file."""
    press = zstandard.ZstdCompressor(level=level)
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    body, frames, ones_before, zeros, at = [], [], [], [], 0

    def put(data: bytes) -> tuple[int, int]:
        nonlocal at
        packed = press.compress(data)
        body.append(packed)
        at += len(packed)
        return at - len(packed), len(packed)

    documents = [put(x.tobytes()) for x in (doc_ids.astype("<i8"), np.packbits(no_id), lengths.astype("<i8"))]
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for k in range(levels - 1, -1, -1):
        bit = (now & now.dtype.type(1 << k)) != 0
        starts = range(0, len(now), FRAME_BITS)
        frames.append([put(np.packbits(bit[s : s + FRAME_BITS]).tobytes()) for s in starts])
        sums = [int(np.count_nonzero(bit[s : s + FRAME_BITS])) for s in starts]
        ones_before.append(np.concatenate(([0], np.cumsum(sums))).astype(int).tolist())
        zeros.append(len(now) - ones_before[-1][-1])
        now = _parted(now, bit, zeros[-1])
    head = json.dumps({"n": len(ids), "levels": levels, "frame_bits": FRAME_BITS, "documents": documents, "n_documents": len(lengths), "frames": frames, "ones_before": ones_before, "zeros": zeros}).encode()
    return b"".join((MAGIC, len(head).to_bytes(8, "little"), head, *body))


class WaveletFile:
    """A shard's file, opened: source has read_at(length, offset), as pyarrow's files do."""

    def __init__(self, source):
        self.source = source
        if source.read_at(8, 0) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(source.read_at(8, 8), "little")
        self.head = json.loads(source.read_at(size, 16))
        self.body = 16 + size
        self.n, self.levels = self.head["n"], self.head["levels"]
        self._frames: dict[tuple[int, int], np.ndarray] = {}

    def _section(self, where: list[int]) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(where[1], self.body + where[0]))

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, which of them are null, and numbers of token ids of the documents, in order."""
        ids, none, lengths = (self._section(x) for x in self.head["documents"])
        n = self.head["n_documents"]
        return np.frombuffer(ids, "<i8"), np.unpackbits(np.frombuffer(none, np.uint8), count=n).astype(bool), np.frombuffer(lengths, "<i8")

    def _frame(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._frames:
            if len(self._frames) > 64:
                self._frames.clear()
            self._frames[level, k] = np.frombuffer(self._section(self.head["frames"][level][k]), np.uint8)
        return self._frames[level, k]

    def _bit(self, level: int, i: int) -> int:
        k, j = divmod(i, FRAME_BITS)
        return int(self._frame(level, k)[j >> 3]) >> (7 - (j & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, j = divmod(i, FRAME_BITS)
        before = self.head["ones_before"][level][k]
        if j:
            frame = self._frame(level, k)
            before += int(_ONES[frame[: j >> 3]].sum())
            if j & 7:
                before += int(_ONES[frame[j >> 3] >> (8 - (j & 7))])
        return before

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.head["zeros"][level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        """Where those among the ids low..high-1 that are symbol stand below the last plane."""
        if symbol >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            if symbol >> (self.levels - 1 - level) & 1:
                low, high = self.head["zeros"][level] + a, self.head["zeros"][level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """How often symbol is among the ids low..high-1."""
        high = self.n if high is None else min(high, self.n)
        first, end = self._range(symbol, min(low, high), high)
        return end - first

    def select(self, symbol: int, k: int) -> int:
        """Where the k-th occurrence of symbol is, from 0."""
        first, end = self._range(symbol, 0, self.n)
        if not 0 <= k < end - first:
            raise IndexError(k)
        return int(self._up(symbol, np.asarray([first + k]))[0])

    def occurrences(self, symbol: int, most: int | None = None) -> np.ndarray:
        """Where symbol occurs, in ascending order: all places, or the first `most`."""
        first, end = self._range(symbol, 0, self.n)
        return self._up(symbol, np.arange(first, end if most is None else min(end, first + most)))

    def _up(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """From places of symbol below the last plane, ascending, to places in the ids."""
        for level in range(self.levels - 1, -1, -1):
            at = self._places(level, at, symbol >> (self.levels - 1 - level) & 1)
        return at

    def _places(self, level: int, at: np.ndarray, bit: int) -> np.ndarray:
        """Where, in a plane, the bits stand that went to places at (ascending) below it: one look at each frame."""
        want = at - self.head["zeros"][level] if bit else at
        ones = np.asarray(self.head["ones_before"][level])
        before = ones if bit else np.minimum(np.arange(len(ones)) * FRAME_BITS, self.n) - ones
        frame = np.searchsorted(before, want, "right") - 1
        out = np.empty_like(want)
        for k in np.unique(frame):
            lo, hi = np.searchsorted(frame, (k, k + 1))
            bits = np.unpackbits(self._frame(level, int(k)))[: min(FRAME_BITS, self.n - int(k) * FRAME_BITS)]
            out[lo:hi] = k * FRAME_BITS + np.flatnonzero(bits == bit)[want[lo:hi] - before[k]]
        return out

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            parts = [np.frombuffer(self._section(x), np.uint8) for x in self.head["frames"][level]]
            bit = np.unpackbits(np.concatenate(parts), count=self.n).astype(bool) if parts else np.zeros(0, bool)
            above, zero, one = np.empty_like(out), 0, self.head["zeros"][level]
            out[one:] |= out.dtype.type(1 << (self.levels - 1 - level))
            for s in range(0, self.n, CACHED):
                part, at = above[s : s + CACHED], bit[s : s + CACHED]
                ones, rest = np.flatnonzero(at), np.flatnonzero(~at)
                part[rest], part[ones] = out[zero : zero + len(rest)], out[one : one + len(ones)]
                zero, one = zero + len(rest), one + len(ones)
            out = above
        return out


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids to files in the shared folder; returns the written manifest: part, seq, file,
    documents, ids, and start, the number of ids in all files before."""
    spark = docs.sparkSession
    folder = shared_path(spark, "wavelet")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = slim.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = ByteTokens.at(tokenizer_path), TaskContext.get().partitionId()
        system, root = place(folder)
        held: list[tuple[np.ndarray, ...]] = []
        size, seq = 0, 0

        def close() -> pa.RecordBatch:
            ids, doc_ids, none, lengths = (np.concatenate(x) for x in zip(*held))
            name = new_name("ids", ".wm")
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(build(ids, doc_ids, none, lengths))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), pa.array([len(lengths)]), pa.array([len(ids)])], names=["part", "seq", "file", "documents", "ids"])

        for batch in batches:
            for at, end, texts in text_arrays(batch, 1):
                ids, bounds = tokens.encode(texts)
                own = batch.column(0).slice(at, end - at)
                held.append((np.insert(ids, bounds[1:], end_id), own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), np.diff(bounds) + 1))
                size += len(held[-1][0])
                if size >= SHARD_IDS:
                    yield close()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield close()

    manifest = placed.mapInArrow(write, MANIFEST).withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))
    manifest = materialize(manifest, "wavelet-manifest")  # a row for each file
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def open_shard(file: str) -> WaveletFile:
    folder, name = file.rsplit("/", 1)
    system, root = place(folder)
    return WaveletFile(system.open_input_file(f"{root}/{name}"))


def _spread(manifest: DataFrame) -> DataFrame:
    """The files and their starts, dealt to all tasks however small the manifest is."""
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(tasks, "file")


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document, read from the files: id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                shard = open_shard(file)
                doc_ids, none, lengths = shard.documents()
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lengths, ends)]
                columns = [pa.array(doc_ids, mask=none), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends))), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return _spread(manifest).mapInArrow(read, schema)


def find_token(manifest: DataFrame, token: int, most: int | None = None) -> DataFrame:
    """Where an id occurs, from the files' planes alone: file, count in the file, and global places (the first `most` of a file)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                shard = open_shard(file)
                at = start + shard.occurrences(token, most)
                columns = [pa.array([file]), pa.array([shard.count(token)]), pa.array([at], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "count", "places"])

    return _spread(manifest).mapInArrow(find, "file string, count long, places array<long>")
