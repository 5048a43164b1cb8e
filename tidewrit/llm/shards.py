"""Training-order materialisation: token sequences at keyed pseudo-random slots of fixed-stride shards.

1. A first pass counts the tokens of each input partition; only these counts reach the driver. A partition's tokens,
   each document closed by the end token, are cut into sequences of ``length`` tokens; a partition's last sequence may be
   shorter and is padded. So every sequence has an index, dense from 0 to N - 1.
2. A keyed Feistel permutation of the next power of four, with cycle-walking, sends the index to its slot in 0..N-1.
3. Rows go to the partition of their slot range and are written in slot order. Slot s stands in shard s // per_shard at
   byte (s % per_shard) * stride, so a reader seeks to any slot and resumes there; a task that is run again replaces its
   shards with the same bytes.

Tokenisation cuts a text where white space follows a character; as the pre-tokeniser never joins across such a place,
the pieces are encoded once, all new ones of a chunk in one call, and the encoding of a repeated piece is reused, with the
same ids as the whole text. Texts that hold other Unicode white space are encoded whole, and so are those with pieces of
over ``LONGEST_PIECE`` bytes. What a task remembers of pieces has a bound in bytes and goes when the task ends.

Shards are written by the tasks through pyarrow's file systems, so the folder may be local or mounted, or on HDFS (also by
viewfs), S3, Google or Azure storage; any other is refused before work begins. Where a file can be renamed, it gets its
name when it is whole; object stores show whole objects only.

The texts are tokenised twice, to count and to write. To keep the first pass's tokens instead would save a third of the
CPU seconds, but the tokens, the shuffle's copy of them and the shards together are over three times the input.

The partitions of both passes are those of the input scan; should they differ, the second pass fails. Null texts are as
empty ones: an end token alone. A null id stands as null in doc_ids. Repeated rows are written as often as they occur.
An empty table gives no sequence and no shard. Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .scratch import sent

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokeniser's pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END = 50256
LARGEST_VOCABULARY = 64 << 20
#: Bytes of the pieces that a task remembers; they are forgotten together when they are more.
PIECE_BYTES = 24 << 20
#: Up to this length different pieces have different hashes but for chance; longer ones are not looked up by hash.
LONGEST_PIECE = 512
#: White space of one byte that texts are cut before.
BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
_open: dict = {}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(LARGEST_VOCABULARY + 1)
    if len(data) > LARGEST_VOCABULARY:
        raise ValueError(f"{path} has more than {LARGEST_VOCABULARY} bytes")
    return data


class Pieces:
    """Encodes texts; remembers the ids of pieces by the 64-bit hash of their bytes."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.width[list(ranks.values())] = [len(x) for x in ranks]
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by key
        self.pool, self.off = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def n_bytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.place, self.pool, self.off))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys; -1 where a key is new."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1).astype(np.int64)

    def _learn(self, keys: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Places of new pieces [s, e) with these sorted keys. Pieces from a blank to a character that is none are encoded as one
        text, whose tokens never join two of them."""
        inner = np.flatnonzero(e > s)
        inner = inner[BLANK[buf[s[inner]]] & ~BLANK[buf[e[inner] - 1]]]
        size = e[inner] - s[inner]
        ends = np.cumsum(size)
        ids = self._ids(buf[np.repeat(s[inner] - ends + size, size) + np.arange(size.sum())])
        reached = np.cumsum(self.width[ids])
        cut = np.searchsorted(reached, ends) + 1
        if len(ends) and not (cut[-1] == len(ids) and np.array_equal(reached[cut - 1], ends)):
            raise RuntimeError("a token stands in two pieces")
        alone = np.setdiff1d(np.arange(len(keys)), inner, assume_unique=True)
        others = [self._ids(buf[x:y]) for x, y in zip(s[alone].tolist(), e[alone].tolist())]
        ids = np.concatenate([ids, *others])
        k, n = len(self.keys), len(keys)
        ends = self.off[k] + np.concatenate([cut, (cut[-1] if len(cut) else 0) + np.cumsum([len(x) for x in others], dtype=np.int64)])
        while k + n + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.off[k] : ends[-1]] = ids
        self.off[k + 1 : k + n + 1] = ends
        places = np.empty(n, np.int64)
        places[np.concatenate([inner, alone])] = np.arange(k, k + n)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, places)
        return places

    def _ids(self, buf: np.ndarray) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(buf.tobytes().decode()), np.int32)

    def _cut(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Of each piece the place and the number of ids; the offset of each text among the pieces; the ids of texts that are
        encoded whole, whose pieces have none."""
        if self.n_bytes() > PIECE_BYTES:
            self.clear()
        blank = BLANK[buf]
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf):
            cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[offs] = True
        s = np.flatnonzero(cut[:-1])
        e = np.append(s[1:], len(buf))
        piece_of = np.searchsorted(s, offs)
        odd = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)) | ((buf < 32) & ~blank))
        whole = np.unique(np.searchsorted(offs, odd, "right") - 1)  # their white space may be of other kinds
        whole = [d for d in whole.tolist() if any(c.isspace() and c not in " \n\t\r" for c in buf[offs[d] : offs[d + 1]].tobytes().decode())]
        whole = sorted({*whole, *(np.searchsorted(offs, s[e - s > LONGEST_PIECE], "right") - 1).tolist()})
        for d in whole:  # nothing is learnt of them
            e[piece_of[d] : piece_of[d + 1]] = s[piece_of[d] : piece_of[d + 1]]
        key, first, code = np.unique(kernels.slice_hashes(kernels.prefix_sums(buf), s, e), return_index=True, return_inverse=True)
        place = self._find(key)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn(key[new], buf, s[first[new]], e[first[new]])
        at = place[code]
        return at, self.off[at + 1] - self.off[at], piece_of, {d: self._ids(buf[offs[d] : offs[d + 1]]) for d in whole}

    def count(self, buf: np.ndarray, offs: np.ndarray) -> int:
        """How many ids encode() gives."""
        _, many, _, special = self._cut(buf, offs)
        return int(many.sum()) + sum(map(len, special.values())) + len(offs) - 1

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END, and the offset of each text among them."""
        at, many, piece_of, special = self._cut(buf, offs)
        before = np.concatenate([[0], np.cumsum(many)])
        counts = before[piece_of[1:]] - before[piece_of[:-1]]
        for d, ids in special.items():
            counts[d] = len(ids)
        out_off = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(int(out_off[-1]), END, np.int32)
        of_pieces = np.ones(len(out), bool)
        of_pieces[out_off[1:] - 1] = False
        for d, ids in special.items():
            out[out_off[d] : out_off[d + 1] - 1] = ids
            of_pieces[out_off[d] : out_off[d + 1]] = False
        out[of_pieces] = self.pool[np.repeat(self.off[at] - before[:-1], many) + np.arange(before[-1])]
        return out, out_off


def _pieces(shared) -> Pieces:
    """The worker's encoder; made again for another vocabulary."""
    if _open.get("of") != (key := hash(shared.value)):
        _open.update(of=key, pieces=Pieces(shared.value))
    return _open["pieces"]


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 8) -> np.ndarray:
    """A keyed permutation of 0..n-1, for any of these numbers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, width = kernels.U64((1 << half) - 1), kernels.U64(half)
    keys = kernels.mix(np.arange(1, rounds + 1, dtype=np.uint64) * kernels.U64(0x9E3779B97F4A7C15) + kernels.U64(key & ((1 << 64) - 1)))
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> width, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (kernels.mix(right + k) & mask)
        out[todo] = left << width | right
        todo &= out >= kernels.U64(n)
    return out.astype(np.int64)


def whole_uri(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark understands it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", uri))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"shards cannot be written to {uri}: {e}") from e


def materialise(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, length: int = 512, key: int = 20240229, per_shard: int = 16_384, id_col: str = "doc_id", text_col: str = "text", *, keep, most_tasks: int = 20_000) -> DataFrame:
    """Writes the shards and the kept manifest. Returns one row per sequence: slot, shard, byte_offset, n_tokens, doc_ids, crc."""
    spark = docs.sparkSession
    uri = whole_uri(spark, folder)
    file_system(uri)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with sent(spark, read_vocabulary(vocabulary)) as shared:

        def parts(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for lo, hi in kernels.chunks(kernels.raw(b.column(1))[1], 1 << 19):  # the worker's memory is that of a chunk and the pieces
                    yield b.column(0).slice(lo, hi - lo), kernels.raw(b.column(1).slice(lo, hi - lo))
            _pieces(shared).clear()

        def encoded(batches: Iterator[pa.RecordBatch]):
            for ids, texts in parts(batches):
                yield ids, *_pieces(shared).encode(*texts)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(_pieces(shared).count(*texts) for _, texts in parts(batches))
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total])], ["part", "n"])

        counts = {r[0]: r[1] for r in docs.mapInArrow(count, "part int, n long").collect()}  # one number a partition
        base, n = {}, 0
        for part in sorted(counts):
            base[part], n = n, n + -(-counts[part] // length)
        n_shards = -(-n // per_shard)
        tasks = max(1, min(n_shards, most_tasks))
        dtype = np.dtype(np.uint16 if END < 1 << 16 else np.uint32)
        stride = length * dtype.itemsize
        with sent(spark, (counts, base)) as plan:
            rows = docs.mapInArrow(_cutter(encoded, plan, n, length, key, dtype), "slot long, n_tokens int, doc_ids array<long>, tokens binary")
            rows = rows.withColumn("shard", F.expr(f"slot div {per_shard}"))
            rows = rows.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {max(n_shards, 1)} as int)")).sortWithinPartitions("slot")
            system, path = file_system(uri)
            system.create_dir(path, recursive=True)
            layout = {"sequences": n, "length": length, "dtype": dtype.name, "per_shard": per_shard, "stride": stride, "key": key, "end": END}
            with system.open_output_stream(f"{path}/layout.json") as f:
                f.write(json.dumps(layout).encode())
            written = rows.select("slot", "n_tokens", "doc_ids", "tokens", "shard").mapInArrow(_writer(uri, per_shard, stride), "slot long, n_tokens int, doc_ids array<long>, shard long, crc long")
            byte_offset = F.expr(f"(slot % {per_shard}) * {stride}")
            return keep(written.select("slot", "shard", byte_offset.alias("byte_offset"), "n_tokens", "doc_ids", "crc"), "manifest")


def _cutter(encoded, plan, n: int, length: int, key: int, dtype: np.dtype):
    """Documents to sequences at their slots; only a sequence's worth of tokens is carried from chunk to chunk."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        held, held_docs, held_off = np.zeros(0, np.int32), pa.array([], pa.int64()), np.zeros(1, np.int64)

        def cut(ids, docs_, off, m):
            slot = feistel(np.arange(m) + plan.value[1][part] + done, n, key)
            fill = np.full(m * length, END, dtype)
            fill[: min(len(ids), m * length)] = ids[: m * length]
            start = np.arange(m) * length
            size = np.minimum(len(ids) - start, length)
            a, e = np.searchsorted(off, start, "right") - 1, np.searchsorted(off, start + size, "left")
            many = e - a
            flat = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), docs_.take(pa.array(flat)))
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(size.astype(np.int32)), lists, kernels.fixed_binary(fill.reshape(m, length))], ["slot", "n_tokens", "doc_ids", "tokens"])

        for d, ids, off in encoded(batches):
            ids, d, off = np.concatenate([held, ids]), pa.concat_arrays([held_docs, d]), np.concatenate([held_off, len(held) + off[1:]])
            m = len(ids) // length
            if m:
                yield cut(ids, d, off, m)
                done += m
                first = int(np.searchsorted(off, m * length, "right")) - 1
                held, held_docs, held_off = ids[m * length :], d.slice(first), np.maximum(off[first:] - m * length, 0)
            else:
                held, held_docs, held_off = ids, d, off
        if len(held):
            yield cut(held, held_docs, held_off, 1)
            done += 1
        if done != -(-plan.value[0].get(part, 0) // length):
            raise RuntimeError(f"partition {part} has changed since it was counted")

    return sequences


def _writer(uri: str, per_shard: int, stride: int):
    """Sorted sequences to shard files; passes on what the manifest needs."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        system, path = file_system(uri)
        renames = system.type_name in ("local", "hdfs")
        task, out, now, expect = TaskContext.get(), None, -1, 0

        def name(shard: int) -> str:
            return f"{path}/.{shard:09d}.{task.taskAttemptId()}" if renames else shard_path(path, shard)

        def close():
            if out is not None:
                out.close()
                if renames:
                    system.move(name(now), shard_path(path, now))

        for b in batches:
            slot = b.column(0).to_numpy()
            data = kernels.raw(b.column(3))[0].tobytes()
            for lo in [0, *(np.flatnonzero(np.diff(slot // per_shard)) + 1).tolist()] if len(slot) else []:
                shard = int(slot[lo]) // per_shard
                hi = int(np.searchsorted(slot, (shard + 1) * per_shard))
                if shard != now:
                    close()
                    now, expect = shard, shard * per_shard
                    out = system.open_output_stream(name(now))
                if not np.array_equal(slot[lo:hi], np.arange(expect, expect + hi - lo)):
                    raise RuntimeError(f"shard {shard} lacks slots after {expect}")
                out.write(data[lo * stride : hi * stride])
                expect += hi - lo
            crc = pa.array([zlib.crc32(data[i * stride : (i + 1) * stride]) for i in range(len(slot))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), crc], ["slot", "n_tokens", "doc_ids", "shard", "crc"])
        close()

    return write


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:09d}.bin"


def read_sequences(uri: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """Sequences in training order from any slot on; each shard is read forwards, once. uri is a folder with its scheme (see
    whole_uri()) or an absolute local path."""
    system, path = file_system(uri)
    with system.open_input_stream(f"{path}/layout.json") as f:
        layout = json.loads(f.read())
    stop, per = layout["sequences"] if stop is None else min(stop, layout["sequences"]), layout["per_shard"]
    while start < stop:
        shard = start // per
        last = min(stop, (shard + 1) * per)
        with system.open_input_file(shard_path(path, shard)) as f:
            f.seek(start % per * layout["stride"])
            for _ in range(last - start):
                yield np.frombuffer(f.read(layout["stride"]), layout["dtype"])
        start = last
