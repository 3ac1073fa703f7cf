"""Blocks of documents, and exchanges of hashed keys between them.

Operators that compare every document with every other one work in rounds. The documents are packed once into
compressed blocks of about a megabyte, partitioned by ``block_id`` and checkpointed. A round sends, for each block, its
distinct keys (64-bit hashes, once per block however often they occur) to the bucket that owns the key's range; the
bucket answers each block with those of its keys that matter. Blocks and answers meet in a cogroup on ``block_id``; the
checkpoint keeps the partitioning, so the text isn't shuffled again. A key that a third of all documents hold costs
one entry per block, no task sees more than one block or one bucket at a time, and nothing is sent to the driver.

A null id stands as ``NULL_ID`` inside blocks, so a doc_id of 2^63-1 is taken for a null one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.model import shared_folder

U64 = np.uint64
#: Id that stands for a null one inside blocks; it sorts after all others.
NULL_ID = np.iinfo(np.int64).max
BLOCK_BYTES = 1 << 20
BLOCK_SCHEMA = "block_id long, n_docs int, raw_len long, ids binary, lens binary, data binary, rest binary"
KEY_SCHEMA = "bucket long, block_id long, blob binary"
ANSWER_SCHEMA = "block_id long, blob binary"
#: Odd multipliers of the hashes, and how many values are folded one after the other.
K1, K2, CHUNK = U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F), 64


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder that the cluster names in spark.checkpoint.dir; see model.shared_folder."""
    shared_folder(spark)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a hash over all 64 bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: Bytes with A-Z as a-z, and masks for the first bytes of a 64-bit word.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
#: True for bytes outside words. Both classes hold whole UTF-8 sequences: every byte from 0x80 is inside words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NON_ALNUM = np.ones(256, dtype=bool)
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = NON_ALNUM[128:] = False


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span, of bytes or of 64-bit numbers; equal spans have equal hashes wherever
    they stand. Each step multiplies and shifts, so it isn't a polynomial, for which some strings always collide. Long spans
    are folded in chunks, whose hashes are folded in turn."""
    size = ends - starts
    if values.dtype == np.uint8:
        buf, step = np.concatenate([values, np.zeros(8, np.uint8)]), 8
        words = np.ndarray((len(values) + 1,), dtype="<u8", buffer=buf, strides=(1,))
    else:
        words, step = values, 1
    wide = CHUNK * step
    n = np.maximum(1, -(-size // wide))
    several = bool((n > 1).any())
    at, left = starts, size
    if several:
        inner = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * wide
        at, left = np.repeat(starts, n) + inner, np.minimum(wide, np.repeat(size, n) - inner)
    h = (left.astype(U64) + U64(1)) * K2
    alive, k = np.flatnonzero(left > 0), 0
    while len(alive):
        x = words[at[alive] + k]
        if step == 8:
            x &= MASKS[np.minimum(left[alive] - k, 8)]
        g = h[alive]
        g ^= x
        g *= K1
        g ^= g >> U64(32)
        h[alive] = g
        k += step
        alive = alive[left[alive] > k]
    h = mix(h)
    if several:
        to = np.cumsum(n)
        one = h[to - 1]
        many = np.flatnonzero(n > 1)
        one[many] = span_hashes(h, to[many] - n[many], to[many])
        h = mix(one + size.astype(U64) * K1)
        h[n == 1] = one[n == 1]
    return h


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each size numbers in a row: of halves, of their halves, and so on."""

    def join(a, b):
        x = a * K1
        x ^= x >> U64(31)
        x += b
        x *= K2
        x ^= x >> U64(32)
        return x

    if len(h) < size:
        return np.zeros(0, U64)
    m, width = h, 1
    while 2 * width <= size:
        m, width = join(m[:-width], m[width:]), 2 * width
    return mix(m if width == size else join(m[: len(h) - size + 1], m[size - width :]))


def words_of(buf: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that aren't outside words."""
    m = np.empty(len(buf) + 2, dtype=np.int8)
    m[0] = m[-1] = 1
    m[1:-1] = outside[buf]
    d = np.diff(m)
    return np.flatnonzero(d == -1), np.flatnonzero(d == 1)


class Block:
    """Documents of one row of BLOCK_SCHEMA. ``buf`` has the texts as UTF-8, each followed by one line feed; ``rest`` has
    the columns that are carried along."""

    def __init__(self, block_id: int, ids: np.ndarray, lens: np.ndarray, raw: bytes, rest: pa.Table | None = None):
        self.block_id, self.ids, self.lens, self.raw, self.rest = block_id, ids, lens, raw, rest
        self.buf = np.frombuffer(raw, dtype=np.uint8)
        self.off = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens + 1)])

    @classmethod
    def of(cls, ids: list[int | None] | np.ndarray, texts: list[bytes | None], block_id: int = 0) -> Block:
        texts = [t or b"" for t in texts]
        if not isinstance(ids, np.ndarray):
            ids = np.array([NULL_ID if i is None else i for i in ids], dtype=np.int64)
        return cls(block_id, ids, np.array([len(t) for t in texts], dtype=np.int64), b"".join([t + b"\n" for t in texts]))

    @classmethod
    def load(cls, r: dict) -> Block:
        raw = pa.decompress(r["data"], r["raw_len"], "zstd", asbytes=True) if r["raw_len"] else b""
        rest = pa.ipc.open_stream(r["rest"]).read_all() if r["rest"] else None
        return cls(r["block_id"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["lens"], np.int64), raw, rest)

    def row(self) -> tuple:
        """As BLOCK_SCHEMA has it."""
        data = pa.compress(self.raw, codec="zstd", asbytes=True) if self.raw else b""
        rest = b""
        if self.rest is not None:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(self.rest)
            rest = sink.getvalue().to_pybytes()
        return self.block_id, len(self.ids), len(self.raw), self.ids.tobytes(), self.lens.tobytes(), data, rest

    def carried(self, rows: np.ndarray | None = None, text_col: str | None = None, texts: list[bytes] | None = None) -> pa.Table:
        """The carried columns of some rows, or all; with texts, the column text_col has these instead."""
        out = self.rest if rows is None else self.rest.take(pa.array(rows))
        if texts is not None:
            at = out.schema.get_field_index(text_col)
            out = out.set_column(at, out.schema.field(at), pa.array(texts, pa.binary()).cast(pa.string()))
        return out

    def text(self, i: int) -> bytes:
        return self.raw[self.off[i] : self.off[i] + self.lens[i]]

    def words(self, outside: np.ndarray = SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, hashes and document indexes of all words."""
        s, e = words_of(self.buf, outside)
        h = span_hashes(LOWER[self.buf] if lower else self.buf, s, e)
        return s, e, h, np.searchsorted(self.off, s, side="right") - 1

    def out_ids(self) -> pa.Array:
        return pa.array(self.ids, mask=self.ids == NULL_ID)


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each run of size words of one document."""
    if len(h) < size:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(doc[: len(h) - size + 1] == doc[size - 1 :])
    return at, run_hashes(h, size)[at]


def cover(at: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    """True for each of n places inside one of the spans [at, at + size)."""
    d = np.zeros(n + 1, dtype=np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, at + size, -1)
    return np.cumsum(d[:-1]) > 0


def rows_of(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        yield from batch.to_pylist()


def blocks_in(table) -> Iterator[Block]:
    for r in rows_of(table):
        yield Block.load(r)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def local_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks, numbered from 0, of batches whose first two columns are an id and a text as binary. The fields of a third
    are carried along."""
    seq, ids, texts, rest, size = 0, [], [], [], 0

    def block():
        out = Block.of(ids, texts, seq)
        out.rest = pa.Table.from_batches(rest).combine_chunks() if rest else None
        return out

    for b in batches:
        first = 0
        more = pa.RecordBatch.from_struct_array(b.column(2)) if b.num_columns > 2 else None
        for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), 1):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1]) + 1
            if size >= block_bytes or k == b.num_rows:
                if more is not None:
                    rest.append(more.slice(first, k - first))
                first = k
            if size >= block_bytes:
                yield block()
                seq, ids, texts, rest, size = seq + 1, [], [], [], 0
    if ids:
        yield block()


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents as checkpointed blocks, partitioned by block_id. A null text is an empty one. A document that is
    longer than a block makes up a block of its own. With carry, all columns of docs but the text travel along."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block_id", pa.int64()), ("n_docs", pa.int32()), ("raw_len", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("data", pa.binary()), ("rest", pa.binary())])
        for block in local_blocks(batches, block_bytes):
            block.block_id += TaskContext.get().partitionId() << 32
            yield batch(schema, [block.row()])

    carried = [F.col(c) if c != text_col else F.lit(None).cast("string").alias(c) for c in docs.columns] if carry else []
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *([F.struct(*carried).alias("rest")] if carry else [])).mapInArrow(pack, BLOCK_SCHEMA)
    return partitioned_checkpoint(packed.repartition(partitions(spark), "block_id"))


def partitioned_checkpoint(df: DataFrame) -> DataFrame:
    """df checkpointed, known to be partitioned as it is: an adaptive plan would forget that, and each later cogroup would
    shuffle the rows again."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        conf.set(name, before)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def raw_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("raw_len"), F.lit(0))).first()[0]


class Buckets:
    """How keys are dealt out: by ranges of their leading bits. The number of buckets follows the input, so a bucket
    holds about per_bucket keys at any size. bits: how much of a key is sent; where keys only select candidates, that is
    enough for a false candidate in about a thousand keys, else all 64."""

    def __init__(self, spark: SparkSession, n_keys: int, exact: bool, per_bucket: int = 2_000_000):
        self.bits = 64 if exact else min(64, max(32, int(n_keys).bit_length() + 10))
        self.n = max(4 * partitions(spark), -(-n_keys // per_bucket))

    def cut(self, keys: np.ndarray) -> np.ndarray:
        return keys >> U64(64 - self.bits) if self.bits < 64 else keys

    def split(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of sorted keys that were cut. Takes as long as there are keys, however many buckets."""
        if len(keys):
            b = np.minimum((keys.astype(np.float64) * (self.n / 2.0**self.bits)).astype(np.int64), self.n - 1)
            cut = np.flatnonzero(b[1:] != b[:-1]) + 1
            yield from zip(b[np.concatenate([[0], cut])].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(keys)])


def narrow(a: np.ndarray) -> bytes:
    """Whole numbers as the least of them, a width, and that many bytes for what each is above it."""
    a = a.astype("<u8", copy=False)
    least = a.min() if len(a) else U64(0)
    a = np.ascontiguousarray(a - least)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return least.tobytes() + bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    width = b[8]
    out[:, :width] = np.frombuffer(b, np.uint8, n * width, 9).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(U64, copy=False) + np.frombuffer(b, "<u8", 1)[0]


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; the first is sorted and kept as differences."""
    n = len(arrays[0])
    first = arrays[0].astype(U64, copy=False)
    parts = [narrow(np.diff(first, prepend=U64(0))), *(narrow(a) for a in arrays[1:])]
    return n.to_bytes(8, "little") + b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_arrays(b: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(b[:8], "little"), 8, []
    while at < len(b):
        size = int.from_bytes(b[at : at + 8], "little")
        out.append(widen(b[at + 8 : at + 8 + size], n))
        at += 8 + size
    out[0] = np.cumsum(out[0], dtype=U64)
    return out


KEY_ARROW = pa.schema([("bucket", pa.int64()), ("block_id", pa.int64()), ("blob", pa.binary())])
ANSWER_ARROW = pa.schema([("block_id", pa.int64()), ("blob", pa.binary())])


def send(block_id: int, buckets: Buckets, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """Rows of KEY_SCHEMA for sorted distinct keys that were cut, and a value array or more."""
    return batch(KEY_ARROW, [(i, block_id, pack_arrays(keys[a:b], *(v[a:b] for v in values))) for i, a, b in buckets.split(keys)])


def distinct_counts(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and 2 for those in two or more documents of the block, else 1. doc ascends with the place."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    o = np.argsort(keys, kind="stable")
    k, d = keys[o], doc[o]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    last = np.concatenate([first[1:], [len(k)]]) - 1
    return k[first], 1 + (d[first] != d[last])


def map_blocks(blocks: DataFrame, f: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for block in blocks_in(b):
                yield from f(block)

    return blocks.mapInArrow(run, schema)


def answer_blocks(blocks: DataFrame, answers: DataFrame, f: Callable[[Block, list[bytes]], pa.Table], schema) -> DataFrame:
    """f of each block and of the answers that it got, if any."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = right.column("blob").to_pylist()
        return pa.concat_tables(f(b, got) for b in blocks_in(left))

    return blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(run, schema)


def count_answers(sent: DataFrame, least: int = 2) -> DataFrame:
    """Sums each key's counts over all blocks, and answers each block with its keys of at least ``least`` in all, with
    their sums."""

    def run(t: pa.Table) -> pa.Table:
        got = [(r["block_id"], *unpack_arrays(r["blob"])) for r in rows_of(t)]
        keys = np.concatenate([x[1] for x in got])
        total, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([x[2] for x in got])).astype(np.int64)
        all_sums, rows, i = sums[at], [], 0
        for block_id, k, _ in got:
            s = all_sums[i : i + len(k)]
            i += len(k)
            if (hit := s >= least).any():
                rows.append((block_id, pack_arrays(k[hit], s[hit])))
        return pa.Table.from_batches([batch(ANSWER_ARROW, rows)])

    return sent.groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA)


def merged(answers: list[bytes]) -> list[np.ndarray]:
    """Answers of a block's buckets as arrays, sorted by key."""
    if not answers:
        return [np.zeros(0, U64), np.zeros(0, U64)]
    parts = [np.concatenate(x) for x in zip(*map(unpack_arrays, answers))]
    o = np.argsort(parts[0])
    return [p[o] for p in parts]


def among(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in found, which is sorted, and its place there."""
    if not len(found):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return found[at] == keys, at
