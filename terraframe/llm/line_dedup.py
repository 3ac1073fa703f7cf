"""Line dedup with two Bloom filters.

Each block of documents sends the hashes of its distinct lines to the shard that owns them. The shard streams them
through two Bloom filters, of lines seen once and of lines seen again; no line list is kept or sorted. Only lines that
the second filter holds, which are suspected repeats, are sent on, with a second, cryptographic digest (128 bits in all) and
their number of documents, for confirmation and the choice of the first occurrence. A false positive of a filter costs
one such row and never changes a result. Filters are sized for the shard's lines, and the number of shards follows the input.

A line's key is the line without white space at both ends, A-Z in lower case. Keys found in ``min_docs`` documents or
more lose their lines: all of them with ``keep="none"``, all but the first line in the document with the smallest id with
``keep="first"``.

Defined results: a null or empty text is one empty line. Keys under ``min_chars`` code points are never dropped. Lines
that repeat inside one document only count once for it. A null doc_id sorts last; rows of one doc_id are as many
documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import _blocks as B
from terraframe.llm._session import table

U64 = np.uint64
MIN_DOCS, MIN_CHARS = 10, 1
#: Bits for each line, and hash functions: about one false positive in a hundred lines.
BITS, HASHES = 10, 5
RESULT = "doc_id long, n_lines long, n_dropped long, kept string"


class Bloom:
    """Bloom filter of 64-bit hashes."""

    def __init__(self, n: int):
        self.size = U64(max(64, n * BITS))
        self.bits = np.zeros(int(self.size), dtype=bool)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        step = B.mix(keys ^ U64(0xD6E8FEB86659FD93)) | U64(1)
        return ((keys[:, None] + step[:, None] * np.arange(HASHES, dtype=U64)) >> U64(3)) % self.size

    def add(self, keys: np.ndarray) -> None:
        self.bits[self._at(keys)] = True

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[self._at(keys)].all(axis=1)


def lines_of(block: B.Block) -> tuple[np.ndarray, ...]:
    """Of each line: start, end, document, 64-bit hash of its key, the key's code points, start and end. Texts end in a line
    feed in a block, so its line feeds end the lines of all documents."""
    end = np.flatnonzero(block.buf == 10)
    start = np.concatenate([np.zeros(1, np.int64), end[:-1] + 1]) if len(end) else end
    s, e = B.words_of(block.buf, B.SPACE)
    a, b = np.searchsorted(s, start), np.searchsorted(s, end)
    full = b > a
    s, e = np.append(s, 0), np.append(e, 0)
    left, right = np.where(full, s[a], 0), np.where(full, e[b - 1], 0)
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((block.buf & 0xC0) != 0x80)])
    return start, end, np.searchsorted(block.off, start, side="right") - 1, B.span_hashes(B.LOWER[block.buf], left, right), points[right] - points[left], left, right


def digests(block: B.Block, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic digest of each key's bytes; with the other hash, what tells keys apart."""
    raw = block.raw.lower()  # of bytes: A-Z only
    got = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(left.tolist(), right.tolist())])
    return np.frombuffer(got, "<u8").astype(U64)


def distinct(block: B.Block, at: np.ndarray, doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lines ``at``, with their documents and key columns: the place in ``at`` of each distinct key's first line, by the
    documents' ids, its number of documents and that least id; sorted by key."""
    ids = block.ids[doc].view(U64) ^ U64(1 << 63)
    o = np.lexsort((at, ids, *keys[::-1]))
    new = np.ones(len(o), bool)
    new[1:] = np.any([k[o][1:] != k[o][:-1] for k in keys], axis=0) if len(o) else False
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[o][1:] != doc[o][:-1]  # rows of one id stand by place, so a document's lines stand together
    count = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return o[first], count, ids[o[first]]


def suspects(sent: DataFrame) -> DataFrame:
    """Answers each block with those of its keys that the twice-seen filter of their shard holds."""

    def run(t: pa.Table) -> pa.Table:
        got = [(r["block_id"], *B.unpack_arrays(r["blob"])) for r in B.rows_of(t)]
        n = sum(len(x[1]) for x in got)
        once, twice = Bloom(n), Bloom(n)
        for _, keys, count in got:
            twice.add(keys[once.has(keys) | (count > 1)])
            once.add(keys)
        rows = [(block_id, B.pack_arrays(hit)) for block_id, keys, _ in got if len(hit := keys[twice.has(keys)])]
        return pa.Table.from_batches([B.batch(B.ANSWER_ARROW, rows)])

    return sent.groupBy("bucket").applyInArrow(run, B.ANSWER_SCHEMA)


def confirmed(sent: DataFrame, min_docs: int) -> DataFrame:
    """Answers each block with its keys that min_docs documents or more hold: both hashes, and 1 if the block has the
    first line of all."""

    def run(t: pa.Table) -> pa.Table:
        got = [(r["block_id"], *B.unpack_arrays(r["blob"])) for r in B.rows_of(t)]
        key, second, count, ids = (np.concatenate([x[i] for x in got]) for i in (1, 2, 3, 4))
        block = np.repeat(np.array([x[0] for x in got]), [len(x[1]) for x in got])
        o = np.lexsort((block, ids, second, key))
        new = np.ones(len(o), bool)
        new[1:] = (key[o][1:] != key[o][:-1]) | (second[o][1:] != second[o][:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(count[o].astype(np.int64), first)
        hit, lead = np.zeros(len(o), bool), np.zeros(len(o), np.int64)
        hit[o] = (total >= min_docs)[np.cumsum(new) - 1]
        lead[o] = new
        rows, i = [], 0
        for block_id, k, s, _, _ in got:
            h = hit[i : i + len(k)]
            if h.any():
                rows.append((block_id, B.pack_arrays(k[h], s[h], lead[i : i + len(k)][h])))
            i += len(k)
        return pa.Table.from_batches([B.batch(B.ANSWER_ARROW, rows)])

    return sent.groupBy("bucket").applyInArrow(run, B.ANSWER_SCHEMA)


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept, the lines that stay joined by a line feed, for each row of docs."""
    return _dedup(docs, min_docs, min_chars, keep, id_col, text_col, carry=False)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text that stays; rows that had a word but lost all their words go. Other columns stay as they are,
    and so do null texts."""
    return _dedup(docs, min_docs, min_chars, keep, id_col, text_col, carry=True)


def _dedup(docs: DataFrame, min_docs: int, min_chars: int, keep: str, id_col: str, text_col: str, carry: bool) -> DataFrame:
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    mark = B.free_name(docs, "__text_is_null")
    if carry:
        docs = docs.withColumn(mark, F.col(text_col).isNull())
    blocks = B.text_blocks(docs, id_col, text_col, carry)
    buckets = B.Buckets(docs.sparkSession, B.raw_bytes(blocks) // 40, True)

    def send_hashes(block):
        _, _, doc, key, points, _, _ = lines_of(block)
        at = np.flatnonzero(points >= min_chars)
        first, count, _ = distinct(block, at, doc[at], key[at])
        yield B.send(block.block_id, buckets, key[at][first], np.minimum(count, 2))

    suspected = suspects(B.map_blocks(blocks, send_hashes, B.KEY_SCHEMA))

    def suspect_lines(block, hashes):
        """Lines with a hash among these, their documents, hashes and digests."""
        _, _, doc, key, points, left, right = lines_of(block)
        at = np.flatnonzero((points >= min_chars) & B.among(key, hashes)[0])
        return at, doc[at], key[at], digests(block, left[at], right[at])

    def send_keys(block, answers):
        at, doc, key, second = suspect_lines(block, B.merged(answers)[0])
        first, count, ids = distinct(block, at, doc, key, second)
        return pa.Table.from_batches([B.send(block.block_id, buckets, key[first], second[first], count, ids)])

    repeated = confirmed(B.answer_blocks(blocks, suspected, send_keys, B.KEY_SCHEMA), min_docs)

    def drop(block, answers):
        start, end, doc = lines_of(block)[:3]
        gone = np.zeros(len(start), bool)
        if answers:
            k, s, lead = B.merged(answers)
            known = {pair: bool(x) for *pair, x in zip(k.tolist(), s.tolist(), lead.tolist()) for pair in [tuple(pair)]}
            at, docs_at, key, second = suspect_lines(block, k)
            hit = [known.get(pair) for pair in zip(key.tolist(), second.tolist())]
            gone[at] = [x is not None for x in hit]
            if keep == "first":
                first, _, _ = distinct(block, at, docs_at, key, second)
                gone[at[[i for i in first.tolist() if hit[i]]].astype(np.int64)] = False
        raw, kept, dropped, n = block.raw, [], [], []
        bounds = np.searchsorted(doc, np.arange(len(block.ids) + 1)).tolist()
        start, end = start.tolist(), end.tolist()
        for i in range(len(block.ids)):
            a, b = bounds[i], bounds[i + 1]
            g = int(gone[a:b].sum())
            n.append(b - a)
            dropped.append(g)
            kept.append(block.text(i) if not g else b"\n".join([raw[start[j] : end[j]] for j in range(a, b) if not gone[j]]))
        if carry:
            null = block.rest.column(mark).to_pylist()
            stay = np.array([not g or bool(t.strip(b" \t\n\x0b\x0c\r")) for g, t in zip(dropped, kept)], bool)
            out = block.carried(None, text_col, [None if x else t for x, t in zip(null, kept)])
            return out.drop_columns([mark]).filter(pa.array(stay))
        return pa.table({"doc_id": block.out_ids(), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return B.answer_blocks(blocks, repeated, drop, docs.drop(mark).schema if carry else RESULT)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, i, x[i] AS line, lower_key AS k FROM (
    SELECT doc_id, x, i, translate(regexp_replace(x[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)))),
h AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN h USING (k) GROUP BY doc_id
"""
