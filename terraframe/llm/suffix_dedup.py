"""Substring dedup over bytes with a logarithmic family of suffix arrays.

Each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is removed.

The suffixes are sharded by content, so that equal strings meet without a shuffle of every suffix: a string's route is
the least hash of its ``GRAM``-byte substrings. Neighbouring strings mostly share a route, so a run of them travels as
one piece of text, about four bytes a string. Routes of one document only are dropped first, by an exchange of the
routes alone. Routes that very many documents hold are split once more, by where in the string the least hash stands.

Each shard keeps an index family (``SuffixFamily``): its pieces come in the order of document ids, in batches; a batch
gets its suffix array (places in the shard's text, sorted by the ``length`` bytes that follow, eight at a time), is
merge-scanned against the existing levels for strings that they have, and enters as a new level; levels of equal size
merge geometrically. Levels hold places, not strings. So a string is found
repeated exactly if a smaller document has it. A shard's size is bounded by the number of shards, which follows the
input.

Defined results: a null or empty text has no bytes. A null doc_id counts as larger than every other; rows of one doc_id
don't remove each other's bytes. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import _blocks as B
from terraframe.llm._session import table

LENGTH = 50
GRAM = 20
#: A route held by so many blocks' documents in all is split by position as well.
HOT = 1000
#: Strings in a batch, and batches of a shard at most (a larger shard has larger batches).
BATCH, BATCHES = 1 << 15, 8
#: Text of a block: the larger, the fewer rows go to the shards.
BLOCK_BYTES = 2 << 20
#: Strings of a shard, about: a shard in work takes some 120 bytes for each.
SHARD = 2_000_000
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
U64 = np.uint64


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the gram (9 to 24) bytes from each place."""
    n = len(buf) - gram + 1
    load = lambda at: np.ndarray((n,), dtype="<u8", buffer=buf, offset=at, strides=(1,))
    h = load(0) * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(32)
    if gram > 16:
        h += load(8)
        h *= U64(0xC2B2AE3D27D4EB4F)
        h ^= h >> U64(29)
    h += load(gram - 8)
    h *= U64(0x165667B19E3779F9)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def sliding_least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each size values in a row."""
    m, width = h, 1
    while 2 * width <= size:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    return m if width == size else np.minimum(m[: len(h) - size + 1], m[size - width :])


def runs(block: B.Block, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings, route and document of each run of neighbouring strings of one document and route."""
    none = np.zeros(0, np.int64)
    if len(block.buf) < length:
        return none, none, none.astype(U64), none
    least = sliding_least(gram_hashes(block.buf, gram), length - gram + 1)
    doc = np.flatnonzero(block.lens >= length)
    if not len(doc):
        return none, none, none.astype(U64), none
    begin, end = block.off[doc], block.off[doc] + block.lens[doc] - length + 1
    inside = np.zeros(len(least) + 1, np.int8)
    inside[begin] = 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    cut = np.empty(len(least), bool)
    cut[0] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:])
    cut[begin] = True
    start = np.flatnonzero(cut & inside)
    stops = np.flatnonzero(np.concatenate([cut | ~inside, [True]]))
    stop = stops[np.searchsorted(stops, start, side="right")]
    # least hashes crowd at the low end; buckets are ranges, so routes are spread again
    return start, stop - start, B.mix(least[start]), np.searchsorted(block.off, start, side="right") - 1


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number; of numbers, the order is that of the bytes."""
    return np.ndarray((max(0, len(data) - 7),), dtype=">u8", buffer=data, strides=(1,))


def refine(data: np.ndarray, pos: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of places that are sorted by their first eight bytes (key) by all ``length`` bytes, ties as they stand; and
    whether each, in that order, differs from the one before. Only groups in which bytes differ are sorted again."""
    words, order = words_at(data), np.arange(len(pos))
    new = np.ones(len(pos), bool)
    new[1:] = key[1:] != key[:-1]
    for off in [*range(8, length - 8, 8), length - 8]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        k = words[pos[order[at]] + off].astype(U64)
        group = np.cumsum(new[at])
        differs = np.zeros(len(at), bool)
        differs[1:] = (k[1:] != k[:-1]) & (group[1:] == group[:-1])
        if not differs.any():
            continue
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[differs]] = True
        part = np.flatnonzero(mixed[group])
        o = part[np.lexsort((k[part], group[part]))]
        order[at[part]] = order[at[o]]
        k[part] = k[o]  # groups stay where they stand
        new[at[1:]] |= (k[1:] != k[:-1]) & (group[1:] == group[:-1])
    return order, new


class SuffixFamily:
    """Suffix arrays of distinct strings of a text, as places and their first eight bytes, in levels of geometrically growing
    size."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.data, self.length = data, length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def array(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array of places, ties as they stand, and which of its entries differ from the ones before."""
        key = words_at(self.data)[pos].astype(U64)
        sa = np.argsort(key, kind="stable")
        order, new = refine(self.data, pos[sa], key[sa], self.length)
        return sa[order], new

    def merge(self, a: tuple, b: tuple) -> tuple[tuple, np.ndarray]:
        """Both levels in one, without duplicates, and whether each string of b is in a as well."""
        key = np.concatenate([a[1], b[1]])
        run = np.argsort(key, kind="stable")  # two sorted runs: a linear merge
        pos = np.concatenate([a[0], b[0]])[run]
        order, new = refine(self.data, pos, key[run], self.length)
        found = np.zeros(len(b[0]), bool)
        again = run[order[~new]]
        found[again - len(a[0])] = True
        stay = order[new]
        return (pos[stay], key[run][stay]), found

    def scan(self, level: tuple) -> np.ndarray:
        """Whether each string of the level is in some level of the family."""
        found = np.zeros(len(level[0]), bool)
        for own in self.levels:
            found |= self.merge(own, level)[1]
        return found

    def insert(self, level: tuple) -> None:
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = self.merge(self.levels.pop(), level)[0]
        self.levels.append(level)


def batches_of(order: np.ndarray, doc: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces in the order of document ids, cut between documents into batches."""
    size = max(BATCH, -(-int(count.sum()) // BATCHES))
    at = 0
    total = np.cumsum(count[order])
    while at < len(order):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + size)) + 1
        while end < len(order) and doc[order[end]] == doc[order[end - 1]]:
            end += 1
        yield order[at:end]
        at = end


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... count times for each pair."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


def scan_shard(data: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each string of the pieces, in their order, whether a smaller document has it."""
    family, flags = SuffixFamily(data, length), np.zeros(int(count.sum()), bool)
    at_flag = np.cumsum(count) - count
    order = np.argsort(doc, kind="stable")
    words = words_at(data)
    for piece in batches_of(order, doc, count):
        pos = expand(first[piece], count[piece])
        sa, new = family.array(pos)  # ties stay in the order of documents
        ids = np.repeat(doc[piece], count[piece])[sa]
        group = np.cumsum(new) - 1
        level = pos[sa[new]], words[pos[sa[new]]].astype(U64)
        seen = family.scan(level)
        flags[expand(at_flag[piece], count[piece])[sa]] = seen[group] | (ids > ids[new][group])
        family.insert((level[0][~seen], level[1][~seen]))
    return flags


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true flags."""
    d = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    start = np.flatnonzero(d == 1)
    return start, np.flatnonzero(d == -1) - start


def flag_answers(sent: DataFrame, length: int) -> DataFrame:
    """Answers each block with the starts and lengths of the runs of repeated strings."""

    def run(t: pa.Table) -> pa.Table:
        heads, texts, blocks = [], [], []
        for r in B.rows_of(t):
            size = int.from_bytes(r["blob"][:8], "little")
            heads.append(B.unpack_arrays(r["blob"][8 : 8 + size]))
            texts.append(pa.decompress(r["blob"][16 + size :], int.from_bytes(r["blob"][8 + size : 16 + size], "little"), "zstd", asbytes=True))
            blocks.append(r["block_id"])
        start, count, doc = (np.concatenate(x) for x in zip(*heads))
        count = count.astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        long = count + length - 1
        flags = scan_shard(data, np.cumsum(long) - long, count, doc, length)
        at, rows = 0, []
        place, piece = 0, 0
        for block_id, head in zip(blocks, heads):
            n = int(head[1].sum())
            if (own := flags[place : place + n]).any():
                where = np.flatnonzero(own)
                s = expand(head[0].astype(np.int64), head[1].astype(np.int64))[where]
                cut = np.flatnonzero(np.concatenate([[True], np.diff(s) != 1]))
                rows.append((block_id, B.pack_arrays(s[cut], np.diff(np.concatenate([cut, [len(s)]])))))
            place += n
        return pa.Table.from_batches([B.batch(B.ANSWER_ARROW, rows)])

    return sent.groupBy("bucket").applyInArrow(run, B.ANSWER_SCHEMA)


def pieces(block: B.Block, answers: list[bytes], buckets: B.Buckets, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs whose route two or more documents hold: start, count, route, document; hot ones in single strings. And
    which of them repeat a piece of a smaller document of this block, with the place of the first copy's own."""
    start, count, route, doc = runs(block, length, gram)
    found, total = B.merged(answers)[:2]
    hit, at = B.among(buckets.cut(route), found)
    start, count, route, doc, total = start[hit], count[hit], route[hit], doc[hit], total[at[hit]] if len(found) else np.zeros(0)
    hot = total >= HOT
    if hot.any():
        single = expand(start[hot], count[hot])
        n = count[hot]
        grams = gram_hashes(block.buf, gram)
        offset = np.zeros(len(single), np.int64)
        value, left = np.repeat(route[hot], n), np.ones(len(single), bool)
        for o in range(length - gram + 1):
            here = left & (B.mix(grams[single + o]) == value)
            offset[here] = o
            left &= ~here
        start = np.concatenate([start[~hot], single])
        count = np.concatenate([count[~hot], np.ones(len(single), np.int64)])
        doc = np.concatenate([doc[~hot], np.repeat(doc[hot], n)])
        route = np.concatenate([route[~hot], B.mix(value + (offset + 1).astype(U64) * U64(0x9E3779B97F4A7C15))])
    ids = _order(block)[doc]
    key = B.span_hashes(block.buf, start, start + count + length - 1)
    o = np.lexsort((start, ids, key))
    first = np.concatenate([[True], key[o][1:] != key[o][:-1]]) if len(o) else np.zeros(0, bool)
    later = np.zeros(len(o), bool)
    later[o] = ids[o] > ids[o][first][np.cumsum(first) - 1] if len(o) else False
    same = np.zeros(len(o), np.int64)
    if len(o):
        same[o] = o[first][np.cumsum(first) - 1]
    return start, count, route, ids, later, same, first, o


def _order(block: B.Block) -> np.ndarray:
    return block.ids.view(U64) ^ U64(1 << 63)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that stay, for each row of docs."""
    blocks = B.text_blocks(docs, id_col, text_col, block_bytes=BLOCK_BYTES)
    raw = B.raw_bytes(blocks)
    spark = docs.sparkSession
    near = B.Buckets(spark, raw // 16, False)
    shards = B.Buckets(spark, raw // 2, True, per_bucket=SHARD)

    def send_routes(block):
        _, _, route, doc = runs(block, length, gram)
        keys, count = _doc_counts(near.cut(route), doc)
        yield B.send(block.block_id, near, keys, count)

    repeated = B.count_answers(B.map_blocks(blocks, send_routes, B.KEY_SCHEMA)).checkpoint()

    def send_pieces(block, answers):
        start, count, route, ids, _, _, first, o = pieces(block, answers, near, length, gram)
        o = o[first]
        o = o[np.argsort(route[o], kind="stable")]
        rows = []
        for bucket, a, b in shards.split(route[o]):
            p = np.sort(o[a:b])
            p = p[np.argsort(start[p], kind="stable")]
            head = B.pack_arrays(start[p], count[p], ids[p])
            text = b"".join([block.raw[x:y] for x, y in zip(start[p].tolist(), (start[p] + count[p] + length - 1).tolist())])
            rows.append((bucket, block.block_id, len(head).to_bytes(8, "little") + head + len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)))
        return pa.Table.from_batches([B.batch(B.KEY_ARROW, rows)])

    flagged = flag_answers(B.answer_blocks(blocks, repeated, send_pieces, B.KEY_SCHEMA), length)
    both = repeated.withColumn("blob", F.concat(F.lit(b"\x00"), "blob")).unionByName(flagged.withColumn("blob", F.concat(F.lit(b"\x01"), "blob")))

    def remove(block, answers):
        start, count, _, _, later, same, _, _ = pieces(block, [a[1:] for a in answers if a[0] == 0], near, length, gram)
        hit = np.zeros(len(block.buf) + 1, bool)  # strings that start here and that a smaller document has
        for a in answers:
            if a[0] == 1:
                s, n = B.unpack_arrays(a[1:])
                hit[expand(s.astype(np.int64), n.astype(np.int64))] = True
        copies = same != np.arange(len(same))
        hit[expand(start[copies], count[copies])] = hit[expand(start[same[copies]], count[copies])]
        hit[expand(start[later], count[later])] = True
        s, n = spans_of(hit)
        gone = B.cover(s, n + length - 1, len(block.buf))
        ids, n_bytes, removed, n_spans, kept = block.out_ids(), block.lens, [], [], []
        for a, b in zip(block.off[:-1].tolist(), (block.off[:-1] + block.lens).tolist()):
            g = gone[a:b]
            n_gone = int(g.sum())
            removed.append(n_gone)
            n_spans.append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()) if n_gone else 0)
            kept.append(block.buf[a:b][~g].tobytes() if n_gone else block.raw[a:b])
        return pa.table({"doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return B.answer_blocks(blocks, both, remove, RESULT)


def _doc_counts(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and in how many of the block's documents each is."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    o = np.lexsort((doc, keys))
    k, d = keys[o], doc[o]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.flatnonzero(new)
    other = new | np.concatenate([[True], d[1:] != d[:-1]])
    return k[first], np.add.reduceat(other.astype(np.int64), first)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM t WHERE length(x) >= 100)),
m AS (SELECT k, min(doc_id) AS first_id FROM s GROUP BY k),
f AS (SELECT s.doc_id, s.i, lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS before FROM s JOIN m USING (k) WHERE m.first_id < s.doc_id),
e AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM e GROUP BY doc_id, g),
q AS (SELECT r.doc_id, g, a, b, lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a) AS c FROM r),
d AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS z,
             string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS y FROM q JOIN t USING (doc_id) GROUP BY q.doc_id)
SELECT t.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN z IS NULL THEN x ELSE y || substr(x, 2 * z + 1) END)) AS kept_sha256
FROM t LEFT JOIN d USING (doc_id)
"""
