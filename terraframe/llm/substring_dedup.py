"""Substring dedup over words with difference-cover anchors.

Windows of ``window`` words that also start in a document with a smaller id are removed. Hashes are taken only at word
positions whose remainder modulo ``PERIOD`` is in ``COVER``, a difference cover: for any two positions there is a shift
below PERIOD that brings both onto the cover. So two equal windows always share an aligned anchor of
``window - PERIOD + 1`` words. Anchors of one document only end there; around those of two or more, each window that
holds the anchor is extended to its full length and its hash compared.

Defined results: a null or empty text has no words. A null doc_id counts as larger than every other; rows of one
doc_id don't remove each other's words. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import _blocks as B
from terraframe.llm._session import table

WINDOW = 13
#: A perfect difference set: every difference modulo 7 is one between two of its members.
PERIOD, COVER = 7, (1, 2, 4)

RESULT = "doc_id long, n_words long, n_removed long, kept string"


def anchors(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and documents of the anchors: positions count from each document's first word."""
    at, key = B.windows(h, doc, size)
    first = np.searchsorted(doc, np.arange(doc[-1] + 1 if len(doc) else 0))
    on = np.isin((at - first[doc[at]]) % PERIOD, COVER)
    return at[on], key[on], doc[at[on]]


def candidates(block: B.Block, h: np.ndarray, doc: np.ndarray, answers: list[bytes], buckets: B.Buckets, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and full hashes of the windows that hold an anchor of two or more documents."""
    at, key, _ = anchors(h, doc, window - PERIOD + 1)
    found, _ = B.merged(answers)[:2]
    at = at[B.among(buckets.cut(key), found)[0]]
    start = np.unique((at[:, None] - np.arange(PERIOD)).ravel())
    start = start[(start >= 0) & (start + window <= len(h))]
    start = start[doc[start] == doc[start + window - 1]]
    return start, B.span_hashes(h, start, start + window)


def smaller_answers(sent: DataFrame) -> DataFrame:
    """Answers each block with its windows that start in a smaller document elsewhere, or that two documents of its own
    have: 1 in the first case."""

    def run(t: pa.Table) -> pa.Table:
        got = [(r["block_id"], *B.unpack_arrays(r["blob"])) for r in B.rows_of(t)]
        keys, least = np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got])
        o = np.lexsort((least, keys))
        k = keys[o]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        lowest = np.empty_like(least)
        lowest[o] = least[o][first][np.cumsum(first) - 1]
        rows, i = [], 0
        for block_id, k, own in got:
            low = lowest[i : i + len(k)] < own
            i += len(k)
            if low.any():
                rows.append((block_id, B.pack_arrays(k[low], np.ones(int(low.sum()), np.int64))))
        return pa.Table.from_batches([B.batch(B.ANSWER_ARROW, rows)])

    return sent.groupBy("bucket").applyInArrow(run, B.ANSWER_SCHEMA)


def order_of(ids: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the order of the ids, negative ones included."""
    return (ids.view(np.uint64) ^ np.uint64(1 << 63)).view(np.uint64)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay joined by one space, for each row of docs."""
    spark = docs.sparkSession
    blocks = B.text_blocks(docs, id_col, text_col)
    n_words = B.raw_bytes(blocks) // 5
    near, exact = B.Buckets(spark, n_words * len(COVER) // PERIOD, False), B.Buckets(spark, n_words, True)
    size = window - PERIOD + 1

    def send_anchors(block):
        _, _, h, doc = block.words()
        _, key, d = anchors(h, doc, size)
        keys, count = B.distinct_counts(near.cut(key), d)
        yield B.send(block.block_id, near, keys, count)

    repeated = B.count_answers(B.map_blocks(blocks, send_anchors, B.KEY_SCHEMA)).checkpoint()

    def send_windows(block, answers):
        _, _, h, doc = block.words()
        start, key = candidates(block, h, doc, answers, near, window)
        ids = order_of(block.ids)[doc[start]]
        o = np.lexsort((ids, key))
        key, ids = key[o], ids[o]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        return pa.Table.from_batches([B.send(block.block_id, exact, key[first], ids[first])])

    later = smaller_answers(B.answer_blocks(blocks, repeated, send_windows, B.KEY_SCHEMA))
    both = repeated.withColumn("blob", F.concat(F.lit(b"\x00"), "blob")).unionByName(later.withColumn("blob", F.concat(F.lit(b"\x01"), "blob")))

    def remove(block, answers):
        s, e, h, doc = block.words()
        start, key = candidates(block, h, doc, [a[1:] for a in answers if a[0] == 0], near, window)
        ids = order_of(block.ids)[doc[start]]
        gone = B.among(key, B.merged([a[1:] for a in answers if a[0] == 1])[0])[0]
        if len(key):  # and those that a smaller document of this block has
            o = np.lexsort((ids, key))
            first = np.concatenate([[True], key[o][1:] != key[o][:-1]])
            gone[o] |= ids[o] > ids[o][first][np.cumsum(first) - 1]
        hit = B.cover(start[gone], window, len(h))
        bounds = np.searchsorted(doc, np.arange(len(block.ids) + 1)).tolist()
        total, removed, kept, raw = [], [], [], block.raw
        s, e, stay = s.tolist(), e.tolist(), ~hit
        for i in range(len(block.ids)):
            a, b = bounds[i], bounds[i + 1]
            at = np.flatnonzero(stay[a:b]) + a
            total.append(b - a)
            removed.append(b - a - len(at))
            kept.append(b" ".join([raw[s[j] : e[j]] for j in at.tolist()]))
        return pa.table({"doc_id": block.out_ids(), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return B.answer_blocks(blocks, both, remove, RESULT)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS first_id FROM g GROUP BY k),
hit AS (SELECT DISTINCT g.doc_id, g.i + o.j AS i FROM g JOIN m USING (k), range(0, 13) AS o(j) WHERE m.first_id < g.doc_id),
gone AS (SELECT doc_id, count(*) AS n, list(i) AS places FROM hit GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i))), ' ') END) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)
"""
