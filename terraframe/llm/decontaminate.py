"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words (runs of digits, letters and non-ASCII characters, A-Z in lower case) and indexed in one
suffix automaton. Each document streams through it; the automaton keeps the longest suffix that is a part of some item.
Where it reaches ``window`` words, or all words of an item that has fewer, these words are hit. A word that no item has
resets the automaton, so only stretches of known words as long as the shortest window are streamed word by word.

The automaton is built on the driver and broadcast, about ``MAX_WORDS`` item words at a time: more items are dealt by
their hash over several automata, each of which takes its own pass over the documents and is dropped before the next one
is built; a column carries the passes' hits and items. So neither the driver nor a broadcast holds more, however many items.

Defined results: null and empty texts have no words; items without words count for nothing; items with
a null id hit words and count as one item without a name; repeated items count once. A null doc_id stays null. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import _blocks as B
from terraframe.llm._session import table
from terraframe.model import checkpointed

WINDOW = 10
#: Item words in one automaton.
MAX_WORDS = 200_000
#: Items are read in this many characters at a time at most, by which the number of automata is chosen.
CHARS_PER_WORD = 6
#: A document with more than this share of its words hit goes as a whole.
MAX_COVERAGE = 0.5
#: Texts that are scanned together.
STEP = 256
EARLIER = "struct<items:array<string>,hits:binary>"
RESULT = "doc_id long, n_words long, n_hit long, items array<string>, hits binary"


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences, with the items of each state."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items: list[set[str]] = [set() for _ in self.link]
        self.whole: list[list[tuple[int, str]]] = [[] for _ in self.link]
        for name, words in items:
            state = 0
            for w in words:
                state = u = self.next[state][w]
                while u > 0 and name not in self.items[u]:
                    self.items[u].add(name)
                    u = self.link[u]
            if 0 < len(words) < window:
                self.whole[state].append((len(words), name))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.whole[state] = self.whole[state] + self.whole[self.link[state]]

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, transitions: dict[int, int]) -> int:
        self.next.append(transitions)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, each as long as a window, and the items that they are of."""
        spans, names, state, size = [], set(), 0, 0
        step, link, length, window = self.next, self.link, self.length, self.window
        for i, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                size = length[state]
            state = step[state].get(w, 0)
            size = size + 1 if state else 0
            if size >= window:
                u = state
                while length[link[u]] >= window:
                    u = link[u]
                names |= self.items[u]
                spans.append((i + 1 - window, i + 1))
            for n, name in self.whole[state]:
                if n <= size:
                    names.add(name)
                    spans.append((i + 1 - n, i + 1))
        return spans, names


def build(items: list[tuple[str, str]], window: int) -> tuple[np.ndarray, SuffixAutomaton, int]:
    """Sorted hashes of the items' words, the automaton of their ranks, and the shortest window."""
    block = B.Block.of(np.arange(len(items)), [t.encode() for _, t in items])
    _, _, h, doc = block.words(B.NON_ALNUM, lower=True)
    vocabulary, rank = np.unique(h, return_inverse=True)
    bounds = np.searchsorted(doc, np.arange(len(items) + 1))
    words = [(items[i][0], rank[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(items))]
    words = [x for x in words if x[1]]
    return vocabulary, SuffixAutomaton(words, window), min([window, *(len(w) for _, w in words)])


def find(block: B.Block, vocabulary: np.ndarray, automaton: SuffixAutomaton, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """Starts, ends and documents of the block's words, which of them are hit, and each document's items."""
    s, e, h, doc = block.words(B.NON_ALNUM, lower=True)
    known, rank = B.among(h, vocabulary)
    cut = np.ones(len(h) + 1, bool)
    cut[1:-1] = (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])
    edge = np.flatnonzero(cut)
    begin, end = edge[:-1], edge[1:]
    ok = (end - begin >= least) & known[begin] if len(h) else np.zeros(0, bool)
    at, size, names = [], [], [set() for _ in block.ids]
    for a, b in zip(begin[ok].tolist(), end[ok].tolist()):
        spans, found = automaton.stream(rank[a:b].tolist())
        if spans:
            names[doc[a]] |= found
            at += [a + x for x, _ in spans]
            size += [y - x for x, y in spans]
    return s, e, doc, B.cover(np.array(at, np.int64), np.array(size, np.int64), len(h)), names


def by_name(name: str | None) -> tuple:
    """Sorts names, a null one last."""
    return name is None, name or ""


def automata(items: DataFrame, id_col: str, text_col: str, window: int, max_words: int) -> tuple[int, Iterator[tuple]]:
    """How many automata the items take, and the automata, each built when it is asked for."""
    own = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // (max_words * CHARS_PER_WORD)))
    part = lambda i: own if n == 1 else own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
    return n, (build(sorted({(r["id"], r["text"]) for r in part(i).collect()}, key=lambda x: (by_name(x[0]), x[1])), window) for i in range(n))


def united(block: B.Block, automaton: tuple, earlier: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]], np.ndarray]:
    """Starts and ends of the block's words, which of them are hit in this or an earlier pass, each document's items, and
    the place of its first word."""
    s, e, doc, hit, names = find(block, *automaton)
    bounds = np.searchsorted(doc, np.arange(len(block.ids) + 1))
    for i, x in enumerate(earlier or ()):
        if x and x["hits"]:
            own = hit[bounds[i] : bounds[i + 1]]
            own |= np.unpackbits(np.frombuffer(x["hits"], np.uint8), count=len(own)).view(bool)
            names[i] |= set(x["items"])
    return s, e, hit, names, bounds


def packed(hit: np.ndarray, names: list[set[str]], bounds: np.ndarray) -> tuple[np.ndarray, list[list[str]], list[bytes]]:
    """Of each document: the number of words hit, its items, and a bit per word."""
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])
    return n_hit, [sorted(x, key=by_name) for x in names], [np.packbits(hit[a:b]).tobytes() if n else b"" for a, b, n in zip(bounds[:-1], bounds[1:], n_hit)]


def blocks_of(texts: list) -> Iterator[tuple[int, B.Block]]:
    """Blocks of STEP texts, with the place of their first."""
    for first in range(0, len(texts), STEP):
        own = texts[first : first + STEP]
        yield first, B.Block.of(np.arange(first, first + len(own)), [t.encode() if isinstance(t, str) else t for t in own])


def passes(df: DataFrame, text_col: str, n: int, built: Iterator[tuple]) -> tuple[DataFrame, str | None, Broadcast]:
    """df after a pass of each automaton but the last, the column of their hits and items (None without any), and the last
    automaton, broadcast. Each pass is written to the shared folder before its automaton is dropped and the next one is built,
    so one is held at a time, whatever the number of items."""
    sc = df.sparkSession.sparkContext
    if n == 1:
        return df, None, sc.broadcast(next(built))
    mark = B.free_name(df, "_earlier")
    df = df.withColumn(mark, F.lit(None).cast(EARLIER))
    at, last = df.columns.index(text_col), len(df.columns) - 1
    kind = pa.struct([("items", pa.list_(pa.string())), ("hits", pa.binary())])
    for _ in range(n - 1):
        shared = sc.broadcast(next(built))

        def run(batches, shared=shared):
            for b in batches:
                before, out = b.column(last).to_pylist(), []
                for first, block in blocks_of(b.column(at).to_pylist()):
                    _, _, hit, names, bounds = united(block, shared.value, before[first : first + STEP])
                    out += [{"items": x, "hits": y} for x, y in zip(*packed(hit, names, bounds)[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(out, kind)], names=b.schema.names)

        df = checkpointed(df.mapInArrow(run, df.schema))
        shared.destroy()
    return df, mark, sc.broadcast(next(built))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """RESULT with one row for each row of docs: n_hit words of n_words are hit, of the items; hits has a bit per word."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    own, mark, shared = passes(own, "text", *automata(items, item_id_col, item_text_col, window, max_words))

    def run(batches):
        for block in B.local_blocks(batches):
            _, _, hit, names, bounds = united(block, shared.value, mark and block.rest.to_pylist())
            n_hit, found, bits = packed(hit, names, bounds)
            yield pa.RecordBatch.from_arrays([block.out_ids(), pa.array(np.diff(bounds), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(bits, pa.binary())], names=["doc_id", "n_words", "n_hit", "items", "hits"])

    if mark:  # a struct that is never null itself
        own = own.select("doc_id", "text", F.struct(f"{mark}.items", f"{mark}.hits").alias(mark))
    return own.mapInArrow(run, RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """docs without the documents of which more than max_coverage of the words are hit; in the others, each run of hit
    words is cut out of the text. All other columns, and texts without hits, stay as they are."""
    schema, at = docs.schema, docs.columns.index(text_col)
    docs, mark, shared = passes(docs, text_col, *automata(items, item_id_col, item_text_col, window, max_words))
    width = len(schema)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            earlier = b.column(width).to_pylist() if mark else []
            gone = np.zeros(len(texts), bool)
            for first, block in blocks_of(texts):
                s, e, hit, _, bounds = united(block, shared.value, earlier[first : first + STEP])
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])
                for i in np.flatnonzero(n_hit).tolist():
                    mine = hit[bounds[i] : bounds[i + 1]]
                    if n_hit[i] > max_coverage * len(mine):
                        gone[first + i] = True
                        continue
                    d = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
                    cuts = zip(s[bounds[i] + np.flatnonzero(d == 1)].tolist(), e[bounds[i] + np.flatnonzero(d == -1) - 1].tolist())
                    left, out = int(block.off[i]), []
                    for x, y in cuts:
                        out.append(block.raw[left:x])
                        left = y
                    texts[first + i] = b"".join([*out, block.raw[left : block.off[i] + block.lens[i]]]).decode()
            columns = [pa.array(texts, b.schema.field(i).type) if i == at else c for i, c in enumerate(b.columns[:width])]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:width]).filter(pa.array(~gone))

    return docs.mapInArrow(run, schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT DISTINCT doc_id, i, u.n, array_to_string(w[i:i + u.n - 1], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) p, (SELECT DISTINCT n FROM v) u WHERE i + u.n - 1 <= len(w)),
m AS (SELECT o.doc_id, o.i, o.n, v.item_id FROM o JOIN v ON o.k = v.k AND o.n = v.n),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, range(0, 10) AS r(j) WHERE j < m.n GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
