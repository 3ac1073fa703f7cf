"""SentencePiece encoding and decoding with a shared-prefix Viterbi.

A batch's texts are split into marked words (U+2581 for each space, then the word); no piece crosses from a word into the
next mark, which is checked when the model is read. The distinct words are sorted, which puts them in the order of a
depth-first walk of their trie: each word keeps the forward states of the prefix that it shares with the one before, and
only the characters after it are scored. So every trie node is scored once, however many words lead through it. Runs of
characters that no longer piece has, such as line feeds, are words of their own. The pieces that may end at a character are
found by walking the trie of the reversed pieces.

The forward state of a prefix is that of its best segmentation:

* unigram models: the best sum of scores, and the last piece of the segmentation that has it (Viterbi);
* BPE models: merging is no sum of scores, but it has the same structure. A prefix's BPE segmentation ends in exactly one
  piece, namely the one that may stand behind the segmentation of what is left: a pair of pieces may stand side by side if
  merging their joint text gives this pair again. So the state is the last piece, and admissible pairs take the place of
  scores; the result equals merging by rank.

Characters without a piece become byte pieces, or the unknown piece if the model has none. The model comes from the
caller's file, is read once on the driver and broadcast (its size is fixed; it is refused above ``MAX_MODEL_BYTES``).

Defined results: a null or empty text has no ids and decodes to an empty one. Long texts are encoded whole; equal rows get
equal results, each its own; empty tables give empty results; columns other than id and text are ignored, whatever their
names. A word takes some 20 bytes of memory a character while it is segmented. Decoding gives
the text back, but for U+2581 itself, which decodes to a space, and without the pieces for unknown characters.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm._session import table

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 1 << 26
#: Bytes of words, of their ids and of Python's objects for both that a worker keeps between batches, about.
CACHE = 48 << 20
#: What an entry of that cache takes besides its characters and ids.
ENTRY = 190
#: Pairs of pieces of which a worker knows whether they may stand side by side.
PAIRS = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SCHEMA = "doc_id long, ids array<int>, decoded string"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A SentencePiece model file: pieces, scores, and how texts are split."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.prefix, squeeze, charmap = UNIGRAM, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                got = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                self.pieces.append(got[1].decode())
                self.scores.append(struct.unpack("<f", got[2])[0])
                self.kinds.append(got[3])
            elif number == 2:
                self.model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                got = dict(_fields(value))
                self.prefix, squeeze, charmap = bool(got.get(3, 1)), bool(got.get(4, 1)), got.get(2, b"")
        if self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if squeeze or charmap:
            raise ValueError("only models that leave texts as they are (identity, no removal of white space) are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a mark behind a word: texts can't be split at words")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        # characters of no longer piece stand for themselves; runs of them are words of their own, so there are fewer words
        joined = set(chain.from_iterable(p for p in self.ids if len(p) > 1))
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined) if self.bytes else ""
        self.word = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]+" if alone else ""))
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.low = min(self.scores, default=0.0) - 10.0
        self._known = 0
        self._whole: frozenset[str] | None = None
        self._backward: dict | None = None
        self._surface: tuple | None = None
        self.rank = {p: self.scores[i] for p, i in self.ids.items()}

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored pair is merged first, of equals the leftmost."""
        parts, rank = list(text), self.rank
        pairs = [rank.get(x + y, -math.inf) for x, y in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > -math.inf:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rank.get(parts[k - 1] + parts[k], -math.inf)
            if k < len(pairs):
                pairs[k] = rank.get(parts[k] + parts[k + 1], -math.inf)
        return parts

    def whole(self) -> frozenset[str]:
        """The pieces that merging their own text gives; no other can be in a BPE segmentation. Found once."""
        if self._whole is None:
            self._whole = frozenset(p for p in self.ids if len(p) == 1 or self.merge(p) == [p])
        return self._whole

    def _beside(self, a: str, b: str, fits: dict[str, bool]) -> bool:
        self._known += 1
        got = fits[a] = self.merge(a + b) == [a, b]
        return got

    def backward(self) -> dict:
        """The trie of the reversed pieces of two characters or more that can be in a segmentation: a node is its children,
        its piece if it has one, and the pieces known to fit before that or not to. Built once, and when it knows too many."""
        if self._backward is None or self._known > PAIRS:
            self._backward, self._known = {}, 0
            for piece in self.whole() if self.model_type == BPE else self.ids:
                if len(piece) > 1:
                    children, node = self._backward, None
                    for c in reversed(piece):
                        node = children.setdefault(c, [{}, None, None])
                        children = node[0]
                    node[1:] = piece, {}
        return self._backward

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) for sorted distinct words, walking their trie depth-first."""
        bpe, ids, scores, root = self.model_type == BPE, self.ids, self.scores, self.backward()
        last: list[str] = [""]  # last piece of each prefix's best segmentation
        total: list[float] = [0.0]
        before = ""
        for word in words:
            n = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                n += 1
            del last[n + 1 :], total[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                start = end - 1
                best = word[start]
                node = root.get(best)
                if bpe:
                    while node is not None and start:
                        start -= 1
                        node = node[0].get(word[start])
                        if node is not None and node[1] is not None:
                            if start:
                                fits = node[2].get(last[start])
                                if not (self._beside(last[start], node[1], node[2]) if fits is None else fits):
                                    continue
                            best = node[1]
                            break
                else:  # the sum in 32 bits, of equals the longest piece, as the library has it
                    value = np.float32(total[start]) + np.float32(scores[ids[best]] if best in ids else self.low)
                    while node is not None and start:
                        start -= 1
                        node = node[0].get(word[start])
                        if node is not None and node[1] is not None:
                            now = np.float32(total[start]) + np.float32(scores[ids[node[1]]])
                            if now >= value:
                                best, value = node[1], now
                    total.append(value)
                last.append(best)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            before = word
            out.reverse()
            yield word, out

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return self.word.findall(MARK + marked if self.prefix else marked)

    def encode(self, texts: list[str], cache: dict[str, bytes]) -> list[list[int]]:
        return [np.frombuffer(x, "<i4").tolist() for x in self.packed(texts, cache)]

    def packed(self, texts: list[str], cache: dict[str, bytes]) -> list[bytes]:
        """Ids of each text, as 32-bit numbers. cache: ids of words, filled for all words of these texts."""
        split = [self.words(t) for t in texts]
        new = sorted(set(chain.from_iterable(split)).difference(cache))
        for word, pieces in self.segment(new):
            cache[word] = array("i", self.to_ids(pieces)).tobytes()
        get = cache.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces' texts, where each begins, and how long it is. Control pieces have no text."""
        if self._surface is None:
            texts = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
            size = np.array([len(t) for t in texts], np.int64)
            self._surface = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size
        return self._surface

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids[offsets[i]:offsets[i + 1]]; bytes in a row are decoded together."""
        buf, first, size = self.surfaces()
        out = []
        for a in range(0, len(offsets) - 1, 64):
            at = offsets[a : a + 65]
            own = ids[at[0] : at[-1]]
            n = size[own]
            end = np.concatenate([[0], np.cumsum(n)])
            raw = buf[np.arange(end[-1]) + np.repeat(first[own] - end[:-1], n)].tobytes()
            bounds = end[at - at[0]].tolist()
            for b, c in zip(bounds, bounds[1:]):
                out.append(raw[b + (self.prefix and raw[b : min(b + 1, c)] == b" ") : c].decode("utf-8", "replace"))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return data


_LOADED: dict[str, PieceModel] = {}


def loaded(data: bytes) -> PieceModel:
    """The model, once in each worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(data)
    return _LOADED[key]


def slices(b: pa.RecordBatch, rows: int = 512, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` rows and, if more than one, about ``size`` bytes of text in the second column."""
    n = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    at = 0
    while at < b.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        stop = min(max(at + 1, stop), at + rows)
        yield b.slice(at, stop - at)
        at = stop


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and decoded, the text that the ids decode to, for each row of docs."""
    data = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        pieces, cache, held = loaded(data.value), {}, 0
        for b in batches:
            for part in slices(b):
                if held > CACHE:
                    cache, held = {}, 0
                before = len(cache)
                ids = pieces.packed([t or "" for t in part.column(1).to_pylist()], cache)
                held += sum(len(w) + len(i) for w, i in islice(cache.items(), before, None)) + ENTRY * (len(cache) - before)
                flat = np.frombuffer(b"".join(ids), "<i4")
                offsets = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in ids])])
                decoded = pieces.decode_all(flat, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))
