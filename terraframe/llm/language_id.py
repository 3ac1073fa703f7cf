"""Language identification with a bidirectional gated recurrent network over bytes.

The network is small (``HIDDEN`` units each way, hard sigmoid and hard tanh gates) and trained here, in numpy, by
backpropagation through time with Adam; it learns from windows of at most ``SAMPLE_CHARS`` characters of at most
``SAMPLE_DOCS`` documents of each language, picked by a hash of their ids: the bound of what the driver gets, at any
number of documents; all languages are learned. It labels every byte position with language probabilities. A document's probabilities are the mean over all
positions of its whole text, read in stretches of ``STRETCH`` bytes side by side; a long text only has more of them.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing to
learn from. A null doc_id counts as an empty one for the fold. Rows with a null language are predicted, not learned from.
Equal texts get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm._session import table

HIDDEN, STRETCH, LANES = 8, 128, 4096
SAMPLE_DOCS, SAMPLE_CHARS = 256, 2048
STEPS, BATCH, LENGTH, RATE = 300, 96, 48, 0.02
FOLDS, HELD_OUT = 3, 1
SCHEMA = "doc_id long, lang_pred string, score double"


class ByteGru:
    """Weights of both directions (input tables, recurrent matrices) and of the output."""

    def __init__(self, languages: list[str], seed: int = 7):
        self.languages = languages
        rng, h = np.random.default_rng(seed), HIDDEN
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = [{"x": normal(256, 3 * h, scale=0.4), "u": normal(h, 3 * h, scale=0.3)} for _ in range(2)]
        self.out = normal(2 * h, len(languages), scale=0.3)
        self.bias = np.zeros(len(languages), np.float32)

    def _run(self, w: dict, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, lane, unit) after each byte of x (time, lane)."""
        h = HIDDEN
        states = np.zeros((len(x) + 1, x.shape[1], h), np.float32)
        for t in range(len(x)):
            before = states[t]
            a, u = w["x"][x[t]], before @ w["u"]
            gates = a[:, : 2 * h] + u[:, : 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            new = a[:, 2 * h :] + r * u[:, 2 * h :]
            np.clip(new, -1, 1, out=new)
            np.multiply(z, before - new, out=states[t + 1])
            states[t + 1] += new
            if keep is not None:
                keep.append((gates, u[:, 2 * h :], new))
        return states

    def logits(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(time, lane, language), and the states of both directions side by side."""
        forward = self._run(self.w[0], x, keep and keep[0])
        backward = self._run(self.w[1], x[::-1], keep and keep[1])
        both = np.concatenate([forward[1:], backward[1:][::-1]], axis=2)
        return both @ self.out + self.bias, (both, forward, backward)

    def _back(self, w: dict, x: np.ndarray, states: np.ndarray, kept: list, d_states: np.ndarray) -> dict:
        """Gradients by backpropagation through time."""
        h = HIDDEN
        d_u, d_a = np.zeros_like(w["u"]), np.empty((len(x), x.shape[1], 3 * h), np.float32)
        carry = np.zeros_like(states[0])
        for t in range(len(x) - 1, -1, -1):
            gates, un, new = kept[t]
            z, r, before = gates[:, :h], gates[:, h:], states[t]
            d = d_states[t] + carry
            dn = d * (1 - z) * (np.abs(new) < 1)
            open_ = 0.25 * ((gates > 0) & (gates < 1))
            dz, dr = d * (before - new) * open_[:, :h], dn * un * open_[:, h:]
            d_hidden = np.concatenate([dz, dr, dn * r], axis=1)
            d_a[t] = np.concatenate([dz, dr, dn], axis=1)
            d_u += before.T @ d_hidden
            carry = d * z + d_hidden @ w["u"].T
        d_x = np.zeros_like(w["x"])
        np.add.at(d_x, x.reshape(-1), d_a.reshape(-1, 3 * h))
        return {"x": d_x, "u": d_u}

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        keep: tuple[list, list] = ([], [])
        logits, (both, forward, backward) = self.logits(x, keep)
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        lanes = np.arange(len(label))
        loss = float(-np.log(p[:, lanes, label] + 1e-9).mean())
        p[:, lanes, label] -= 1
        p /= p.shape[0] * p.shape[1]
        d_both = p @ self.out.T
        one = self._back(self.w[0], x, forward, keep[0], d_both[:, :, :HIDDEN])
        two = self._back(self.w[1], x[::-1], backward, keep[1], d_both[::-1, :, HIDDEN:])
        return loss, [one["x"], one["u"], two["x"], two["u"], both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, p.shape[2]), p.sum(axis=(0, 1))]

    def parameters(self) -> list[np.ndarray]:
        return [self.w[0]["x"], self.w[0]["u"], self.w[1]["x"], self.w[1]["u"], self.out, self.bias]

    def train(self, samples: list[list[np.ndarray]], steps: int = STEPS, seed: int = 11) -> float:
        """samples: byte arrays of each language. Returns the last loss."""
        rng, params = np.random.default_rng(seed), self.parameters()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        loss = 0.0
        for step in range(1, steps + 1):
            label = rng.integers(len(samples), size=BATCH)
            x = np.full((LENGTH, BATCH), 32, np.uint8)
            for i, k in enumerate(label):
                s = samples[k][rng.integers(len(samples[k]))]
                at = rng.integers(max(1, len(s) - LENGTH + 1))
                part = s[at : at + LENGTH]
                x[: len(part), i] = part
            loss, grads = self.gradients(x, label)
            rate = RATE * (1 - step / (steps + 1))
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def label(self, texts: list[bytes]) -> np.ndarray:
        """Mean language probabilities over all positions of each text."""
        lens = np.array([len(t) for t in texts], np.int64)
        n = -(-lens // STRETCH)
        doc = np.repeat(np.arange(len(texts)), n)
        sums = np.zeros((len(texts), len(self.languages)))
        buf = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(lens) - lens
        start = np.repeat(begin - (np.cumsum(n) - n) * STRETCH, n) + np.arange(len(doc)) * STRETCH
        size = np.minimum(STRETCH, np.repeat(begin + lens, n) - start)
        order = np.argsort(-size, kind="stable")  # stretches of a length together
        for a in range(0, len(order), LANES):
            o = order[a : a + LANES]
            longest = int(size[o[0]])
            t = np.arange(longest)[:, None]
            inside = t < size[o]
            x = np.where(inside, buf[np.minimum(start[o] + t, len(buf) - 1)], np.uint8(32))
            logits, _ = self.logits(x)
            logits -= logits.max(axis=2, keepdims=True)
            p = np.exp(logits, out=logits)
            p *= (inside / p.sum(axis=2))[:, :, None]
            np.add.at(sums, doc[o], p.sum(axis=0))
        return sums / np.maximum(lens, 1)[:, None]


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteGru | None:
    """The network, learned from the rows of docs that have a language and some text; None if there are none."""
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.broadcast(docs.sparkSession.createDataFrame([(lang, 1.5 * SAMPLE_DOCS / n) for lang, n in counts.items()], "lang string, share double"))
    h = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 30))
    window = F.expr(f"substring(text, cast(pmod(xxhash64(id, 1), greatest(length(text) - {SAMPLE_CHARS}, 1)) as int) + 1, {SAMPLE_CHARS})")
    picked = own.join(share, "lang").withColumn("h", h).where(F.col("h") < F.col("share") * (1 << 30)).select("lang", "h", "id", window.alias("text"))
    samples: dict[str, list] = {lang: [] for lang in sorted(counts)}
    for r in sorted(picked.collect(), key=lambda r: (r["h"], r["id"] or "", r["text"] or "")):
        if r["text"] and len(samples[r["lang"]]) < SAMPLE_DOCS:
            samples[r["lang"]].append(np.frombuffer(r["text"].encode(), np.uint8))
    samples = {k: v for k, v in samples.items() if v}
    if not samples:
        return None
    net = ByteGru(list(samples))
    net.train(list(samples.values()))
    return net


def predict(docs: DataFrame, net: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                use = [i for i, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if use:
                    p = net.label([texts[i].encode() for i in use])
                    for i, k, s in zip(use, p.argmax(axis=1), p.max(axis=1)):
                        lang[i], score[i] = net.languages[k], min(1.0, float(s))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
