"""Quality by attention over passages (multiple-instance learning).

A document is a bag of passages of about PASSAGE_BYTES bytes. Every passage is encoded as a vector:
signed hashing of its words, word shapes and letter trigrams, and a few rates (capitals, digits, marks,
repeats, lengths). A network learns, from labels of whole documents only, an embedding of passages,
gated attention weights (softmax of w . (tanh(V h) * sigmoid(U h))) and the score of the weighted
mean passage. Labels, language, source and id are no inputs.

The network is fitted on the driver from a bounded sample: the SAMPLE labelled documents with
the least hash of their id, all passages of each.
Documents with crc32(id) mod 5 = 0 are held out. Passages are encoded on the executors.

Defined results: a null or empty text is one empty passage and has a score too. Several labels of
one id count by their mean, null labels not at all. Without labels all scores are 0.5; with labels of one class
the network still gives its scores. Repeated rows have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE = 3000
PASSAGE_BYTES = 512
HASHED = 96
RATES = 16
WIDTH, GATE = 24, 16
THRESHOLD = 0.3
EPOCHS = 30
SEED = 11


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of encoded passages, offsets of each text's passages)."""
    mats, counts = [], []
    for first, last in common.chunks(texts):
        m, c = _encoded(texts[first:last])
        mats.append(m)
        counts.append(c)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(mats) if mats else np.zeros((0, HASHED + RATES), np.float32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _sums(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=x, minlength=n)


def _encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, offsets, starts, ends = common.word_hashes(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE_BYTES))
    base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    n = int(base[-1])
    b = np.frombuffer(b"\n".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), lengths + 1)[: len(b)]
    byte_passage = base[doc] + np.minimum((np.arange(len(b)) - begins[doc]) // PASSAGE_BYTES, counts[doc] - 1)
    word_doc = np.searchsorted(offsets, np.arange(len(hashes)), side="right") - 1
    owner = byte_passage[starts] if len(starts) else np.zeros(0, np.int64)
    size = np.maximum(1, ends - starts)
    words = np.maximum(1.0, _sums(np.ones(len(owner)), owner, n))
    upper, lower = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122)
    digit, wide = (b >= 48) & (b <= 57), b >= 128
    mark = (b > 32) & ~(upper | lower | digit | wide)
    total = np.maximum(1.0, np.bincount(byte_passage, minlength=n))
    rates = [np.bincount(byte_passage[x], minlength=n) / total for x in (upper, lower, digit, wide, mark, b == 10)]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    _, one_of = np.unique(hashes ^ common.mix64(owner.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(owner[one_of], minlength=n) / words
    last_byte = b[ends - 1] if len(ends) else b[:0]
    ends_mark = (last_byte > 32) & (last_byte < 128) & ~(((last_byte >= 48) & (last_byte <= 57)) | ((last_byte | 32) >= 97) & ((last_byte | 32) <= 122))
    only_mark = ends_mark & (size == 1)
    rates += [_sums(same, owner, n) / words, distinct, _sums(ends_mark, owner, n) / words, _sums(only_mark, owner, n) / words, _sums(np.minimum(size, 40), owner, n) / words / 10, _sums(size > 20, owner, n) / words, np.log1p(words) / 5]
    caps = np.zeros(len(b) + 1, np.int64)
    np.cumsum(upper, out=caps[1:])
    letters = np.zeros(len(b) + 1, np.int64)
    np.cumsum(upper | lower, out=letters[1:])
    n_caps, n_letters = caps[ends] - caps[starts], letters[ends] - letters[starts]
    rates += [_sums((n_caps > 1) & (n_caps == n_letters), owner, n) / words, _sums((n_caps == 1) & upper[starts] if len(starts) else n_caps, owner, n) / words, np.log1p(np.bincount(byte_passage[mark], minlength=n)) / 5]
    out = np.zeros((n, HASHED + RATES), np.float32)
    for i, r in enumerate(rates):
        out[:, HASHED + i] = r
    # Signed hashing of words and, for shapes, of each word's last three bytes.
    third = HASHED // 2
    for part, h in enumerate((hashes, _tails(b, starts, ends))):
        slot = (h % np.uint64(third)).astype(np.int64) + part * third
        sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        out[:, :HASHED] += np.bincount(owner * HASHED + slot, weights=sign, minlength=n * HASHED).reshape(n, HASHED)
    out[:, :HASHED] /= np.sqrt(words)[:, None]
    return out, counts


def _tails(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the last three bytes of each word, letters by case class only."""
    kind = np.zeros(256, np.uint64)
    kind[33:128] = np.arange(33, 128)
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 1, 2, 3, 4
    h = np.zeros(len(starts), np.uint64)
    for i in (1, 2, 3):
        at = ends - i
        h = h * np.uint64(257) + np.where(at >= starts, kind[b[np.maximum(at, 0)]] if len(b) else h, np.uint64(0)).astype(np.uint64)
    return common.mix64(h + np.uint64(7))


class AttentionMIL:
    """Gated-attention pooling over passages, fitted by Adam."""

    def __init__(self, seed: int = SEED, inputs: int = HASHED + RATES):
        r = np.random.default_rng(seed)
        init = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"E": init(inputs, WIDTH), "e": np.zeros(WIDTH), "V": init(WIDTH, GATE), "U": init(WIDTH, GATE), "w": init(GATE, 1)[:, 0], "c": init(WIDTH, 1)[:, 0], "b": np.zeros(1)}
        self.mean, self.std = np.zeros(inputs), np.ones(inputs)
        self.fitted = False

    def _forward(self, x: np.ndarray, offsets: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        top = np.maximum.reduceat(s, offsets[:-1])
        a = np.exp(s - top[owner])
        a /= np.add.reduceat(a, offsets[:-1])[owner]
        z = np.add.reduceat(a[:, None] * h, offsets[:-1], axis=0)
        logit = z @ p["c"] + p["b"][0]
        return h, t, g, a, owner, z, 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def fit(self, x: np.ndarray, offsets: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4, batch: int = 64) -> AttentionMIL:
        """offsets: of the bags' passages; y: their labels between 0 and 1. Both classes weigh the same."""
        n = len(y)
        if n == 0:
            return self
        self.mean, self.std = x.mean(0), x.std(0) + 0.02
        x = (x - self.mean) / self.std
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y >= 0.5, 0.5 / share, 0.5 / (1 - share))
        r = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(n)
            now = rate * (1 - epoch / epochs) + rate / 20
            for at in range(0, n, batch):
                bags = order[at : at + batch]
                sizes = np.diff(offsets)[bags]
                off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                rows = np.repeat(offsets[bags] - off[:-1], sizes) + np.arange(off[-1])
                xb = x[rows]
                h, t, g, a, owner, z, prob = self._forward(xb, off)
                d = (prob - y[bags]) * weight[bags] / len(bags)
                dz = d[:, None] * self.p["c"]
                dh = a[:, None] * dz[owner]
                da = (h * dz[owner]).sum(1)
                ds = a * (da - np.add.reduceat(a * da, off[:-1])[owner])
                dt, dg = ds[:, None] * self.p["w"] * g * (1 - t * t), ds[:, None] * self.p["w"] * t * g * (1 - g)
                dh += dt @ self.p["V"].T + dg @ self.p["U"].T
                de = dh * (1 - h * h)
                grads = {"E": xb.T @ de, "e": de.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}
                step += 1
                for k, q in grads.items():
                    q = q + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        # The classes weighed the same in the fit; shift the offset back to their shares.
        self.p["b"] = self.p["b"] + np.log(share / (1 - share))
        self.fitted = True
        return self

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.fitted or n == 0:
            return np.full(n, 0.5)
        return self._forward((x - self.mean) / self.std, offsets)[-1]


def held_out(id_column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> AttentionMIL:
    """Fits the network on the `sample` labelled documents (doc_id, text) with the least hash of their id."""
    common.python_ready(docs.sparkSession)
    # At most `sample` rows: the broadcast side has a proven bound.
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("__y"))
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    )
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 64):
                part = frame.iloc[i : i + 64]
                x, off = passages([(t or "").encode() for t in part["text"]])
                out = [x[off[j] : off[j + 1]].astype(np.float32).tobytes() for j in range(len(part))]
                yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["__y"], "x": out})

    rows = bags.mapInPandas(encode, "doc_id long, y double, x binary").collect()  # the passages of `sample` texts at most
    rows.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["x"])))
    if not rows:
        return AttentionMIL()
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, HASHED + RATES) for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    return AttentionMIL().fit(np.concatenate(xs).astype(np.float64), offsets, np.array([r["y"] for r in rows]))


def scored(df: DataFrame, model: AttentionMIL, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df with the score of each whole text."""
    common.python_ready(df.sparkSession)
    keep = common.kept(df.columns if keep is None else keep, [score])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(score, T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [(t or "").encode() for t in frame[text]]
            scores = [model.score(*passages(texts[a:b])) for a, b in common.chunks(texts)]
            yield frame[keep].assign(**{score: np.concatenate(scores) if scores else np.zeros(0)})

    return df.mapInPandas(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    out = scored(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
