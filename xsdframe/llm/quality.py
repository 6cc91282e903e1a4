"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded; gated
attention, learned from document labels only, weighs the passages; the weighted passage
representation is scored. So a document can be bad for one bad passage, and labels need
not say which.

    h = relu(W x + b),  a = softmax over passages of u . (tanh(V h) * sigmoid(G h)),
    score = sigmoid(c . sum(a h) + d)

Passages are runs of PASSAGE bytes. Their features are shares of character kinds, of
hashed byte pairs and of repeated words, all by array operations over whole slices.
Learning uses at most SAMPLE labelled documents that are not held out, by a hash of the
id, and at most PASSAGES of their passages; the fit is deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HALF_SLICE, filter_slices, map_slices, materialise, pick, scratch
from .langid import held_out

#: Labelled documents learned from, bytes of a passage, hidden units, attention units.
SAMPLE, PASSAGE, HIDDEN, GATE = 6000, 512, 32, 16
#: Passages learned from, in all.
PASSAGES = 1 << 17
#: Features: kinds of characters, hashed byte pairs, word statistics.
KINDS, PAIRS, WORDS = 40, 64, 4
WIDTH = KINDS + PAIRS + WORDS
#: Least score that counts as good.
THRESHOLD = 0.3
EPOCHS, BATCH, STEP, DECAY, SEED = 30, 64, 5e-3, 1e-4, 11


def _kinds() -> np.ndarray:
    """Kind of each byte: lower, upper, digit, blank, line end, other control, not ASCII, or
    one of the 32 marks."""
    out = np.full(256, 6, np.int64)
    out[:128] = 5
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[ord(" ")], out[ord("\n")] = 3, 4
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = 7 + np.arange(len(marks))
    return out


_KIND = _kinds()
_MARKS = np.random.default_rng(SEED).integers(1, 1 << 62, 256, np.int64).astype(np.uint64)


def passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows of WIDTH), and how many passages each text has: one at
    least, also for null and empty texts, whose one passage is all zero."""
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    count = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(count) - count
    total = int(count.sum())
    data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    n = len(data)
    if not n:
        return np.zeros((total, WIDTH), np.float32), count
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    passage = first[owner] + (np.arange(n) - begin[owner]) // PASSAGE
    held = np.maximum(np.bincount(passage, minlength=total), 1)[:, None]
    kinds = np.bincount(passage * KINDS + _KIND[data], minlength=total * KINDS).reshape(total, KINDS)
    pair = (data[:-1].astype(np.int64) * 31 + data[1:].astype(np.int64) * 17) % 8191 % PAIRS
    within = owner[1:] == owner[:-1]  # both bytes are of one text
    pairs = np.bincount((passage[:-1] * PAIRS + pair)[within], minlength=total * PAIRS).reshape(total, PAIRS)

    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~blank
    starts[1:] &= blank[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(starts)
    words = np.zeros((total, WORDS))
    if len(at):
        run = np.zeros(n, np.int64)
        run[at] = 1
        place = np.arange(n) - at[np.maximum(np.cumsum(run) - 1, 0)]
        place = place.astype(np.uint64)
        mixed = np.where(blank, np.uint64(0), _MARKS[data] * (2 * place * place + np.uint64(1)))  # not linear, so abba is not baab
        code = np.add.reduceat(mixed, at)
        of = passage[at]
        number = np.maximum(np.bincount(of, minlength=total), 1)
        same = np.zeros(len(at), bool)
        same[1:] = (code[1:] == code[:-1]) & (owner[at[1:]] == owner[at[:-1]])
        order = np.lexsort((code, of))
        fresh = np.ones(len(at), bool)
        fresh[1:] = (code[order][1:] != code[order][:-1]) | (of[order][1:] != of[order][:-1])
        length = np.bincount(passage[~blank], minlength=total) / number
        words[:, 0] = np.bincount(of, same, total) / number
        words[:, 1] = np.bincount(of[order], fresh, total) / number
        words[:, 2] = np.log1p(length)
        words[:, 3] = np.log1p(np.bincount(of, minlength=total))
    return np.hstack([np.sqrt(kinds / held), np.sqrt(pairs / held), words]).astype(np.float32), count


@dataclass
class Model:
    """Scaling of the features and the weights, by name."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for passages in a row, `count` of them for each document."""
        w = self.weights
        first = np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        pre = x @ w["W"] + w["b"]
        h = np.maximum(pre, 0)
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["G"])
        s = (t * g) @ w["u"]
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"bag": bag, "first": first, "pre": pre, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def scores(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, count)["p"] if len(count) else np.zeros(0)

    def gradient(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by backpropagation through the attention."""
        w, f = self.weights, self.forward(x, count)
        bag, h, a = f["bag"], f["h"], f["a"]
        dp = (f["p"] - y) / len(y)
        dz = dp[:, None] * w["c"]
        da = (dz[bag] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, f["first"])[bag])
        dtg = ds[:, None] * w["u"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["G"].T
        dpre = dh * (f["pre"] > 0)
        return {
            "W": x.T @ dpre, "b": dpre.sum(0), "V": h.T @ dt, "G": h.T @ dg, "u": (f["t"] * f["g"]).T @ ds,
            "c": f["z"].T @ dp, "d": dp.sum(),
        }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(x: np.ndarray, count: np.ndarray, y: np.ndarray) -> Model:
    """Fit by Adam over shuffled batches of documents. Without both labels, every score is
    the one label's, or one half without any."""
    rng = np.random.default_rng(SEED)
    init = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
    weights = {
        "W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "G": init(HIDDEN, GATE),
        "u": np.zeros(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(()),
    }
    model = Model(np.zeros(WIDTH), np.ones(WIDTH), weights)
    if len(y):
        model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 0.02)
        share = (y.sum() + 0.5) / (len(y) + 1)
        weights["d"] = np.array(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    x = (x - model.mean) / model.scale
    first = np.cumsum(count) - count
    m, v, k = {n: np.zeros_like(w) for n, w in weights.items()}, {n: np.zeros_like(w) for n, w in weights.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = STEP * (1 - epoch / EPOCHS)
        for b in range(0, len(y), BATCH):
            docs = order[b : b + BATCH]
            n = count[docs]
            rows = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            k += 1
            for name, d in model.gradient(x[rows], n, y[docs]).items():
                d = d + DECAY * weights[name]
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.999 * v[name] + 0.001 * d * d
                weights[name] = weights[name] - rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)
    return model


def chosen(docs: DataFrame, labels: DataFrame, text: str, id: str, label: str, sample: int, most: int) -> DataFrame:
    """(doc_id, h, y, place): the labelled documents to learn from, told by id and hash of the
    text, in the order of their ids' hashes: `sample` of them at most, and no more than have
    `most` passages together. Repeated rows count once. Only ids and sizes are gathered."""
    marks = pick(labels, id, label).toDF("doc_id", "y").where(F.col("y").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = pick(docs, id, text).toDF("doc_id", "text").where(F.col("text").isNotNull())
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).alias("size")
    found = rows.join(F.broadcast(marks), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "y", size).distinct()  # `sample` short rows are broadcast
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y"), F.col("h")]
    found = found.where(F.col("size") <= most // 8).orderBy(*order).limit(sample)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over `sample` short rows
    found = found.select("doc_id", "h", "y", F.row_number().over(Window.orderBy(*order)).alias("place"), F.sum("size").over(before).alias("together"))
    return found.where(F.col("together") <= most).drop("together")


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", sample: int = SAMPLE, most: int = PASSAGES
) -> Model:
    """Learn from at most `sample` labelled documents that are not held out, with at most
    `most` passages together (and an eighth of that each); null labels and texts are left
    out. The driver gets those passages' features only, whatever the length of texts."""
    spark = docs.sparkSession
    with scratch(spark):
        picked = materialise(chosen(docs, labels, text, id, label, sample, most), "quality")
        rows = pick(docs, id, text).toDF("doc_id", "text").where(F.col("text").isNotNull())
        rows = rows.join(F.broadcast(picked), "doc_id").where(F.xxhash64("text") == F.col("h"))
        rows = rows.select(F.col("text").cast("binary").alias("text"), F.col("y").cast("double").alias("y"), "place")

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            x, count = passages(part.column(0).to_pylist())
            ends = np.cumsum(count)
            held = [x[a:b].astype(np.float16).tobytes() for a, b in zip(ends - count, ends)]
            return pa.record_batch([pa.array(held, pa.binary()), part.column(1), part.column(2)], ["x", "y", "place"])

        found = map_slices(rows, "text", work, "x binary, y double, place int", HALF_SLICE)
        found = sorted(found.groupBy("place").agg(F.first("x").alias("x"), F.first("y").alias("y")).collect(), key=lambda r: r.place)
    bags = [np.frombuffer(bytes(r.x), np.float16).astype(np.float32).reshape(-1, WIDTH) for r in found]
    x = np.vstack(bags) if bags else np.zeros((0, WIDTH), np.float32)
    return learn(x, np.array([len(b) for b in bags], np.int64), np.array([float(r.y > 0) for r in found]))


def predict(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, empty and null texts included
    (their one passage is all zero). Equal texts have equal scores, up to rounding."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        score = held.value.scores(*passages(part.column(2).to_pylist()))
        predicted = pa.array((score >= threshold).astype(np.int32))
        return pa.record_batch([part.column(0), part.column(1), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    rows = pick(docs, id, text).toDF("doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return map_slices(rows, "text", work, "doc_id long, held_out boolean, score double, predicted int", HALF_SLICE)


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns kept, whose text scores `threshold` at least.

    Null and empty texts are scored as one passage of zeros, so all of them stay or all go;
    so do repeated rows; other columns may have any names and nulls; an empty table gives an
    empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array) -> np.ndarray:
        return held.value.scores(*passages(texts.cast(pa.binary()).to_pylist())) >= threshold

    return filter_slices(docs, text, keep, HALF_SLICE)
