"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its n-grams; the filters are bit-sliced: one table
whose entries are bit masks of languages, so looking an n-gram up in all languages is a
few table reads joined by AND. Per-language popcounts over a text's n-grams, corrected
for the false positives that each filter's filling implies, decide.

Learning counts n-grams over a bounded sample of each language's labelled documents (SAMPLE,
by a hash of the id) and keeps those that make up at least LEAST_SHARE of a language's (so at
most 1 / LEAST_SHARE of them) and are not far more typical of another. Predictions see nothing but the text.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HALF_SLICE, filter_slices, map_slices, materialise, pick

#: Documents of a language learned from, least share of a language's n-grams, characters of an n-gram.
SAMPLE, LEAST_SHARE, N = 8000, 2e-5, 4
#: Entries of the table (a power of two) and reads of a lookup.
TABLE_BITS, READS = 19, 3
#: An n-gram enters a language's filter if it is at least this share as frequent there as
#: where it is most frequent.
TYPICAL = 0.25
UNDETERMINED = "und"

_LETTER: np.ndarray | None = None


def letters(cps: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter (category L)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)), bool, 0x10000)
    out = _LETTER[np.minimum(cps, 0xFFFF)]
    high = cps > 0xFFFF
    if high.any():
        out[high] = [unicodedata.category(chr(c))[0] == "L" for c in cps[high].tolist()]
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the lower-cased texts, each one's text, and which texts have
    letters. Anything but letters counts as one blank; blanks surround each text."""
    sizes = np.empty(len(texts), np.int64)
    parts = []
    for i, t in enumerate(texts):
        low = f" {(t or '').lower()}{' ' * N}"
        parts.append(low)
        sizes[i] = len(low)
    cps = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = letters(cps)
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank of a run
    keep[np.cumsum(sizes) - sizes] = True
    for k in range(2, N):
        keep[np.cumsum(sizes) - k] |= has  # so that each letter begins an n-gram
    cps, owner, letter = np.where(letter, cps, 32)[keep], owner[keep], letter[keep]
    n = len(cps) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    h = np.zeros(n, np.uint64)
    some = np.zeros(n, bool)
    for k in range(N):
        h = h * np.uint64(0x100000001B3) + cps[k : k + n].astype(np.uint64)
        some |= letter[k : k + n]
    some &= owner[:n] == owner[N - 1 :]
    h = h[some]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, owner[:n][some], has


def _places(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th table place of each hash."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.uint64(k) * step) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    """Languages in order, and the bit-sliced table: one row of masks for each 64 languages."""

    languages: list[str]
    table: np.ndarray

    def __post_init__(self):
        fill = [((self.table[j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(self.languages))]
        self.false_positive = np.array(fill) ** READS

    @staticmethod
    def build(chosen: dict[str, np.ndarray]) -> Model:
        languages = sorted(chosen)
        table = np.zeros((max(1, -(-len(languages) // 64)), 1 << TABLE_BITS), np.uint64)
        for j, language in enumerate(languages):
            for k in range(READS):
                table[j // 64, np.unique(_places(chosen[language], k))] |= np.uint64(1 << j % 64)
        return Model(languages, table)

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the corrected share of n-grams that its filter holds,
        and which texts have letters."""
        h, owner, has = grams(texts)
        total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        places = [_places(h, k) for k in range(READS)]
        out = np.zeros((len(texts), len(self.languages)))
        for row in range(len(self.table)):
            mask = self.table[row][places[0]]
            for p in places[1:]:
                mask &= self.table[row][p]
            for j in range(row * 64, min(len(self.languages), row * 64 + 64)):
                hit = (mask >> np.uint64(j % 64)) & np.uint64(1)
                out[:, j] = np.bincount(owner, weights=hit.astype(np.float64), minlength=len(texts)) / total
        wrong = self.false_positive
        return np.clip((out - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1), has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share; ties go to the first language by name."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        shares, has = self.shares(texts)
        best = shares.argmax(1)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), has)]
        return names, np.where(has, shares.max(1), 0.0)


def held_out(id: Column) -> Column:
    """Whether a document is not learned from; one with a null id never is."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(True))


def _sampled(rows: DataFrame, sample: int) -> DataFrame:
    """At most `sample` rows of each lang: those with the smallest hashes of doc_id (rows that
    repeat the last of these ids come along). Only hashes are shuffled, no text, and only those
    of small value are sorted: about 1.5 times `sample`, and 100, of a lang."""
    hashed = rows.withColumn("_h", F.xxhash64("doc_id"))
    ids = hashed.groupBy("lang").agg(F.approx_count_distinct("_h").alias("ids"))
    place = F.col("_h") / F.lit(2.0**64) + 0.5
    small = hashed.select("lang", "_h").join(F.broadcast(ids), "lang").where(place * F.col("ids") <= 1.5 * sample + 100)
    small = small.groupBy("lang", "_h").count()
    before = F.sum("count").over(Window.partitionBy("lang").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1))
    cuts = small.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < sample)
    cuts = cuts.groupBy("lang").agg(F.max("_h").alias("cut"))
    return hashed.join(F.broadcast(cuts), "lang").where("_h <= cut").drop("_h", "cut")


def fit(docs: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", sample: int = SAMPLE, least: float = LEAST_SHARE) -> Model:
    """Learn from at most `sample` documents of each language that are not held out.
    The driver gets at most 1 / least n-grams of each language."""
    rows = pick(docs, id, text, lang).toDF("doc_id", "text", "lang")
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = _sampled(rows, sample).select("text", "lang")

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        names, codes = np.unique(np.array(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
        h, owner, _ = grams(part.column(0).to_pylist())
        out = []
        for j, name in enumerate(names):
            gram, n = np.unique(h[codes[owner] == j], return_counts=True)
            out.append((np.full(len(gram), name, object), gram.view(np.int64), n))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1]), pa.array(cols[2].astype(np.int64))], ["lang", "gram", "n"])

    counts = map_slices(picked, "text", count, "lang string, gram long, n long", HALF_SLICE).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "langid")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(total, "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= least)
    peaks = shares.groupBy("gram").agg(F.max("share").alias("peak"))
    typical = shares.join(peaks, "gram").where(F.col("share") >= TYPICAL * F.col("peak")).select("lang", "gram")
    chosen: dict[str, list[int]] = {r.lang: [] for r in total.select("lang").collect()}
    for r in typical.collect():
        chosen[r.lang].append(r.gram)
    return Model.build({name: np.array(found, np.int64).view(np.uint64) for name, found in chosen.items()})


def predict(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row. Null texts and texts without a
    letter are `und` with score 0; repeated rows come out as often as they came in."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        names, share = held.value.predict(part.column(2).to_pylist())
        return pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(share)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = pick(docs, id, text).toDF("doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_slices(rows, "text", work, "doc_id long, held_out boolean, lang_pred string, score double", HALF_SLICE)


def accepted(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows, all columns kept, whose text has a language with a share of `least` at least.

    Null texts, empty ones and those without a letter go; repeated rows stay or go together;
    other columns may have any names and nulls; an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array) -> np.ndarray:
        names, share = held.value.predict(texts.to_pylist())
        return (np.array(names, object) != UNDETERMINED) & (share >= least)

    return filter_slices(docs, text, keep, HALF_SLICE)
