"""Operator 6: language identification by the nearest of several centroids per language.

A text's vector: counts of the two- and three-byte grams of its letters, hashed into GRAMS columns, damped by
log(1 + n), weighted by idf and normalised. Each language's sample is split into clusters by spherical k-means. A
text gets the language of the centroid of largest cosine, and is rejected where that cosine is much smaller than
those of the language's texts of such a length that its centroids weren't made from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm import common

GRAMS = 1 << 14
#: Classes of length by powers of two; texts that a bound is drawn from at least; the quantile of their cosines, its share.
CLASSES, ENOUGH, LOW, SHARE = 40, 20, 0.02, 0.4
#: Languages whose counts are broadcast.
BROADCAST_LANGUAGES = 100_000
#: ASCII characters that aren't letters become spaces, A-Z lower case; the bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the grams of the whole text; white space counts as one space, at both ends too."""
    folded = b" " + b" ".join((text or "").encode("utf-8", "ignore").translate(FOLD).split()) + b" "
    a = np.frombuffer(folded, np.uint8).astype(np.uint32)
    two = a[:-1] << np.uint32(8) | a[1:]
    three = two[:-1] << np.uint32(8) | a[2:]
    hashed = (np.concatenate([two | np.uint32(1 << 25), three]) * np.uint32(2654435761)) >> np.uint32(18)
    return np.bincount(hashed, minlength=GRAMS).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """Languages by centroid, centroids weighted by idf, the idf, and the least cosine that isn't rejected: for each
    centroid's language (rows), for texts of so many grams by the power of two (columns)."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """Of texts (rows of counts) with each centroid."""
        x = np.log1p(counts) * self.idf
        return x @ self.centroids.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def rejects(self, counts: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        size = np.log2(np.maximum(1, counts.sum(axis=1))).astype(int).clip(0, self.least.shape[1] - 1)
        return cosines.max(axis=1) < self.least[cosines.argmax(axis=1), size]


def clusters(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit rows: at most k unit centroids, started from drawn rows (not from the
    rows farthest apart, which are texts of several languages)."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) for i in range(len(c)) if (own == i).any()])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def bounds(x: np.ndarray, own: np.ndarray, size: np.ndarray, centroids: int) -> dict[str, np.ndarray]:
    """Least cosine of each language by size class, from texts (unit rows) with centroids of the other half of the sample.

    SHARE of the LOW quantile of the class, or of all the language's texts if that's less: a single text
    counts little but where texts are few. A class of fewer than ENOUGH texts takes in its nearest neighbours until it has as many; those shorter than any reject
    nothing; those longer take the longest one's. No class is stricter than longer ones.
    """
    out = {}
    for lang in np.unique(own):
        rows = np.flatnonzero(own == lang)
        best = np.zeros(len(rows))
        for half in (0, 1):
            rest = rows[np.arange(len(rows)) % 2 != half]
            if len(rest):
                best[half::2] = (x[rows[half::2]] @ clusters(x[rest], centroids).T).max(axis=1)
        least, sizes = np.zeros(CLASSES), size[rows]
        for s in range(sizes.min(), sizes.max() + 1):
            seen = next(f for reach in range(CLASSES) if len(f := best[np.abs(sizes - s) <= reach]) >= min(ENOUGH, len(best)))
            least[s] = SHARE * min(np.quantile(seen, LOW), np.quantile(best, LOW))
        least[sizes.max() :] = least[sizes.max()]
        least = np.minimum.accumulate(least[::-1])[::-1]
        least[: sizes.min()] = 0
        out[lang] = least
    return out


def fit(labelled: DataFrame, sample: int = 300, centroids: int = 4) -> Model | None:
    """From labelled (doc_id, text, lang): about ``sample`` texts of each language, by a hash of doc_id and text, so that
    the same rows always give the same model and no language or source is favoured. None without a usable row.
    """
    usable = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    share = common.written(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGUAGES else share  # else texts would meet by language, a few keys
    drawn = usable.withColumn("drawn", F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)).join(share, "lang").where(F.col("drawn") < sample / F.col("n"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                if has_letter(text.as_py()):
                    counts = gram_counts(text.as_py())
                    grams = np.flatnonzero(counts)
                    for column, value in zip(rows, (lang.as_py(), grams.astype("<i4").tobytes(), counts[grams].astype("<f4").tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "grams", "counts"])

    common.short_batches(labelled.sparkSession)
    rows = drawn.select("lang", "text").mapInArrow(task, "lang string, grams binary, counts binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.grams), bytes(r.counts)))
    counts = np.zeros((len(rows), GRAMS), dtype=np.float32)
    for row, r in zip(counts, rows, strict=True):
        row[np.frombuffer(r.grams, "<i4")] = np.frombuffer(r.counts, "<f4")
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = np.log1p(counts) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.array([r.lang for r in rows])
    made = [(lang, clusters(x[own == lang], centroids)) for lang in np.unique(own)]
    least = bounds(x, own, np.log2(counts.sum(axis=1)).astype(int), centroids)
    languages = [lang for lang, c in made for _ in c]
    return Model(languages, np.concatenate([c for _, c in made]).astype(np.float32), idf, np.stack([least[lang] for lang in languages]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' doc_id and text's prediction: doc_id, lang_pred, score (cosine, 0 to 1), rejected.

    A text that is null or has no letter is "und" with score 0, rejected; without a model all are. Long texts count
    whole. Repeated rows are judged each. Only the text is looked at.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(1).to_pylist()
                letters = np.array([model is not None and has_letter(t) for t in texts])
                names, scores, rejected = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), ~letters
                if letters.any():
                    counts = np.stack([gram_counts(t) for t, ok in zip(texts, letters, strict=True) if ok])
                    cosines = model.cosines(counts)
                    scores[letters] = cosines.max(axis=1).clip(0, 1)
                    names[letters] = np.array(model.languages, dtype=object)[cosines.argmax(axis=1)]
                    rejected[letters] = model.rejects(counts, cosines)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    common.short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows whose text is rejected; all columns stay, in their order."""
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # a name with a dot can't be handed to tasks

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = part.column(at).to_pylist()
                kept = np.array([model is not None and has_letter(t) for t in texts], dtype=bool)
                if kept.any():
                    counts = np.stack([gram_counts(t) for t, ok in zip(texts, kept, strict=True) if ok])
                    kept[kept] = ~model.rejects(counts, model.cosines(counts))
                yield part.filter(pa.array(kept))

    common.short_batches(docs.sparkSession)
    return plain.mapInArrow(task, plain.schema).toDF(*docs.columns)
