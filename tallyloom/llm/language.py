"""Language of a text by the nearest of several centroids per language.

A text is a vector of hashed character n-grams, weighted by TF-IDF and of length 1. Every
language has a few centroids, clustered by cosine. A text farther from all of them than
nearly all texts they were made of is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import id_remainder

BUCKETS = 4096
ORDERS = (1, 2, 3)
CENTROIDS = 4
#: Texts per language (about, by hash of id and text) that its centroids are made of.
FIT_TEXTS = 1000
ROUNDS = 8
#: Share of a language's own texts that its distance limit would reject.
REJECTED_SHARE = 0.002
UNKNOWN = "und"
#: Characters of a text that are turned into n-grams at a time.
PIECE_CHARS = 1 << 20


class Grams:
    """Counts of hashed character n-grams; all that is no letter counts as one blank."""

    def __init__(self) -> None:
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.codes = np.where(letters, np.arange(0x110000), 32).astype(np.uint32)

    def counts(self, text: str) -> np.ndarray:
        """Of the whole text; where it is cut the last codes are kept, and every n-gram counts in the
        piece that holds its end."""
        total = np.zeros(BUCKETS, dtype=np.int64)
        text = text.lower()
        before = np.zeros(0, dtype=np.uint32)
        for start in range(0, len(text), PIECE_CHARS):
            raw = np.frombuffer(text[start : start + PIECE_CHARS].encode("utf-32-le", "replace"), dtype=np.uint32)
            codes = np.concatenate([before, self.codes[raw]])
            blank = codes == 32
            single = np.append(True, ~(blank[1:] & blank[:-1]))
            old = int(single[: len(before)].sum())
            codes = codes[single]
            mixed = np.zeros(len(codes), dtype=np.uint32)
            for order in ORDERS:
                # Multiplications wrap around, as wanted of a hash.
                mixed = mixed[: max(0, len(codes) - order + 1)] * np.uint32(0x9E3779B1) + codes[order - 1 :]
                slot = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 12)
                total += np.bincount(slot[max(0, old - order + 1) :], minlength=BUCKETS)
            before = codes[max(0, len(codes) - max(ORDERS) + 1) :]
        return total


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1: dampened counts times inverse document frequency."""
    found = np.log1p(counts.astype(np.float32)) * idf
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(norms == 0, 1, norms)


def cluster(rows: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means with spread-out starts; fewer centroids if there are fewer rows."""
    centres = [rows.mean(axis=0)]
    for _ in range(min(k, len(rows)) - 1):
        nearest = np.max([rows @ (c / (np.linalg.norm(c) or 1)) for c in centres], axis=0)
        centres.append(rows[int(nearest.argmin())])
    found = np.array(centres[1:] or centres)
    if len(found) < k:
        found = np.vstack([found, centres[0][None]])[:k]
    for _ in range(rounds):
        found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        mine = (rows @ found.T).argmax(axis=1)
        found = np.array([rows[mine == c].mean(axis=0) if (mine == c).any() else found[c] for c in range(len(found))])
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Centroids of all languages with the least cosine each accepts."""

    idf: np.ndarray
    names: list[str]
    centroids: np.ndarray
    limits: np.ndarray


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _array_rows(batch: pa.RecordBatch, grams: Grams) -> Iterator[np.ndarray]:
    for text in batch.column("text"):
        yield grams.counts(text.as_py())


def fit(docs: DataFrame, fit_texts: int = FIT_TEXTS, centroids: int = CENTROIDS) -> Model | None:
    """The model of the rows of ``docs`` with a ``lang`` and a letter in their text; None without any.

    Document frequencies are summed over all those rows. Centroids are clustered from about
    ``fit_texts`` rows per language, each language in a task of its own: a bounded sample.
    """
    rows = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total, n = Grams(), np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for counts in _array_rows(batch, grams):
                total += counts > 0
                n += 1
        if n:
            slots = np.append(np.arange(BUCKETS), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(np.append(total, n))], names=["slot", "n"]
            )

    by_slot = rows.select("text").mapInArrow(frequencies, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = {r.slot: r.n for r in by_slot.collect()}
    if not found:
        return None
    seen = np.array([found[i] for i in range(BUCKETS)], dtype=np.float64)
    idf = np.log((1 + found[-1]) / (1 + seen)).astype(np.float32) + 1

    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_texts / n))])
    place = F.pmod(F.xxhash64(F.lit(2), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(place < F.element_at(share, F.col("lang"))).select("lang", "text")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for lang, counts in zip(batch.column("lang"), _array_rows(batch, grams)):
                row = vectors(counts[None], idf)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()]), pa.array([row.tobytes()], pa.binary())], names=["lang", "v"]
                )

    def clustered(of_one: pd.DataFrame) -> pd.DataFrame:
        own = np.stack([np.frombuffer(v, dtype=np.float32) for v in sorted(of_one["v"])])
        centres = cluster(own, centroids, ROUNDS).astype(np.float32)
        limit = float(np.quantile((own @ centres.T).max(axis=1), REJECTED_SHARE))
        return pd.DataFrame(
            {"lang": of_one["lang"].iloc[0], "v": [c.tobytes() for c in centres], "least": limit}
        )

    made = (
        sample.mapInArrow(sampled, "lang string, v binary")
        .groupBy("lang").applyInPandas(clustered, "lang string, v binary, least double")
        .orderBy("lang", "v").collect()
    )
    if not made:
        return None
    return Model(
        idf,
        [r.lang for r in made],
        np.stack([np.frombuffer(r.v, dtype=np.float32) for r in made]),
        np.array([r.least for r in made]),
    )


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (replacing columns so named).

    ``lang_pred`` is the language of the nearest centroid (of equally near ones the first by
    name), ``score`` its cosine, 0 to 1, ``rejected`` whether that is under the language's
    limit. A text that is null or without a letter is ``und`` with score 0 and rejected; so is
    everything without a model. Whole texts are read, one at a time; rows are independent, so
    repeated rows get the same answer each. An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    text = F.when(has_letter(F.col("text")), F.col("text")).alias("_language_text")
    rows = docs.select(*rest, text)
    if model is None:
        return rows.select(
            *rest, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
        )
    kinds = [f for f in rows.schema.fields if f.name in rest]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    schema += ", lang_pred string, score double, rejected boolean"

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            names, scores, far = [], [], []
            for text in batch.column("_language_text"):
                counts = grams.counts(text.as_py()) if text.is_valid else np.zeros(BUCKETS)
                if not counts.any():
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    far.append(True)
                    continue
                cosines = model.centroids @ vectors(counts[None], model.idf)[0]
                best = int(cosines.argmax())
                names.append(model.names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
                far.append(bool(cosines[best] < model.limits[best]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores), pa.array(far)],
                names=[*rest, "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(identified, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """Predictions for all documents by a model that never saw those held out (crc32 of the
    id modulo 4 is 2; a null id is held out as well), one row for every row, repeated ones too;
    null, empty and long texts and empty tables as in :func:`identify`."""
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(True))
    model = fit(docs.filter(~held_out))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
