"""Quality of texts: ridge regression on random Fourier features of document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics. Every partition
sums its part of the normal equations; their solution gives raw scores, and an isotonic curve
turns those into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import id_remainder, known_id, text_hash, whole_text, written

N_FOURIER = 192
RIDGE = 1.0
SEED = 10
#: Width of the kernel, in standard deviations of the statistics, times their number's root.
WIDTH = 1.0
#: Scores are binned this finely for the isotonic curve.
BINS = 1000
THRESHOLD = 0.3
ID, TEXT_HASH = "_quality_id", "_quality_th"

STATISTICS = (
    "log_words log_chars word_chars distinct_words upper lower digits stops marks symbols pipes "
    "bang non_ascii blanks line_words repeated_lines symbol_ended bang_ended capitalised all_caps "
    "top_word short_words entropy brackets doubled"
).split()
_STOPS, _MARKS, _SYMBOLS, _BRACKETS = b".,", b";:'\"?-", b"#$%&*+=@^_~\\/", b"<>[](){}"


def statistics(text: str) -> np.ndarray:
    """What the score sees of a text: shares and lengths, all finite, 0 where undefined."""
    raw = text.encode("utf-8", "replace")
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n_words, n = max(1, len(words)), max(1, len(raw))
    counts = pd.Series(words, dtype=object).value_counts(sort=False).to_numpy() if words else np.ones(1)
    share = bytes_[bytes_ > 0] / n

    def part(chars: bytes) -> float:
        return sum(int(bytes_[c]) for c in chars) / n

    return np.array(
        [
            np.log1p(len(words)),
            np.log1p(len(text)),
            sum(map(len, words)) / n_words,
            len(counts) / n_words,
            bytes_[65:91].sum() / n,
            bytes_[97:123].sum() / n,
            bytes_[48:58].sum() / n,
            part(_STOPS),
            part(_MARKS),
            part(_SYMBOLS),
            part(b"|"),
            part(b"!"),
            bytes_[128:].sum() / n,
            part(b" \t\n\r"),
            np.log1p(len(words) / max(1, len(lines))),
            1 - len(set(lines)) / max(1, len(lines)),
            sum(w[-1] in "#$%&*" for w in words) / n_words,
            sum(w[-1] == "!" for w in words) / n_words,
            sum(w[0].isupper() for w in words) / n_words,
            sum(w.isupper() and len(w) > 1 for w in words) / n_words,
            counts.max() / n_words if words else 0.0,
            sum(len(w) < 4 for w in words) / n_words,
            float(-(share * np.log2(share)).sum()) if len(raw) else 0.0,
            part(_BRACKETS),
            sum(a == b for a, b in zip(words, words[1:])) / n_words,
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, what names the row, and its statistics: one pass over whole texts, stored."""
    schema = f"doc_id bigint, `{ID}` bigint, `{TEXT_HASH}` bigint, stats array<double>"

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(stats, pa.list_(pa.float64()))],
                names=["doc_id", ID, TEXT_HASH, "stats"],
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        known_id().alias(ID),
        text_hash().alias(TEXT_HASH),
        whole_text().alias("text"),
    )
    return written(rows.mapInArrow(computed, schema))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve_from: np.ndarray | None = None
    curve_to: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        waves = np.cos(((stats - self.mean) / self.scale).clip(-6, 6) @ self.directions + self.phases)
        return np.hstack([waves * np.sqrt(2 / waves.shape[1]), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return (self.features(stats) @ self.weights).clip(0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return raw if self.curve_from is None else np.interp(raw, self.curve_from, self.curve_to)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps nearest to y, as points (centre of block, value); x is ascending."""
    blocks: list[list[float]] = []  # weighted x, weighted y, weight
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(examples: DataFrame) -> Model | None:
    """The model of ``examples`` (``stats``, ``label`` 0 to 1, ``calibrates``); None if there are none.

    All labelled rows count. Rows with ``calibrates`` shape the isotonic curve, the others the
    ridge scores; if either set is empty the other serves for both. Sums have the size of the
    model, whatever the number of rows.
    """
    width = len(STATISTICS)
    examples = written(examples.select("stats", "label", "calibrates"))
    moments = examples.agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("calibrates")).alias("n_fit"),
        *[F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(width)],
        *[F.coalesce(F.stddev_pop(F.get("stats", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(width)],
    ).first()
    if not moments["n"]:
        return None
    scale = np.array([moments[f"s{i}"] for i in range(width)])
    dice = np.random.default_rng(SEED)
    model = Model(
        np.array([moments[f"m{i}"] for i in range(width)]),
        np.where(scale < 1e-9, 1.0, scale),
        dice.normal(size=(width, N_FOURIER)) / (WIDTH * np.sqrt(width)),
        dice.uniform(0, 2 * np.pi, N_FOURIER),
        np.zeros(N_FOURIER + 1),
    )
    fits = examples.filter(~F.col("calibrates")) if moments["n_fit"] else examples

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FOURIER + 1, N_FOURIER + 2))
        for batch in batches:
            z = model.features(_matrix(batch.column("stats"), width))
            y = batch.column("label").to_numpy(zero_copy_only=False)
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
            names=["i", "v"],
        )

    def added(of_row: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": of_row["i"].iloc[:1], "v": [np.sum(np.stack(of_row["v"]), axis=0)]})

    parts = fits.select("stats", "label").mapInArrow(summed, "i int, v array<double>")
    rows = parts.groupBy("i").applyInPandas(added, "i int, v array<double>").orderBy("i").collect()
    sums = np.array([r.v for r in rows])
    model.weights = np.linalg.solve(sums[:, :-1] + RIDGE * np.eye(len(sums)), sums[:, -1])

    curve = examples.filter("calibrates") if moments["n"] > moments["n_fit"] else examples

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("stats"), width))
            bins = np.minimum(BINS - 1, (raw * BINS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("label")], names=["bin", "label"])

    bins = (
        curve.select("stats", "label").mapInArrow(binned, "bin int, label double")
        .groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    )
    model.curve_from, model.curve_to = isotonic(
        np.array([(r.bin + 0.5) / BINS for r in bins]),
        np.array([r.y for r in bins]),
        np.array([float(r.n) for r in bins]),
    )
    return model


def _held_out() -> Column:
    return F.coalesce(id_remainder(5) == 0, F.lit(True))


def _examples(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from. Several labels of one id are averaged."""
    wanted = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .filter(~_held_out())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.avg(F.col("quality").cast("double")).alias("label"))
    )
    return stats.join(wanted, "doc_id").withColumn("calibrates", id_remainder(5) == 1)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``score`` and the columns that name the row.

    Learns from the labels whose id has a crc32 that is no multiple of 5. A null text is
    the empty text and is scored as such; null ids are scored, never learned from; repeated
    rows get a row each. Without a usable label every score is 0.5. Other columns are not
    read; empty tables give no rows.
    """
    stats = with_statistics(docs)
    model = fit(_examples(stats, labels))
    if model is None:
        return stats.select("doc_id", ID, TEXT_HASH, F.lit(0.5).alias("score"))
    schema = f"doc_id bigint, `{ID}` bigint, `{TEXT_HASH}` bigint, score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_matrix(batch.column("stats"), len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found)], names=["doc_id", ID, TEXT_HASH, "score"]
            )

    return stats.mapInArrow(scored, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores and predictions of all documents."""
    return scores(docs, labels).select(
        "doc_id",
        _held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, columns as they are."""
    good = scores(docs, labels).filter(F.col("score") >= threshold).select(ID, TEXT_HASH).distinct()
    rows = docs.withColumns({ID: known_id(), TEXT_HASH: text_hash()})
    return rows.join(good, [ID, TEXT_HASH], "left_semi").drop(ID, TEXT_HASH)
