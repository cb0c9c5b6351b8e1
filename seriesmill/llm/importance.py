"""Quality by importance resampling with hashed n-gram models.

Two generative models, bags of hashed words and word pairs, are counted: the target model over
labelled good texts, the raw model over all texts. The importance of a document is the log ratio
of its probabilities under the two. How many documents are kept, k, is fixed first: as many as have
an importance at or above a cut, which separates good from bad best on labelled documents that the
target model has not seen. Then they are sampled without replacement by Gumbel top-k: a document's
key is its importance plus Gumbel noise from a seeded hash of its id, in millionths; the k-th
largest key of all is found by an exact distributed sort of the keys, and the documents with the
k largest ones are kept. Equal keys go to the smaller id, null last; rows with one id and one key
are kept or not together.

Words are lower-cased runs of letters or of marks; a repeated word is the same pair whatever the
word. The target model is smoothed towards the raw one, so few labels give small ratios.

Scale: all labels are used, half of them (by hash of the id) for the target model and half for the
cut, unless `labelled_rows` asks for fewer. Each task combines its counts to `BUCKETS` numbers per
model. Labels grow with the documents, so texts are shuffled once by id to meet those of the target
model. Scoring is a scan. Only (id, importance) rows are written; they are sorted by sampled ranges,
and the best cut is found by running sums over ranges; no task sees all of them.

Defined results: null and empty texts have importance 0; documents with null id are scored like
others and never labelled; repeated ids have the same noise; of several labels of an id the lowest
holds; without held-out labels of both kinds all documents are kept; an empty table gives an empty
result; other columns are kept by `resampled` and ignored by `importance`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import free_names, named, with_sums_before, written
from seriesmill.llm.hashing import batches_of, sequence_hashes, word_hashes
from seriesmill.llm.target_sampling import ranked

BUCKETS = 4096
SMOOTHING = 4 * BUCKETS
LABELLED_ROWS = None  # all
KEY_PARTS = 1_000_000
SEED = 11


def features(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For some texts at a time: the buckets of their n-grams, the text each belongs to, the texts.

    The last bucket is for a word after itself.
    """
    modulus = np.uint64(buckets - 1)
    for some in batches_of(texts):
        words, offsets = word_hashes(some, split_marks=True)
        pairs, pair_offsets = sequence_hashes(words, offsets, 2)
        number = np.arange(len(some))
        owner = np.repeat(number, np.diff(offsets))
        again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        found = np.concatenate([words % modulus, pairs % modulus, np.full(again.sum(), modulus)]).astype(np.int64)
        yield found, np.concatenate([owner, np.repeat(number, np.diff(pair_offsets)), owner[1:][again]]), len(some)


def model_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Counts per bucket over all rows (text)."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(buckets, np.int64)
        for rows in batches:
            for found, _, _ in features(rows["text"].tolist(), buckets):
                counts += np.bincount(found, minlength=buckets)
        yield pd.DataFrame({"bucket": np.arange(buckets), "n": counts})[counts > 0]

    counts = docs.select("text").mapInPandas(counted, "bucket long, n long")
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets)
    out[sums["bucket"]] = sums["n"]
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    base = (raw + 0.5) / (raw.sum() + len(raw) / 2)
    return np.log((target + smoothing * base) / (target.sum() + smoothing) / base)


def importance_of(text: Column, ratios: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            sums = [np.bincount(owner, ratios[found], n) for found, owner, n in features(texts.tolist(), len(ratios))]
            yield pd.Series(np.concatenate(sums) if sums else np.zeros(0))

    return score(text)


def gumbel_noise(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise from 52 bits of a seeded hash of the id."""
    bits = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int | None, seed: int) -> DataFrame:
    """All labelled ids, or at most `rows` of them by hash: id, good, held_out."""
    sample = labels.select(named(id_col).alias("label_id"), named(label_col).alias("label")).dropna()
    by_hash = F.xxhash64(F.lit(seed), F.col("label_id"))
    sample = sample.groupBy("label_id").agg(F.min("label").alias("label"))
    if rows is not None:
        sample = sample.orderBy(by_hash, "label_id").limit(rows)
    return sample.select("label_id", (F.col("label") > 0).alias("good"), (F.pmod(by_hash, F.lit(2)) == 1).alias("held_out"))


def best_cut(keys: np.ndarray, good: np.ndarray) -> float:
    """Keeps most good and fewest bad keys; half way to the next lower key."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(keys, kind="stable")
    keys, good = keys[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    good_above = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    at = int(np.argmax(bad_below + good_above))
    if at in (0, len(keys)):
        return -np.inf if at == 0 else np.inf
    return float(keys[at - 1] + keys[at]) / 2


def best_cut_of(held: DataFrame) -> float:
    """`best_cut` of a table (importance, good) of any size; equal keys are kept or not together."""
    bad = (~F.col("good")).cast("long")
    levels = held.groupBy("importance").agg(F.sum(bad).alias("bad"), F.sum(F.col("good").cast("long")).alias("good"))
    sums = {"bad_below": "bad", "good_below": "good"}
    levels = with_sums_before(levels.withColumn("all", F.lit(0)), ["all"], [F.col("importance")], sums, "importance-levels")
    n_bad, n_good = levels.agg(F.sum("bad"), F.sum("good")).first()
    if not n_bad or not n_good:
        return -np.inf
    right = F.col("bad_below") / F.lit(n_bad) + (1 - F.col("good_below") / F.lit(n_good))
    key = levels.orderBy(right.desc(), "importance").first()["importance"]
    below = levels.where(F.col("importance") < key).agg(F.max("importance")).first()[0]
    return -np.inf if below is None else (below + key) / 2


class Resampler:
    """A fitted model: log ratios per bucket and the cut on importance that k is counted by."""

    def __init__(self, ratios: np.ndarray, cut: float, seed: int):
        self.ratios, self.cut, self.seed = ratios, cut, seed

    def importance(self, text: Column) -> Column:
        return importance_of(text, self.ratios)

    def key(self, importance: Column, doc_id: Column) -> Column:
        return F.floor((importance + gumbel_noise(doc_id, self.seed)) * KEY_PARTS).cast("long")

    def order(self, importance: Column, doc_id: Column) -> dict[str, Column]:
        """Columns in whose order the largest keys come first."""
        return {"low": -self.key(importance, doc_id), "no_id": doc_id.isNull().cast("long"), "id": F.coalesce(doc_id.cast("long"), F.lit(0))}


def last_kept(scored: DataFrame, model: Resampler) -> tuple[int, ...] | None:
    """The order columns of the k-th document of a written table (doc_id, importance); none if k is 0."""
    k = scored.where(F.col("importance") >= F.lit(model.cut)).count()
    order = model.order(F.col("importance"), F.col("doc_id"))
    places = ranked(scored.select(*[x.alias(n) for n, x in order.items()]), list(order))
    row = places.where(F.col("rank") == k).first()
    return None if row is None else tuple(row[n] for n in order)


def is_kept(order: dict[str, Column], last: tuple[int, ...] | None) -> Column:
    """Whether a row stands at or before the last kept one."""
    if last is None:
        return F.lit(False)
    kept = F.lit(True)
    for column, value in reversed(list(zip(order.values(), last, strict=True))):
        kept = (column < value) | ((column == value) & kept)
    return kept


def fit_and_score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    labelled_rows: int | None = LABELLED_ROWS,
    seed: int = SEED,
) -> tuple[Resampler, DataFrame]:
    """A fitted model and a written table (doc_id, importance)."""
    sample = written(labelled_sample(labels, id_col, label_col, labelled_rows, seed), "importance-labels")
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    # the list grows with the documents: never broadcast it, and do not sort texts
    trained = sample.where("good and not held_out").select("label_id").hint("shuffle_hash")
    target = rows.join(trained, F.col("doc_id") == F.col("label_id"), "left_semi")
    model = Resampler(log_ratios(model_counts(rows, buckets), model_counts(target, buckets), smoothing), -np.inf, seed)
    scored = written(rows.select("doc_id", model.importance(F.col("text")).alias("importance")), "importance-scores")
    held = scored.join(sample.where("held_out"), F.col("doc_id") == F.col("label_id"))
    held = held.groupBy("doc_id", "good").agg(F.min("importance").alias("importance"))
    model.cut = best_cut_of(held)
    return model, scored


def fit(docs: DataFrame, labels: DataFrame, *columns: str, **options) -> Resampler:
    return fit_and_score(docs, labels, *columns, **options)[0]


def importance(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """One row per document: doc_id, importance, sample_key and whether the sample has it."""
    model, scored = fit_and_score(docs, labels, id_col, text_col, **options)
    kept = is_kept(model.order(F.col("importance"), F.col("doc_id")), last_kept(scored, model))
    return scored.select("*", model.key(F.col("importance"), F.col("doc_id")).alias("sample_key"), kept.alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents in the sample, with all their columns."""
    model, scored = fit_and_score(docs, labels, id_col, text_col, **options)
    last = last_kept(scored, model)
    (score,) = free_names(docs, "importance")
    scored = docs.withColumn(score, model.importance(named(text_col)))
    return scored.where(is_kept(model.order(F.col(score), named(id_col)), last)).drop(score)
