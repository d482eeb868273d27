"""Toxicity by a chain of linear models.

The categories are predicted one after the other, each by a logistic model over words, word starts and a few
figures of the text, to which the probabilities of the earlier categories are added. The later models are
trained on out-of-fold probabilities of the earlier ones, so they learn from predictions as good as those
they will see. The chain is fitted on a bounded sample of labelled documents; scoring covers every document
in one pass without a shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import column, stored, text_slices, tidied

#: Labelled documents the chain is fitted on at most, and features taken per category at most.
SAMPLE_ROWS, FEATURES = 20_000, 250

#: A feature is taken if its association with the category (log-likelihood ratio) reaches this.
LEAST_G2 = 16.0

FOLDS, STARTS, PENALTY = 5, (4, 5), 0.1

#: Figures of a text beside its words.
FIGURES = ("words", "distinct", "symbols")

EDGES = string.punctuation + "«»„“”‘’¿¡…–—"

CACHE_WORDS = 400_000


def word_features(word: str) -> list[str]:
    """The word without punctuation at its ends, and its starts."""
    word = word.strip(EDGES)[:40]
    if not word:
        return []
    return ["=" + word, *("^" + word[:n] for n in STARTS if len(word) > n)]


@dataclass
class Chain:
    """A fitted chain: feature numbers, and per category its weights and threshold."""

    categories: list[str]
    features: dict[str, int] = field(default_factory=dict)
    # Per category: bias, weights of the features, of the figures, of the earlier categories.
    models: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, rows: np.ndarray, columns: np.ndarray, figures: np.ndarray) -> np.ndarray:
        """One column per category; `rows` and `columns` are the features present."""
        n = len(figures)
        found = np.zeros((n, len(self.models)))
        for k, (bias, words, other, earlier) in enumerate(self.models):
            logit = bias + np.bincount(rows, words[columns], n) + figures @ other + found[:, :k] @ earlier
            found[:, k] = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return found


def fit_logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, counts: np.ndarray | None = None,
                 penalty: float = PENALTY) -> np.ndarray:
    """Weights of the columns of `x` and a bias, by Newton steps from `start`; the optimum does not depend on it.

    Rows count as often as `counts` says, once if it is not given.
    """
    counts = np.ones(len(y)) if counts is None else counts
    shrink = np.full(x.shape[1] + 1, penalty)
    shrink[-1] = 1e-6
    w = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -40, 40)))
        error, curve = (counts * (p - y)).astype(x.dtype), (counts * p * (1 - p)).astype(x.dtype)
        bent = x * curve[:, None]
        side = bent.sum(0, dtype=float)
        hessian = np.block([[(bent.T @ x).astype(float), side[:, None]], [side[None, :], curve.sum(dtype=float)]])
        gradient = np.append(error @ x, error.sum(dtype=float)) + shrink * w
        step = np.linalg.solve(hessian + np.diag(shrink + 1e-9), gradient)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


class _Reader:
    """Texts to the words of a slice, each word once."""

    def __init__(self, features_of: Callable[[str], list]):
        self.features_of, self.young, self.old = features_of, {}, {}

    def read(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, list, np.ndarray]:
        """Distinct words, word numbers in text order, words per text, features of each word, and figures."""
        split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        full = np.fromiter(map(bool, words), bool, len(words))[codes]
        codes, row = codes[full], row[full]
        found = list(map(self.young.get, words))
        for i in [i for i, f in enumerate(found) if f is None]:
            f = self.old.get(words[i])
            found[i] = self.young[words[i]] = self.features_of(words[i]) if f is None else f
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        n = len(texts)
        count = np.bincount(row, minlength=n)
        each = np.unique(row * len(words) + codes)
        plain = np.fromiter((w.strip(EDGES).isalpha() for w in words), bool, len(words))
        some = np.maximum(count, 1)
        figures = np.stack([np.log1p(count) / 10, np.bincount(each // max(1, len(words)), minlength=n) / some,
                            np.bincount(row, ~plain[codes], n) / some], axis=1)
        return words, codes, row, found, figures


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id",
              text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Chain:
    """Fit a chain for `categories` (name: SQL condition over the columns of `labels`), in their order.

    At most `sample_rows` labelled documents, a pseudorandom sample by id, are used; copies of a text count
    once. Rows with a null id or an undecided condition take no part. A category of which the sample has
    fewer than two documents, or all but fewer than two, is predicted by its share and never flagged.
    """
    names = list(categories)
    marked = labels.select(column(id_col).cast("bigint").alias("id"),
                           *[F.expr(categories[c]).cast("int").alias(f"y{i}") for i, c in enumerate(names)]).dropna()
    # Bounded by `sample_rows`, so it may be broadcast.
    chosen = marked.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows)
    texts = docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").where("text is not null")
    ys = [f"y{i}" for i in range(len(names))]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(word_features)
        for part in text_slices(batches):
            _, codes, row, found, figures = reader.read(part.column("text"))
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = [sorted({f for c in np.unique(codes[a:b]).tolist() for f in found[c]})
                     for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pc.cast(part.column("digest"), pa.int64()), *(part.column(y) for y in ys),
                 pa.array(lists, pa.list_(pa.string())), pa.array(figures.tolist(), pa.list_(pa.float64()))],
                ["digest", *ys, "features", "figures"])

    kinds = ", ".join(f"{y} int" for y in ys)
    once = (sample.withColumn("digest", F.xxhash64("text")).groupBy("digest")
            .agg(F.first("text").alias("text"), *[F.max(y).alias(y) for y in ys]))
    described = stored(once.mapInArrow(describe, f"digest long, {kinds}, features array<string>, "
                                                 "figures array<double>"), "toxicity-sample", 8)
    totals = described.agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    n = totals["n"]
    chain = Chain(names)
    per_feature = described.select(*ys, F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("df"), *[F.sum(y).alias(y) for y in ys]).where("df >= 3")
    for y in ys:
        ones = totals[y] or 0
        if not 2 <= ones <= n - 2:
            continue

        def cell(seen, of, share):  # a cell of the log-likelihood ratio
            return F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)

        hit, df = F.col(y), F.col("df")
        g2 = 2 * (cell(hit, df, F.lit(ones / n)) + cell(df - hit, df, F.lit(1 - ones / n))
                  + cell(ones - hit, n - df, F.lit(ones / n))
                  + cell((n - df) - (ones - hit), n - df, F.lit(1 - ones / n)))
        best = (per_feature.select("feature", g2.alias("g2")).where(F.col("g2") >= LEAST_G2)
                .orderBy(F.desc("g2"), "feature").limit(FEATURES).collect())  # at most FEATURES rows
        for r in best:
            chain.features.setdefault(r["feature"], len(chain.features))
    sample = described.mapInArrow(lambda batches: _numbered(batches, chain.features, ys),
                                  f"digest long, {kinds}, features binary, figures binary")
    # At most `sample_rows` rows with a few numbers each, as Arrow columns.
    _fit_models(chain, sample.orderBy("digest").toArrow(), ys)
    return chain


def _numbered(batches: Iterator[pa.RecordBatch], numbers: dict[str, int], ys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of the sample with the numbers of their features as 16-bit and their figures as 64-bit values."""
    for batch in batches:
        lists = [np.array([numbers[f] for f in row if f in numbers], "<u2").tobytes()
                 for row in batch.column("features").to_pylist()]
        figures = [np.array(row, "<f8").tobytes() for row in batch.column("figures").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("digest", *ys)), pa.array(lists, pa.binary()),
                                          pa.array(figures, pa.binary())], ["digest", *ys, "features", "figures"])


def _fit_models(chain: Chain, sample: pa.Table, ys: list[str]) -> None:
    """Fit the models in one matrix of at most SAMPLE_ROWS rows by FEATURES columns per category."""
    n, width, others = sample.num_rows, len(chain.features), len(FIGURES)
    fold = sample.column("digest").to_numpy() % FOLDS
    x = np.zeros((n, width + others + len(ys)), np.float32)
    for i, (features, figures) in enumerate(zip(sample.column("features"), sample.column("figures"), strict=True)):
        x[i, np.frombuffer(features.as_py(), "<u2")] = 1
        x[i, width:width + others] = np.frombuffer(figures.as_py(), "<f8")
    for k, y in enumerate(ys):
        target = sample.column(y).to_numpy().astype(float)
        column_of = width + others + k
        if not 2 <= target.sum() <= n - 2:
            share = min(max(target.mean() if n else 0.0, 1e-6), 1 - 1e-6)
            chain.models.append((float(np.log(share / (1 - share))), np.zeros(width), np.zeros(others), np.zeros(k)))
            chain.thresholds.append(np.inf)
            x[:, column_of] = share
            continue
        known = x[:, :column_of]
        w = fit_logistic(known, target, np.zeros(column_of + 1))
        unseen = np.zeros(n)
        for f in range(FOLDS):
            if (out := fold == f).any():
                v = fit_logistic(known, target, w, (~out).astype(float))
                unseen[out] = 1 / (1 + np.exp(-np.clip(known[out] @ v[:-1] + v[-1], -40, 40)))
        chain.models.append((float(w[-1]), w[:width], w[width:width + others], w[width + others:-1]))
        chain.thresholds.append(_threshold(unseen, target))
        x[:, column_of] = unseen


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of the out-of-fold probabilities with the fewest errors, in the middle of the best gap."""
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([(1 - y)[::-1].cumsum()[::-1], [0]])
    edges = np.concatenate([[0.0], p, [1.0]])
    gaps = np.diff(edges)
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(gaps[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def score_chain(docs: DataFrame, chain: Chain, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, with `p` (a probability per category) and `flags` (a boolean per category).

    A text that is null or has no words has probability 0 throughout. No shuffle; order and repeated rows are
    left as they are.
    """
    rows = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)], column(text_col).alias("text"))
    kinds = dict(zip((f"k{i}" for i in range(len(keep))), (docs.schema[c].dataType.simpleString() for c in keep),
                     strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(lambda w: [chain.features[f] for f in word_features(w) if f in chain.features])
        limits = np.array(chain.thresholds)
        for part in text_slices(batches):
            words, codes, row, found, figures = reader.read(part.column("text"))
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            hits = lengths[codes] > 0
            pairs = np.unique(row[hits] * max(1, len(words)) + codes[hits])
            at, code = pairs // max(1, len(words)), pairs % max(1, len(words))
            columns = np.array([f for c in code.tolist() for f in found[c]], np.int64)
            at = np.repeat(at, lengths[code])
            present = np.unique(at * max(1, len(chain.features)) + columns)
            p = chain.probabilities(present // max(1, len(chain.features)), present % max(1, len(chain.features)),
                                    figures)
            p[figures[:, 0] == 0] = 0
            flags = p >= limits
            cuts = pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in kinds), pa.ListArray.from_arrays(cuts, pa.array(p.ravel())),
                 pa.ListArray.from_arrays(cuts, pa.array(flags.ravel()))], [*kinds, "p", "flags"])

    schema = ", ".join([*(f"{k} {kind}" for k, kind in kinds.items()), "p array<double>", "flags array<boolean>"])
    scored = rows.mapInArrow(tidied(run), schema)
    return scored.select(*[F.col(k).alias(name) for k, name in zip(kinds, keep, strict=True)], "p", "flags")


#: The labelled categories, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`id, p_low_quality, p_toxic, toxic` of every row of `docs` (see `fit_chain` and `score_chain`)."""
    chain = fit_chain(docs, labels, CATEGORIES, id_col, text_col, sample_rows)
    return score_chain(docs, chain, [id_col], text_col).select(
        column(id_col).alias("id"), *[F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(chain.categories)],
        F.col("flags")[len(chain.categories) - 1].alias("toxic"))
