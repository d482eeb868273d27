"""Quality rules whose cutoffs hold a promise: of the good documents of a stratum only a limited share is rejected.

Each rule is a share in thousandths (symbols, repeated lines, repeated words, capitals) with a cutoff of a fixed
grid, loosest first. Labelled documents are split in two by the hash of their text. On one half, each stratum and
rule gets the cutoff that tells bad from good best. The other half is the holdout: the rules of a stratum are
loosened together, a level of the grid at a time, and the tightest form is taken for which an exact binomial
bound on the share of rejected good documents lies under the limit. The forms are tested from the loosest on and
the first failure ends the row (a fixed sequence needs no correction within a stratum); the error allowed is
divided by the number of strata (Bonferroni). A stratum with too few good documents to prove anything keeps
only the base rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import column, files_for, stored, text_slices
from postloom.session import broadcast_if_small

#: Rules: what is counted, and of what it is a share.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
         "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "n_letters")}

#: Cutoffs in thousandths, loosest first; level 0 is a rule that is off.
GRID = (*range(950, 49, -50), 20, 10)

#: The share of good documents a stratum may lose, and the chance of a promise that does not hold.
MOST_REJECTED, ERROR = 0.05, 0.05

LEAST_WORDS, MOST_REPEATED = 50, 50

FIGURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letters")

SLICE_BYTES = 6 << 20

_SYMBOLS, _CAPITALS, _LETTERS = (np.isin(np.arange(256), list(some)) for some in (
    b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])))


def figures_of(texts: pa.Array) -> list[np.ndarray]:
    """The `FIGURES` of every text."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    n = len(texts)
    starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(b"" if raw is None else raw, np.uint8)[starts[0]:starts[-1]]

    def marked(table: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(table[raw]))[starts - starts[0]])

    def coded(split: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        parts = split.flatten().dictionary_encode()
        rows = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return parts.dictionary, parts.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows

    words, code, row = coded(pc.ascii_split_whitespace(texts))
    sizes = np.append(pc.utf8_length(words).to_numpy(zero_copy_only=False), 0)
    code, row = code[sizes[code] > 0], row[sizes[code] > 0]
    n_words = np.bincount(row, minlength=n)
    word_chars = np.bincount(row, sizes[code], n).astype(np.int64)

    repeated = np.zeros(len(code), bool)
    at = np.flatnonzero(row[:-2] == row[2:])
    if len(at):
        width = len(words)
        _, pair = np.unique(code[at] * width + code[at + 1], return_inverse=True)
        window = (row[at] * (pair.max() + 1) + pair) * width + code[at + 2]
        _, same, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = at[times[same] > 1]
        for place in range(3):
            repeated[twice + place] = True

    lines, code, line_row = coded(pc.split_pattern(texts, "\n"))
    full = np.append(pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0, False)[code]
    code, line_row = code[full], line_row[full]
    n_lines = np.bincount(line_row, minlength=n)
    width = max(1, len(lines))
    distinct = np.bincount(np.unique(line_row * width + code) // width, minlength=n)
    return [n_words, word_chars, marked(_SYMBOLS), n_lines, n_lines - distinct,
            np.bincount(row[repeated], minlength=n), marked(_CAPITALS), marked(_LETTERS)]


def text_figures(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """`id, stratum, key` and the `FIGURES` of every row; `key` is the hash of the text."""
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).cast("bigint").alias("id"),
                       F.coalesce(column(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                       F.md5(text.cast("binary")).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=SLICE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("id", "stratum", "key")]
                + [pa.array(x.astype(np.int64)) for x in figures_of(part.column("text"))], ["id", "stratum", "key", *FIGURES])

    return rows.mapInArrow(run, "id long, stratum string, key string, " + ", ".join(f"{f} long" for f in FIGURES))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rejected_from(grid: tuple[int, ...] = GRID) -> Column:
    """Per rule the loosest level whose cutoff a document exceeds; one more than the last if there is none."""
    def level(part: Column, whole: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: 1000 * part <= c * whole)) + 1

    return F.array(*[level(F.col(n), F.col(d)) for n, d in RULES.values()])


def allowed(n: int, share: float, error: float) -> int:
    """The most rejections among `n` good documents that prove a rate under `share`: a rate of `share` or more
    gives so few with a probability of at most `error`, by the exact binomial distribution. -1: none do."""
    total, k = 0.0, 0
    while k <= n:
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share)
                          + (n - k) * math.log1p(-share))
        if total > error:
            break
        k += 1
    return k - 1


def proposed_levels(fit: DataFrame, grid: tuple[int, ...] = GRID) -> DataFrame:
    """`stratum, levels`: for each rule the level that tells the bad documents of `fit` from the good ones best.

    Best is the largest difference between the shares of bad and of good documents rejected, of equal levels the
    middle one; 0 where no level is better than none. `fit` has `stratum, good, from_level`.
    """
    seen = fit.select("stratum", "good", F.posexplode("from_level").alias("rule", "level")).groupBy(
        "stratum", "rule", "level").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    strata = fit.groupBy("stratum").agg(F.count_if("good").alias("all_good"), F.count_if(~F.col("good")).alias("all_bad"))
    steps = strata.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(RULES) - 1))).alias("rule")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("level"))
    upto = Window.partitionBy("stratum", "rule").orderBy("level")
    worth = F.sum("bad").over(upto) * F.col("all_good") - F.sum("good").over(upto) * F.col("all_bad")
    scored = (steps.join(seen, ["stratum", "rule", "level"], "left").na.fill(0, ["good", "bad"])
              .select("stratum", "rule", "level", worth.alias("worth")))
    best = scored.groupBy("stratum", "rule").agg(F.max("worth").alias("best"), F.array_sort(F.collect_list(
        F.struct("level", "worth"))).alias("all"))
    equal = F.filter("all", lambda x: x.worth == F.col("best")).getField("level")
    level = F.when(F.col("best") > 0, F.element_at(equal, F.floor((F.size(equal) + 1) / 2).cast("int"))).otherwise(0)
    levels = F.transform(F.array_sort(F.collect_list(F.struct("rule", level.alias("level")))), lambda x: x.level)
    return best.groupBy("stratum").agg(levels.alias("levels"))


def certified_cutoffs(figures: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: str = "quality = 1",
                      share: float = MOST_REJECTED, error: float = ERROR, grid: tuple[int, ...] = GRID) -> DataFrame:
    """`stratum, n_good, n_rejected, loosened, cutoffs` of every stratum with labelled documents.

    `cutoffs` has one value per rule (null: off); `n_rejected` of `n_good` holdout documents exceed one of them.
    A document with contrary labels, or none, takes no part, nor does one that fails the base rules; copies of a
    text in a stratum count once, as bad if one of them is.
    """
    marked = labels.select(column(id_col).cast("bigint").alias("id"), F.expr(good).alias("good")).dropna().groupBy(
        "id").agg(F.min("good").alias("good"), F.max("good").alias("most")).where("good = most").drop("most")
    known = (figures.where(~base_failed()).join(broadcast_if_small(marked), "id").groupBy("stratum", "key")
             .agg(F.min("good").alias("good"), F.first(rejected_from(grid)).alias("from_level")))
    holdout = F.conv(F.substring("key", 1, 1), 16, 10).cast("int") % 2 == 1
    known = stored(known.select("*", holdout.alias("holdout")), "labelled")
    # From here on a few rows per stratum.
    levels = proposed_levels(known.where("not holdout"), grid)
    strata = known.select("stratum").distinct()
    n_strata = max(1, strata.count())
    # The form loosened by j levels rejects a document if one of its rules does.
    reach = F.array_max(F.zip_with("levels", "from_level", lambda level, start: level - start))
    tested = known.where("holdout and good").join(broadcast_if_small(levels), "stratum").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"), *[F.count_if(reach >= j).alias(f"r{j}") for j in range(len(grid))])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                limit = allowed(row["n_good"], share, error / n_strata)
                passed = [j for j in range(len(grid)) if row[f"r{j}"] <= limit]
                row["loosened"] = min(passed) if passed else len(grid)
                row["n_rejected"] = row[f"r{row['loosened']}"] if passed else 0
            names = ["stratum", "n_good", "n_rejected", "loosened"]
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in names} for row in rows], pa.schema([
                ("stratum", pa.string()), ("n_good", pa.int64()), ("n_rejected", pa.int64()), ("loosened", pa.int32())]))

    passed = tested.mapInArrow(test, "stratum string, n_good long, n_rejected long, loosened int")
    cuts = F.transform("levels", lambda level: F.get(F.array(*map(F.lit, grid)), level - F.coalesce(
        "loosened", F.lit(len(grid))) - 1))
    return strata.join(levels, "stratum", "left").join(passed, "stratum", "left").select(
        "stratum", F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"),
        F.coalesce("loosened", F.lit(len(grid))).alias("loosened"),
        F.coalesce(cuts, F.array().cast("array<int>")).alias("cutoffs"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     stratum_col: str = "lang", label_id: str = "doc_id", good: str = "quality = 1",
                     share: float = MOST_REJECTED, error: float = ERROR) -> DataFrame:
    """`id`, the `FIGURES`, `base_failed`, `failed` (names of the rules exceeded) and `kept` of every row of `docs`.

    With probability `1 - error`, in no stratum more than `share` of the good documents that pass the base rules
    are rejected. `good` is a condition on `labels`; where it is null a label is left out. Strata without labels
    and rows with a null id are judged like all others by what is known of their stratum. A null text has no
    words, a null stratum is the empty one, repeated rows have a result each; an empty table gives no rows.
    """
    figures = stored(text_figures(docs, id_col, text_col, stratum_col), "figures", files_for(docs, 0.03))
    cutoffs = certified_cutoffs(figures, labels, label_id, good, share, error).select("stratum", "cutoffs")
    rows = figures.join(broadcast_if_small(stored(cutoffs, "cutoffs")), "stratum", "left")
    failed = F.filter(F.array(*[F.when(1000 * F.col(n) > F.get("cutoffs", F.lit(i)) * F.col(d), name)
                                for i, (name, (n, d)) in enumerate(RULES.items())]), lambda x: x.isNotNull())
    judged = rows.select("id", *FIGURES, base_failed().alias("base_failed"), failed.alias("failed"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
