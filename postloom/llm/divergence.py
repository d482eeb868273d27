"""How the sources of a language differ in their words, in exact whole numbers.

Texts become counts per language, source and term; from there on only counts matter. Terms with the same count
in a group and the same count in its language form a cell: the measure is computed once per cell, cells are
ranked by the number of terms they stand for, those of equal value are merged, and only the cells that reach
the first ranks are expanded to terms. Two sources are compared by the cells of their counts; terms that only one
of them has, or neither, come in through the counts of each source alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import column, files_for, partitions, stored, text_slices
from postloom.session import broadcast_if_small

#: Letters are A-Z, a-z and everything beyond ASCII; only A-Z are lowered. In UTF-8 that is a mapping of bytes.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCALE, PRIOR = 1_000_000_000, 2

#: Text counted at once inside a task.
SLICE_BYTES = 12 << 20


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of the texts, and for each term in text order its number and its row."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    n = len(texts)
    starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    raw = b"" if raw is None else raw[int(starts[0]):int(starts[-1])].to_pybytes().translate(LETTERS)
    plain = pa.StringArray.from_buffers(n, pa.py_buffer((starts - starts[0]).tobytes()), pa.py_buffer(raw))
    split = pc.ascii_split_whitespace(plain)
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else codes > 0
    return coded.dictionary, codes[full], row[full]


def term_counts(docs: DataFrame) -> DataFrame:
    """`lang, source, term, n, docs`: occurrences of a term and documents with it, summed up per slice of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=SLICE_BYTES):
            terms, codes, row = _terms(part.column("text"))
            if not len(codes):
                continue
            numbers: dict[tuple[str, str], int] = {}
            group = np.array([numbers.setdefault(x, len(numbers)) for x in
                              zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)])
            width = len(terms)
            once, times = np.unique(row * width + codes, return_counts=True)
            cells, at = np.unique(group[once // width] * width + once % width, return_inverse=True)
            names = list(numbers)
            of, term = pa.array(cells // width), pa.array(cells % width)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in names]).take(of), pa.array([x[1] for x in names]).take(of), terms.take(term),
                pa.array(np.bincount(at, times).astype(np.int64)), pa.array(np.bincount(at))],
                ["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least_docs: int, deal: int) -> DataFrame:
    """`lang, term, n, found` of the terms in at least `least_docs` documents of their language: occurrences, and
    how many of them each source has. The array is as long as the language has sources.

    One shuffle by language and term serves both groupings; a slice of texts has sent each cell once.
    """
    each = counts.repartition(deal, "lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("c"), F.sum("docs").alias("docs"))
    whole = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("c").alias("n"),
                                             F.array_sort(F.collect_list(F.struct("source", "c"))).alias("found"))
    return whole.where(F.col("docs") >= least_docs).select("lang", "term", "n", "found")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)); decimals, as the product outgrows a long."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    below = F.greatest(total + terms * PRIOR, F.lit(1)).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", above, below)


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """`lang, a, b, value` for every two sources of a language, a < b: the gap summed over all kept terms."""
    sides = [groups.select("lang", *[F.col(c).alias(c + x) for c in ("total", "own")], F.col("source").alias(x), "terms")
             for x in ("a", "b")]
    pairs = sides[0].join(sides[1].drop("terms"), "lang").where("a < b")
    # Terms both have, by the cells of their counts; the number of terms beyond `own` have neither count.
    # A file of terms makes many pairs, so the terms are dealt out anew.
    dealt = kept.repartition(partitions(kept.sparkSession), "lang", "term")
    both = dealt.select("lang", F.inline(F.flatten(F.transform("found", lambda x, i: F.transform(
        F.slice("found", i + 2, F.size("found")), lambda y: F.struct(
            x.source.alias("a"), y.source.alias("b"), x.c.alias("x"), y.c.alias("y"))))))
                       ).groupBy("lang", "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    alone = kept.select("lang", F.inline("found")).groupBy("lang", "source", "c").agg(F.count(F.lit(1)).alias("m"))

    def f(x, y) -> Column:
        x, y = (F.lit(0).cast("bigint") if v is None else F.col(v) for v in (x, y))
        return gap(share(x, F.col("totala"), F.col("terms")), share(y, F.col("totalb"), F.col("terms")))

    pairs = pairs.where("terms > 0")
    small = broadcast_if_small(stored(pairs, "source-pairs"))
    parts = [
        small.select("lang", "a", "b", ((F.col("terms") - F.col("owna") - F.col("ownb")) * f(None, None)).alias("v")),
        alone.withColumnsRenamed({"source": "a", "c": "x"}).join(small, ["lang", "a"]).select(
            "lang", "a", "b", (F.col("m") * f("x", None)).alias("v")),
        alone.withColumnsRenamed({"source": "b", "c": "y"}).join(small, ["lang", "b"]).select(
            "lang", "a", "b", (F.col("m") * f(None, "y")).alias("v")),
        # What the two lines before counted for terms that both have is taken back.
        both.join(small, ["lang", "a", "b"]).select("lang", "a", "b", (F.col("m") * (
            f("x", "y") - f("x", None) - f(None, "y") + f(None, None))).alias("v"))]
    found = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return found.groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))


def top_terms(kept: DataFrame, groups: DataFrame, langs: DataFrame, ranks: int) -> DataFrame:
    """`lang, source, item, value, rank`: the terms that stand out in each group, the first `ranks`."""
    cell = ["lang", "source", "c", "n"]
    rows = kept.select("lang", "term", "n", F.inline("found"))
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("m"))
    p = share(F.col("c"), F.col("total"), F.col("terms"))
    q = share(F.col("n"), F.col("lang_total"), F.col("terms"))
    valued = (cells.join(broadcast_if_small(groups), ["lang", "source"]).join(broadcast_if_small(langs), "lang")
              .select(*cell, "m", p.alias("p"), q.alias("q")).where("p > q").select(*cell, "m", gap(F.col("p"), F.col("q"))
                                                                                    .alias("value")))
    valued = stored(valued, "term-cells")
    # Each value stands for one term at least, so the first `ranks` values suffice.
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = (valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
              .withColumn("place", F.row_number().over(falling)).where(F.col("place") <= ranks)
              .withColumn("before", F.coalesce(F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0))).where(F.col("before") < ranks))
    wanted = valued.join(broadcast_if_small(values.select("lang", "source", "value")), ["lang", "source", "value"])
    expanded = rows.join(broadcast_if_small(stored(wanted.select(*cell, "value"), "wanted-cells")), cell)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return (expanded.select("lang", "source", F.col("term").alias("item"), "value", F.row_number().over(order).alias(
        "rank")).where(F.col("rank") <= ranks))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      least_docs: int = 10, ranks: int = 10) -> DataFrame:
    """`lang, source, part, item, value, rank` for every language and source that occur together.

    Terms are runs of letters (see `LETTERS`); a language keeps those in `least_docs` of its documents. A group
    gives each kept term the share `share` of its count. Part `pair` has a row for each other source of the
    language, with the gap between the shares summed over all kept terms (0 without any); part `term` has the
    `ranks` terms of the group whose share exceeds that in the language by the largest gap. Equal values are
    ordered by the bytes of the item. Null texts, languages and sources count as empty ones; every row is a
    document, repeated ones too; extra columns are not read; an empty table gives no rows.
    """
    rows = docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(name) for c, name in (
        (text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    deal = partitions(docs.sparkSession)
    kept = stored(kept_terms(term_counts(rows), least_docs, deal), "kept-terms", files_for(docs, 0.1))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.select("lang", F.inline("found")).groupBy("lang", "source").agg(
        F.sum("c").alias("total"), F.count(F.lit(1)).alias("own"))
    langs = stored(langs, "langs")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(
        broadcast_if_small(langs.select("lang", "terms")), "lang", "left").na.fill(0)
    groups = stored(groups, "groups")
    names = groups.select("lang", "source")
    every = names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item")
    values = pair_values(kept, groups)
    values = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
        values.select("lang", "b", "a", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (every.join(values, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                     F.row_number().over(order).alias("rank")))
    terms = top_terms(kept, groups.select("lang", "source", "total"), langs, ranks)
    return pairs.union(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
