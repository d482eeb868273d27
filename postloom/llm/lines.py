"""Line dedup as an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. Words are ordered by rarity; two sets that are similar enough share words
among the first few of each, so only those first words (the prefix) are joined. Position and length of the
sets rule out most of what meets, the rest is verified on the whole sets. Words are compared by 63-bit hashes.

Rarity is the count of all words that share one of 131,072 hash buckets with the word: a table of fixed size
that covers all rows. Any fixed order gives the same result; rarity only makes the prefixes selective.

Two sets are similar if they differ in few enough words, so many words in which they are known to differ rule a
pair out. A set has a bit map: a word flips one of 64 bits (of 128 in a large set), so two sets differ in as many
words as bits at least. Pairs are ruled out by that where they meet, before anything is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import WORD, column, files_for, stored
from postloom.session import broadcast_if_small

SPACE = r"[\x20\x09-\x0D]+"

#: Jaccard similarity as a fraction.
SIMILAR = (4, 5)

#: Sets with more words have the second half of the bit map.
HALF_MAP = 96

BUCKET_BITS = 17
_LOW_BITS = 63 - BUCKET_BITS


def _step(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """`stored`, and what was shuffled for it leaves the disks as soon as the table is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return stored(df, name, files)
    finally:
        conf.set(key, before)


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def word_ranks(texts: DataFrame) -> Column:
    """The rank of each hash bucket by the number of words in it, rarest first, as an array constant."""
    words = texts.select(F.explode(F.split("text", SPACE)).alias("w")).where("w <> ''")
    counts = dict(words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
                  .collect())  # at most 2 ** BUCKET_BITS rows
    order = sorted(range(1 << BUCKET_BITS), key=lambda b: (counts.get(b, 0), b))
    rank = [0] * len(order)
    for place, b in enumerate(order):
        rank[b] = place
    return F.split(F.lit(",".join(map(str, rank))), ",").cast("array<bigint>")


def word_set(line: Column, ranks: Column) -> Column:
    """The distinct words of a line as numbers, rarest first."""
    hashes = F.array_distinct(F.transform(F.array_remove(F.split(line, SPACE), ""), lambda w: F.xxhash64(w)))
    # Without the default, which is never taken, the array counts as one that may hold nulls, and is sorted boxed.
    rank = lambda h: F.coalesce(F.get(ranks, _bucket(h)), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(hashes, lambda h: F.shiftleft(rank(h), _LOW_BITS).bitwiseOR(
        h.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))))))


def _odd(words: Column, flips: Callable[[Column], Column]) -> Column:
    """64 bits: those that an odd number of words flip; a word flips the bit its low six bits name, if `flips` is 1."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseXOR(
        F.call_function("shiftleft", flips(x), x.bitwiseAND(F.lit(63)).cast("int"))))


def _ceil(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b)


def line_sets(texts: DataFrame, ranks: Column, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """`id, key, line, k1, k2, n, prefix, bits, more` of every line with words: its set as two hashes, the number of
    its words, the first ones (their low 31 bits), and its bit map (`more` is null in a small set)."""
    num, den = similar
    lines = texts.select("id", "key", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    # Lines without words are told by their text: a condition on the set would have it made twice.
    sets = lines.where(F.col("body").rlike(WORD)).select("id", "key", "line", word_set(F.col("body"), ranks).alias("s"))
    n = F.size("s")
    first = F.slice("s", F.lit(1), (n - _ceil(n * num, den) + 1).cast("int"))
    half = lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1).cast("bigint"))
    return sets.select("id", "key", "line", F.xxhash64("s").alias("k1"), F.xxhash64(F.lit("second"), "s").alias("k2"),
                       n.alias("n"), F.transform(first, lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
                       .alias("prefix"), _odd(F.col("s"), lambda x: F.lit(1).cast("bigint")).alias("bits"),
                       F.when(n > HALF_MAP, _odd(F.col("s"), half)).alias("more"))


def set_classes(sets: DataFrame) -> DataFrame:
    """One row per distinct set: `cid, k1, k2, n, prefix, bits, more, first, lines`, with a number, the address of its
    first line and how many lines have it.

    The number holds once the table is written."""
    same = [F.first(c).alias(c) for c in ("n", "prefix", "bits", "more")]
    return sets.groupBy("k1", "k2").agg(*same, F.min(F.struct("id", "line", "key")).alias("first"),
                                        F.count(F.lit(1)).alias("lines")).withColumn(
        "cid", F.monotonically_increasing_id())


def candidate_sets(classes: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Pairs `a, b` of numbers of sets that share a word of their prefixes and pass the filters of length, position
    and bit maps.

    The sizes of two sets bound the words they must share, and so those in which they may differ. A prefix is so long
    that all but one of those they must share can stand behind it. At the first word that two sets share, no more
    can be shared than what follows in either, that word included; sizes that are too different fail that too. Both
    sides of the join have the same columns, so the words are shuffled once.
    """
    num, den = similar
    col = F.col
    words = classes.select(F.posexplode("prefix").alias("at", "w"), "cid", "n", "bits", "more")
    a, b = words.alias("a"), words.alias("b")
    behind = F.least(col("a.n") - col("a.at"), col("b.n") - col("b.at"))
    position = behind * (num + den) >= (col("a.n") + col("b.n")) * num
    once = (col("a.n") < col("b.n")) | ((col("a.n") == col("b.n")) & (col("a.cid") < col("b.cid")))
    odd, half = col("a.bits").bitwiseXOR(col("b.bits")), col("a.more").bitwiseXOR(col("b.more"))
    differ = F.coalesce(F.bit_count(half) + F.bit_count(odd.bitwiseXOR(half)), F.bit_count(odd))
    near = differ * (num + den) <= (col("a.n") + col("b.n")) * (den - num)
    met = a.join(b, (col("a.w") == col("b.w")) & position & once & near)
    return met.select(col("a.cid").alias("a"), col("b.cid").alias("b")).distinct()


def similar_sets(texts: DataFrame, classes: DataFrame, ranks: Column, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Every link between two distinct sets, once: their numbers `a, b` and the addresses `first, other`."""
    num, den = similar
    met = _step(candidate_sets(classes, similar), "line-candidates")
    # Only the lines that met another are read again, each at its address.
    wanted = met.select(F.col("a").alias("cid")).union(met.select("b")).distinct()
    found = (wanted.join(classes.select("cid", "first"), "cid")
             .groupBy(F.col("first.id").alias("id"), F.col("first.key").alias("key"))
             .agg(F.collect_list(F.struct("cid", "first")).alias("found")))
    found = _step(found, "candidate-lines", files_for(classes, 0.3))
    bodies = texts.join(broadcast_if_small(found), ["id", "key"]).withColumn("bodies", F.split("text", "\n"))
    again = bodies.select("bodies", F.explode("found").alias("x"))
    sets = _step(again.select("x.*", word_set(F.get("bodies", F.col("x.first.line")), ranks).alias("s"))
                  .dropDuplicates(["cid"]), "candidate-sets", files_for(classes, 0.5))
    first = sets.select(F.col("cid").alias("a"), "first", "s")
    other = sets.select(F.col("cid").alias("b"), F.col("first").alias("other"), F.col("s").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    both = met.join(first, "a").join(other, "b")
    return both.where(shared * den >= (F.size("s") + F.size("t") - shared) * num).select("a", "b", "first", "other")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """`id, key, n_lines, n_removed, n_links, removed` of every row; `key` is the hash of its text.

    A line goes if an earlier one (by id, then by line number) has a word set with a Jaccard similarity of at
    least `similar`. Lines are judged on the input. `removed` has the numbers of the lines that go, from 0, and
    `n_links` counts the links of the sets of the row's lines to other sets. Lines without words stay. A null
    text counts as empty, that is as one line without words. Rows with a null id lose nothing and take nothing
    from others; rows that repeat an id and text have one result each and lose nothing to one another; rows that
    repeat an id with another text are ordered by its hash. An empty table gives no rows.
    """
    texts = docs.select(column(id_col).cast("bigint").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text")
                        ).withColumn("key", F.xxhash64("text"))
    known = texts.where("id is not null")
    ranks = word_ranks(known)
    sets = _step(line_sets(known, ranks, similar), "line-sets")
    classes = _step(set_classes(sets), "line-classes")
    links = _step(similar_sets(known, classes, ranks, similar).select(
        "a", "b", (F.col("first") > F.col("other")).alias("later")), "line-links")
    ends = links.select(F.col("a").alias("cid"), "later").union(links.select("b", ~F.col("later")))
    linked = ends.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.max("later").alias("goes"))
    # A set that one line has and that is linked to none says nothing of any line.
    verdict = classes.select("cid", "k1", "k2", "first", "lines").join(linked, "cid", "left").where(
        "lines > 1 or n is not null").drop("lines")
    here = F.struct("id", "line", "key")
    judged = sets.select("id", "key", "line", "k1", "k2").join(verdict, ["k1", "k2"]).select(
        "id", "key", "line", F.coalesce("n", F.lit(0)).alias("n"),
        ((here != F.col("first")) | F.coalesce("goes", F.lit(False))).alias("goes")).where("goes or n > 0")
    found = judged.groupBy("id", "key").agg(F.collect_set(F.struct("line", "n", "goes")).alias("found"))
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = texts.select("id", "key", (ends + 1).alias("n_lines"))
    lines = F.coalesce("found", F.array().cast("array<struct<line:int,n:bigint,goes:boolean>>"))
    gone = F.array_sort(F.transform(F.filter(lines, lambda x: x.goes), lambda x: x.line))
    return rows.join(found, ["id", "key"], "left").select(
        "id", "key", F.col("n_lines").cast("bigint").alias("n_lines"), F.size(gone).cast("bigint").alias("n_removed"),
        F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, x: n + x.n).alias("n_links"), gone.alias("removed"))


def without_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the texts that remain after `dedup_lines`; rows with a null id are left as they are."""
    gone = found.where("n_removed > 0").select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key"),
                                               F.col("removed").alias("_gone")).distinct()
    text = F.coalesce(column(text_col), F.lit(""))
    joined = docs.join(gone, (column(id_col).cast("bigint") == F.col("_gone_id")) & (F.xxhash64(text) == F.col(
        "_gone_key")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), column(text_col)).otherwise(kept)).select(
        *map(column, docs.columns))
