"""Mixing sources to target weights with DataFrame functions only.

The words of a source stand one after the other and are cut into blocks of fixed length. A mix is a row of
slots, dealt out to output shards: each shard draws its sources by a multinomial draw whose totals are the
targets (a pseudorandom permutation of all slots, so that totals are met exactly and no block is asked for
more often than allowed). The slots of a source are numbered, and each run of them over the whole source
goes through a pseudorandom permutation of the block numbers. Slots and blocks are then joined by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import WORD, column, files_for, partitions, stored

BLOCK_WORDS = 128
SHARD_SLOTS = 8192
#: A target stops at this many times the size of its source.
MOST = 3
WEIGHTS = (1, 2, 3)

ROUNDS = 16
#: Slots made from one row.
RUN = 16_384
#: Documents of a source that are numbered in one task.
BUCKET_DOCS = 5_000


def permuted(x: Column, n: Column, seed: Column, inverse: bool = False) -> Column:
    """Number `x` of a pseudorandom permutation of 0 .. n - 1: a swap-or-not network, native for any n."""
    def step(at: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(seed, turn), n) - at, n)
        swap = F.xxhash64(seed, turn, F.greatest(at, partner), F.lit("swap")).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(at)

    turns = range(ROUNDS)[::-1] if inverse else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, turns)), x.cast("bigint"), step)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`sid, source, source_size, target` of every source of `sizes` (`source, size`).

    Sources in the order of their code points, null last, weigh `weights`, repeating. The targets share the
    sum of all sizes by weight; none exceeds `most` times its source, and what is above is shared again.
    """
    by_source = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    number = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).alias("sid")
    # One row per source: the windows without a partition see no documents.
    rows = by_source.select("source", "source_size", number).withColumns({
        "weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")),
        "bound": F.col("source_size") * most})
    every = Window.partitionBy(F.lit(0))
    filled = every.orderBy(F.col("bound") / F.col("weight"), "sid")
    total = F.sum("source_size").over(every)
    # Level if all sources that fill up earlier are at their bound; a source is at its bound if that is below.
    level = (total - F.coalesce(F.sum("bound").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
             ) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("full", F.col("bound") <= level * F.col("weight")).withColumn("total", total)
    rest = (F.col("total") - F.sum(F.when(F.col("full"), F.col("bound")).otherwise(0)).over(every)
            ) / F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    return rows.select("sid", "source", "source_size", F.when(F.col("full"), F.col("bound").cast("double")).otherwise(
        rest * F.col("weight")).alias("target"))


def mix_plan(targets: DataFrame, block: int = BLOCK_WORDS, most: int = MOST, seed: int = 1) -> DataFrame:
    """Per source its number of blocks, its slots with whole blocks, and the words of a last, trimmed slot."""
    size, blocks, slots = F.col("source_size"), F.col("n_blocks"), F.col("n_slots")
    epoch, rest = F.floor(slots / blocks), slots % blocks
    last = F.pmod(size - 1, F.lit(block)) + 1
    has_last = permuted(blocks - 1, blocks, F.xxhash64(F.lit(seed), "sid", epoch), inverse=True) < rest
    whole = epoch * size + rest * block - F.when(has_last, block - last).otherwise(0)
    trimmed = F.when(slots < most * blocks, F.least(F.lit(block), F.greatest(F.lit(0), F.round("target") - whole)))
    return (targets.where("source_size > 0").withColumn("n_blocks", F.ceil(size / block))
            .withColumn("n_slots", F.least(most * blocks, F.floor(F.col("target") * blocks / size)))
            .withColumn("trim", F.coalesce(trimmed, F.lit(0)).cast("bigint")))


def mix_slots(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """The slots of the mix: `shard, slot, sid, block, words` (null words: the whole block).

    Ordered by shard and slot this is the mix; `shard_counts` gives what each shard drew of each source.
    """
    every = F.col("n_slots") + (F.col("trim") > 0).cast("bigint")
    ordered = Window.partitionBy(F.lit(0)).orderBy("sid")
    rows = plan.select("sid", "n_blocks", "n_slots", "trim", every.alias("n"),
                       F.coalesce(F.sum(every).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                       .alias("low"), F.sum(every).over(Window.partitionBy(F.lit(0))).alias("total")).where("n > 0")
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN)))
                           ).repartition(partitions(plan.sparkSession), "sid", "run")
    first = F.col("run") * RUN
    each = runs.withColumn("i", F.explode(F.sequence(first, F.least(first + RUN, F.col("n")) - 1)))
    place = permuted(F.col("low") + F.col("i"), F.col("total"), F.xxhash64(F.lit(seed), F.lit("slots")))
    number = permuted(F.col("i") % F.col("n_blocks"), F.col("n_blocks"),
                      F.xxhash64(F.lit(seed), "sid", F.floor(F.col("i") / F.col("n_blocks"))))
    return each.select(F.floor(place / shard_slots).alias("shard"), F.pmod(place, F.lit(shard_slots)).alias("slot"),
                       "sid", number.alias("block"), F.when(F.col("i") == F.col("n_slots"), F.col("trim")).alias("words"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """The draw: slots of each source in each output shard."""
    return slots.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    key: Column | None = None) -> DataFrame:
    """`id, source, size` (and `key`) of every document."""
    keys = [] if key is None else [key.alias("key")]
    return docs.select(column(id_col).cast("bigint").alias("id"), column(source_col).alias("source"),
                       n_words(column(text_col)).alias("size"), *keys)


def placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each document starts among the words of its source.

    Documents are dealt to buckets of a source by their id and numbered there; only the sums of the buckets
    are added up along a source, so a source with a third of all rows is no single task.
    """
    buckets = 1 + sized.count() // BUCKET_DOCS
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop("source").withColumn(
        "bucket", F.pmod(F.xxhash64("id", F.lit("bucket")), F.lit(buckets)))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    keys = ["key"] if "key" in sized.columns else []
    inside = Window.partitionBy("sid", "bucket").orderBy("id", *keys, "size", "nth")
    rows = rows.withColumn("nth", F.monotonically_increasing_id()).withColumn(
        "before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(shift, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("shift")).drop(
        "bucket", "before", "shift", "nth")


def block_uses(places: DataFrame, slots: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Blocks joined with their slots by number: a row per document and block with a slot, with the
    words `[low, high)` of the document in it, the whole uses, and the words `[low, cut)` of a trimmed one."""
    end = F.col("start") + F.col("size")
    pieces = places.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    uses = slots.groupBy("sid", "block").agg(F.count(F.when(F.col("words").isNull(), 1)).alias("uses"),
                                             F.max("words").alias("words"))
    # Slots are made from one row per source, so only the written table shows the join how many they are.
    uses = stored(uses, "uses", files_for(places, 1))
    at = F.col("block") * block
    low, high = F.greatest("start", at) - F.col("start"), F.least(end, at + block) - F.col("start")
    cut = F.least(high, F.greatest(low, at + F.coalesce("words", F.lit(0)) - F.col("start")))
    return pieces.join(uses, ["sid", "block"]).withColumns({"low": low, "high": high, "cut": cut})


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK_WORDS,
                  seed: int = 1) -> DataFrame:
    """`id, size, source_size, target, taken` of every row: words the mix takes of it, repeats counted.

    Targets are met to within a block. A null source is a source of its own, ordered last; a null text has
    size 0 and nothing is taken from it; repeated rows are separate documents with one result each; null ids
    are kept. An empty table gives no rows. Reruns agree, since every draw is a hash of `seed`.
    """
    files = files_for(docs, 0.03)
    sized = stored(sized_documents(docs, id_col, text_col, source_col), "sizes", files)
    targets = stored(source_targets(sized, weights, most), "targets", 1)
    places = stored(placed(sized, targets), "places", files)
    slots = mix_slots(mix_plan(targets, block, most, seed), seed=seed)
    whole = F.col("uses") * (F.col("high") - F.col("low")) + F.col("cut") - F.col("low")
    taken = block_uses(places, slots, block).groupBy("sid", "start", "size").agg(F.sum(whole).alias("taken"))
    # Documents with words have different starts in their source.
    return places.join(taken, ["sid", "start", "size"], "left").select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK_WORDS,
                seed: int = 1) -> DataFrame:
    """The columns of `docs` with the texts of the mix: a row for each time a document is taken, whole or in part.

    A document taken whole keeps its text; of one taken in part the words of its blocks remain, joined by one
    space. Documents the mix does not take are gone. Null and empty cases as in `mix_documents`.
    """
    key = F.xxhash64(*map(column, docs.columns))
    same = Window.partitionBy("id", "key")
    files = files_for(docs, 0.03)
    sized = stored(sized_documents(docs, id_col, text_col, source_col, key), "sizes", files)
    targets = stored(source_targets(sized, weights, most), "targets", 1)
    places = stored(placed(sized, targets).withColumn("nth", F.row_number().over(same.orderBy("start"))), "places",
                    files)
    slots = mix_slots(mix_plan(targets, block, most, seed), seed=seed)
    uses = block_uses(places, slots, block)
    spans = F.concat(F.array_repeat(F.struct("low", F.col("high").alias("stop")), F.col("uses").cast("int")),
                     F.when(F.col("cut") > F.col("low"), F.array(F.struct("low", F.col("cut").alias("stop"))))
                     .otherwise(F.array().cast("array<struct<low:bigint,stop:bigint>>")))
    # The n-th use of each block makes the n-th text of the document.
    copies = (uses.select("id", "key", "nth", "size", F.posexplode(spans).alias("copy", "span"))
              .groupBy("id", "key", "nth", "copy", "size")
              .agg(F.array_sort(F.collect_list("span")).alias("spans"))
              .withColumn("all", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.low)
                          == F.col("size")))
    words = F.regexp_extract_all(column(text_col), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(
        words, (s.low + 1).cast("int"), (s.stop - s.low).cast("int")))), " ")
    whole = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(id_col).cast("bigint").alias("id"),
                        key.alias("key"))
    whole = whole.withColumn("nth", F.row_number().over(same.orderBy(F.lit(0))))
    found = whole.join(copies, whole["id"].eqNullSafe(copies["id"]) & (whole["key"] == copies["key"])
                       & (whole["nth"] == copies["nth"]))
    return (found.select("row.*", "all", "spans").withColumn(text_col, F.when(F.col("all"), column(text_col))
            .otherwise(part)).select(*map(column, docs.columns)))
