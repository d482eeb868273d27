"""Cluster keywords: term counts, vocabulary, TF-IDF, titles."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import title_case, tokens
from postloom.operators.ranking import newest_first_order, positions
from postloom.session import checkpointed

MAX_FEATURES = 1000
TOP_TERMS = 5


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def token_counts(posts: DataFrame, text: str = "content") -> DataFrame:
    """Occurrences of every term in the corpus."""
    return posts.select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"))


def cluster_terms(posts: DataFrame, stop: list[str] | None = None, text: str = "content") -> DataFrame:
    """Term frequency per cluster; partial aggregation folds frequent terms before the shuffle."""
    rows = posts.where("cluster_id is not null").select("cluster_id", F.explode(tokens(F.col(text))).alias("term"))
    # The term is never null; saying so keeps this plan the same wherever it is used, so that Spark
    # runs its shuffle once.
    rows = rows.where("term is not null")
    if stop:
        rows = rows.where(~F.col("term").isin(stop))
    return rows.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(counted: DataFrame) -> DataFrame:
    """Total count and number of clusters per term."""
    return counted.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))


def vocabulary(stats: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent terms; equal totals in term order."""
    return stats.orderBy(F.desc("total"), "term").limit(max_features)


def tfidf(counted: DataFrame, terms: DataFrame, n_clusters: int) -> DataFrame:
    """Weights `tf * (ln((1 + n) / (1 + df)) + 1)` of the vocabulary terms, scaled to length 1 per cluster.

    The vocabulary has at most `max_features` rows: it is broadcast, and no more rows per cluster reach
    the window.
    """
    rows = counted.join(F.broadcast(terms.select("term", "df")), "term")
    idf = F.log((F.lit(n_clusters) + 1) / (F.col("df") + 1)) + 1
    raw = rows.withColumn("raw", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("cluster_id")))
    return raw.withColumn("weight", F.col("raw") / norm).select("cluster_id", "term", "tf", "weight")


def count_clusters(posts: DataFrame) -> int:
    """Number of clusters in use: one pass over the cluster id column alone."""
    return posts.where("cluster_id is not null").select(F.countDistinct("cluster_id")).first()[0]


def tfidf_weights(posts: DataFrame, stop: list[str] | None = None, max_features: int = MAX_FEATURES,
                  n_clusters: int | None = None, text: str = "content") -> DataFrame:
    """TF-IDF weights of the vocabulary terms, each cluster taken as one document."""
    n = count_clusters(posts) if n_clusters is None else n_clusters
    counted = cluster_terms(posts, stop, text)
    return tfidf(counted, vocabulary(term_stats(counted), max_features), n)


def top_terms(weights: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """The `n` heaviest terms of each cluster with their rank; equal weights in term order."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("weight", 9)), "term")
    return (weights.where("weight > 0").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= n).select("cluster_id", "rank", "term", "weight"))


def cluster_keywords(posts: DataFrame, n: int = TOP_TERMS, stop: list[str] | None = None,
                     max_features: int = MAX_FEATURES, n_clusters: int | None = None,
                     text: str = "content") -> DataFrame:
    """Keyword list per cluster, heaviest first."""
    ranked = top_terms(tfidf_weights(posts, stop, max_features, n_clusters, text), n)
    items = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy("cluster_id").agg(F.transform(items, lambda i: i["term"]).alias("keywords"))


def cluster_title(keywords: Column, cluster_id: Column) -> Column:
    """First three keywords in title case, or `Cluster i` where there are none."""
    joined = title_case(F.array_join(F.slice(keywords, 1, 3), " & "))
    return F.when(F.size(keywords) > 0, joined).otherwise(F.concat(F.lit("Cluster "), cluster_id.cast("string")))


def describe_clusters(assigned: DataFrame, ids: DataFrame | None = None, stop: list[str] | None = None,
                      n: int = TOP_TERMS, n_clusters: int | None = None) -> DataFrame:
    """Cluster rows (id, keywords, summary, post_count) of posts with a cluster id.

    `ids` lists clusters that must appear even when they have no posts.
    """
    sizes = assigned.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("post_count"))
    if n_clusters is None and ids is not None:
        n_clusters = ids.count()
    elif n_clusters is None:
        sizes = checkpointed(sizes)  # one row per cluster: sizes and their number in one pass
        n_clusters = sizes.count()
    if ids is not None:
        sizes = ids.select("cluster_id").join(sizes, "cluster_id", "left").fillna(0, ["post_count"])
    words = cluster_keywords(assigned, n, stop, n_clusters=n_clusters)
    none = F.array().cast("array<string>")
    rows = sizes.join(words, "cluster_id", "left").withColumn("keywords", F.coalesce("keywords", none))
    return rows.select(F.col("cluster_id").cast("int").alias("id"), "keywords",
                       cluster_title(F.col("keywords"), F.col("cluster_id")).alias("summary"), "post_count")


def cluster_docs(posts: DataFrame, part_rows: int = 200, text: str = "content") -> DataFrame:
    """Member texts of each cluster in post order, each preceded by a blank, in parts of `part_rows` posts.

    The concatenated parts are the cluster's document. Keyword counting does not need it.
    """
    members = posts.where("cluster_id is not null")
    numbers = positions(members, ["id"], newest_first_order(), group="cluster_id")
    part = (F.floor((F.col("position") - 1) / part_rows) + 1).cast("bigint")
    rows = members.select("id", "cluster_id", text).join(numbers.select("id", "position"), "id").select(
        "cluster_id", part.alias("part"), F.struct("position", F.concat(F.lit(" "), F.col(text)).alias("doc"))
        .alias("item"))
    items = F.array_sort(F.collect_list("item"))
    return rows.groupBy("cluster_id", "part").agg(
        F.array_join(F.transform(items, lambda i: i["doc"]), "").alias("doc"))
