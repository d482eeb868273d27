"""A stored collection of posts: the operators put together over versioned Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators import charts, clustering, exports, ingest, keywords, labels, reports
from postloom.operators.extract import extract_detail, extract_posts
from postloom.schemas import ASSIGNMENTS, CLUSTERS, POSTS
from postloom.session import checkpointed, is_small
from postloom.sources.store import read_version, versions, write_version
from postloom.sources.tables import load_clusters, load_posts

WRITERS = {
    "csv": (exports.export_flat, exports.write_flat),
    "json": (exports.export_nested, exports.write_nested),
    "md": (exports.export_markdown, exports.write_markdown),
}


class PostLibrary:
    """Posts and clusters under one folder. Every change writes a new version of the table it changes.

    The clusters of the posts stand in a narrow table `(id, cluster_id)` of their own that is joined on read, so
    a clustering does not rewrite the texts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.posts_path = f"{path.rstrip('/')}/posts"
        self.clusters_path = f"{path.rstrip('/')}/clusters"
        self.assignments_path = f"{path.rstrip('/')}/assignments"

    def posts(self) -> DataFrame:
        stored = read_version(self.spark, self.posts_path, schema=POSTS)
        if not versions(self.spark, self.assignments_path):
            return stored
        return ingest.apply_assignments(stored, read_version(self.spark, self.assignments_path))

    def clusters(self) -> DataFrame:
        return read_version(self.spark, self.clusters_path, schema=CLUSTERS)

    def sync(self, pages: DataFrame, max_new: int | None = None, details: DataFrame | None = None,
             engagement: bool = False) -> dict[str, int]:
        """Take in the posts of result pages that are not stored yet; returns the counts of the run.

        `details` are pages of single posts `(id, html)` that complete text and links. `engagement` reads the
        counts of likes and comments from the pages.
        """
        stored = self.posts()
        found = extract_posts(pages, engagement=engagement).withColumn("ord", F.struct("page_id", "pos")).drop("page_id", "pos")
        # The extracted posts are read several times below.
        seen = checkpointed(ingest.first_seen(found))
        fresh = ingest.cap(ingest.new_only(seen, stored, small=is_small(seen.select("id"))), max_new)
        if details is not None:
            wanted = details.join(fresh.select("id"), "id", "left_semi")
            fresh = ingest.enrich_merge(fresh, extract_detail(wanted))
        fresh = checkpointed(fresh)
        result, counts = ingest.upsert_posts(stored, fresh)
        if not fresh.isEmpty():
            write_version(result.select(*POSTS.names), self.posts_path)
        row = counts.first()
        scanned = ingest.ingest_counts(seen.select("id", "ord"), stored, max_new).first()
        return {"synced": row["new"] + row["updated"], "new": row["new"], "updated": row["updated"],
                "skipped": scanned["skipped"], "total": self.posts().count()}

    def save(self, batch: DataFrame) -> dict[str, int]:
        """Upsert given posts (with their order of arrival `ord`)."""
        result, counts = ingest.upsert_posts(self.posts(), batch)
        write_version(result.select(*POSTS.names), self.posts_path)
        return counts.first().asDict()

    def cluster(self, k: int | None = None, min_size: int | None = None, vectors: DataFrame | None = None,
                stop: list[str] | None = None, **options) -> DataFrame:
        """Group the posts into topics and store both tables; raises below six posts."""
        posts = reports.require_min(self.posts())
        stop = keywords.english_stop_words() if stop is None else stop
        assignments, clusters = clustering.cluster_posts(posts, k, vectors=vectors, stop=stop, min_size=min_size,
                                                         **options)
        return self._store_clustering(posts, assignments, clusters)

    def apply_labels(self, replies: DataFrame) -> DataFrame:
        """Take over topics from the replies `(reply_id, reply)` of an external labeller."""
        posts = reports.require_min(self.posts())
        numbered = checkpointed(labels.number_labels(labels.parse_labels(replies)))
        clusters = labels.labels_to_clusters(posts, numbered).withColumn("created_at", F.current_timestamp())
        return self._store_clustering(posts, labels.labels_to_assignments(posts, numbered), clusters)

    def _store_clustering(self, posts: DataFrame, assignments: DataFrame, clusters: DataFrame) -> DataFrame:
        # Posts that were clustered before and are no longer get a null.
        cleared = posts.select("id", F.lit(None).cast("int").alias("cluster_id"))
        write_version(clusters.select(*CLUSTERS.names), self.clusters_path)
        write_version(ingest.apply_assignments(cleared, assignments).select(*ASSIGNMENTS.names), self.assignments_path)
        return self.clusters()

    def clear(self) -> None:
        """Forget the clustering."""
        posts, clusters = ingest.clear_clusters(self.posts(), self.clusters())
        write_version(clusters, self.clusters_path)
        write_version(posts.select(*ASSIGNMENTS.names), self.assignments_path)

    def list_posts(self, cluster_id: int | None = None) -> DataFrame:
        return load_posts(self.posts(), cluster_id)

    def list_clusters(self) -> DataFrame:
        return load_clusters(self.clusters())

    def status(self) -> DataFrame:
        return reports.status(self.posts(), self.clusters())

    def show(self, cluster_id: int | None = None) -> DataFrame:
        """All clusters, or the numbered posts of one."""
        if cluster_id is None:
            return reports.cluster_summary(self.list_clusters())
        return reports.cluster_detail(self.posts(), self.clusters(), cluster_id).orderBy("number")

    def export(self, fmt: str, path: str, cluster_id: int | None = None) -> None:
        """Write `csv`, `json` or `md`; raises without clusters or for an unknown cluster."""
        make, write = WRITERS[fmt]
        write(make(self.posts(), self.clusters(), cluster_id), path)

    def chart_tables(self, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
        """Data of the charts; the projection needs vectors `(id, embedding)`."""
        posts, clusters = self.posts(), reports.pick_clusters(self.clusters())
        tables = {"treemap": charts.treemap_nodes(posts, clusters), "nodes": charts.network_nodes(posts, clusters),
                  "edges": charts.network_edges(posts, clusters)}
        if vectors is not None:
            tables["scatter"] = charts.scatter_points(posts, clusters, vectors)
        return tables
