"""Queries of source features and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes
from ..functions import source_features as SF
from ..operators import clustering as C
from ..operators import density, layout
from ..operators.skew import spread
from ..sources import views
from ..sources.views import sql
from ..streaming.jobs import keep


def _text(spark, sf_dir):
    """Packages with a text that is not empty."""
    return views.sources(spark, sf_dir).select("address", SF.joined_text(F.col("files")).alias("text")).where("text <> ''")


def _features(group):
    def run(spark, sf_dir):
        return _text(spark, sf_dir).select("address", *[F.round(c, 6).alias(k) for k, c in group(F.col("text")).items()])

    return run


def src_feature_vector(spark, sf_dir):
    """The 92 features in sorted order, as text of the vector."""
    found = SF.with_features(spread(views.sources(spark, sf_dir)).select("address", SF.joined_text(F.col("files")).alias("text")).where("text <> ''"))
    return found.select("address", F.array_join(F.array(*[F.round(F.col(c) * 1000).cast("bigint") for c in SF.feature_names()]).cast("array<string>"), ",").alias("features"))


def non_factory_source(spark, sf_dir):
    return views.sources(spark, sf_dir).select("address", notes.non_factory_source(SF.joined_text(F.col("files"))).alias("accepted"))


def _points(spark, sf_dir):
    """Vectors with a plane position, some of them repeated under another id."""
    v = views.vectors(spark, sf_dir)
    rows = v.unionByName(v.where("id % 5 = 0").withColumn("id", F.col("id") + 1000000).withColumn("label", (F.col("label") + 1) % 3))
    return rows.withColumn("weight", (F.col("id") % 7 + 1).cast("double")).withColumn("px", F.element_at("x", 1)).withColumn("py", F.element_at("x", 2))


def standardise(spark, sf_dir):
    rows = C.standardise(views.vectors(spark, sf_dir))
    return rows.select("id", F.round(F.element_at("x", 1), 6).alias("x1"), F.round(F.element_at("x", 2), 6).alias("x2"), F.round(F.element_at("x", 64), 6).alias("x64"))


def _rounded(df, col):
    return df.select("id", *[F.round(F.element_at(col, k + 1), 6).alias(f"c{k}") for k in range(3)])


def pca_scores(spark, sf_dir):
    return _rounded(C.principal_scores(C.standardise(views.vectors(spark, sf_dir)), 12), "scores")


def varimax_scores(spark, sf_dir):
    return _rounded(C.varimax_scores(C.standardise(views.vectors(spark, sf_dir)), 12), "scores")


def embed_pca2(spark, sf_dir):
    return C.principal_scores(views.vectors(spark, sf_dir), 2).select("id", F.element_at("scores", 1).alias("px"), F.element_at("scores", 2).alias("py"))


def embed_neighbours(spark, sf_dir):
    """Plane positions by the graph of nearest neighbours."""
    return layout.neighbour_layout(views.vectors(spark, sf_dir), keep)


def embed_preservation(spark, sf_dir):
    """The share of each vector's 15 nearest that stay its 15 nearest in the plane, by principal components and by the graph."""
    v = views.vectors(spark, sf_dir)
    known = layout.nearest(v, keep)
    by = {"neighbours": keep(layout.neighbour_layout(v, keep, known=known)), "principal": keep(embed_pca2(spark, sf_dir))}
    one, two = (layout.preservation(v, at, keep, known=known).select(F.lit(name).alias("method"), "preserved") for name, at in by.items())
    return one.union(two)


def kmeans_fixed(spark, sf_dir):
    """Clusters and their sizes, with the quality of the whole."""
    found = C.kmeans(views.vectors(spark, sf_dir), 4)
    return found.groupBy("label").agg(F.count("*").alias("n")).withColumns({k: F.lit(v) for k, v in C.quality_of(found).items()})


def kmeans_select(spark, sf_dir):
    return C.select_k(views.vectors(spark, sf_dir), 2, 4)


def density_clusters(spark, sf_dir):
    """Each vector's cluster, named by its smallest id; -1 is noise."""
    return density.density_clusters(views.vectors(spark, sf_dir), keep)


def density_quality(spark, sf_dir):
    return density.density_quality(density_clusters(spark, sf_dir))


def centroid_silhouette(spark, sf_dir):
    return C.centroid_silhouette(views.vectors(spark, sf_dir)).select(F.round("silhouette", 6).alias("silhouette"))


def silhouette(spark, sf_dir):
    return C.silhouette(views.vectors(spark, sf_dir)).select(F.round("silhouette", 6).alias("silhouette"))


def davies_bouldin(spark, sf_dir):
    return C.davies_bouldin(views.vectors(spark, sf_dir)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


def cluster_feature_means(spark, sf_dir):
    return C.feature_means(views.vectors(spark, sf_dir)).select("label", "k", F.round("mean", 6).alias("mean"))


def cluster_top_features(spark, sf_dir):
    return C.top_features(views.vectors(spark, sf_dir)).select("label", "k", F.round("mean", 6).alias("mean"), F.col("place").cast("bigint").alias("place"))


def cluster_summary(spark, sf_dir):
    """Sizes and top features, the features as text."""
    top = C.top_features(views.vectors(spark, sf_dir)).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "k"))), lambda s: s["k"].cast("string")), ",").alias("top"))
    return C.summary(views.vectors(spark, sf_dir)).drop("top").join(top, "label")


def cluster_centroids(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("label").agg(F.round(F.avg("px"), 6).alias("cx"), F.round(F.avg("py"), 6).alias("cy"))


def vector_dedup(spark, sf_dir):
    out = C.dedup_vectors(_points(spark, sf_dir))
    return out.select("id", "label", "n", "weight", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


def rotate_points(spark, sf_dir):
    return C.rotate(_points(spark, sf_dir), 90.0, "bbox").select("id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


def outlier_trim(spark, sf_dir):
    return C.trim_outliers(_points(spark, sf_dir), 0.1, keep).select("id", "label")


def cluster_hulls(spark, sf_dir):
    return C.convex_hulls(_points(spark, sf_dir))


def sample_per_cluster(spark, sf_dir):
    return C.sample_per_cluster(views.vectors(spark, sf_dir), 20).select("id", "label")


QUERIES = {
    "src_counts": _features(SF.counts), "src_size": _features(SF.sizes), "src_flags": _features(SF.flags), "src_ratios": _features(SF.ratios), "src_libs": _features(SF.libraries), "src_bow": _features(SF.bag_of_words), "src_name_tokens": _features(SF.name_tokens),
} | {f.__name__: f for f in (src_feature_vector, non_factory_source, standardise, pca_scores, varimax_scores, embed_pca2, embed_neighbours, embed_preservation, kmeans_fixed, kmeans_select, density_clusters, density_quality, silhouette, centroid_silhouette, davies_bouldin, cluster_feature_means, cluster_top_features, cluster_summary, cluster_centroids, vector_dedup, rotate_points, outlier_trim, cluster_hulls, sample_per_cluster)}


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _count(p: str, text: str = "content") -> str:
    return f"CAST(len(regexp_extract_all({text}, {_q(p)})) AS DOUBLE)"


def _flag(p: str) -> str:
    return f"CAST(regexp_matches(content, {_q(p)}) AS DOUBLE)"


_PUB, _EXT = _count(r"\bpublic\b"), _count(r"\bexternal\b")
_USED = f"regexp_extract_all(content, {_q(SF.USING)}, 1)"
_NAMES = f"list_transform(regexp_extract_all(content, {_q(SF.COUNTS['n_contracts'])}, 1), lambda n: lower(n))"
GROUPS = {
    "src_counts": {k: _count(p) for k, p in SF.COUNTS.items()},
    "src_size": {"n_lines": "CAST(len(regexp_extract_all(content, '\\n')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END AS DOUBLE)", "n_chars": "CAST(length(content) AS DOUBLE)"},
    "src_flags": {k: _flag(p.replace("|(?i)", "|")) for k, p in SF.FLAGS.items()},
    "src_ratios": {"public_ratio": f"round({_PUB} / greatest({_PUB} + {_EXT}, 1), 6)", "external_ratio": f"round({_EXT} / greatest({_PUB} + {_EXT}, 1), 6)"},
    "src_libs": {"n_using": f"CAST(len({_USED}) AS DOUBLE)", "n_library_decl": _count(SF.LIBRARY), "n_distinct_using": f"CAST(len(list_distinct({_USED})) AS DOUBLE)"} | {f"lib_{x}": _flag(rf"\b{x}\b") for x in SF.LIBRARIES},
    "src_bow": {f"bow_{t}": _count(rf"\b{t}\b", "lower(content)") for t in SF.TERMS},
    "src_name_tokens": {f"name_{t}": f"CAST(len(list_filter({_NAMES}, lambda n: contains(n, '{t}'))) AS DOUBLE)" for t in SF.NAME_TOKENS},
}
_ALL = dict(sorted({k: v for g in GROUPS.values() for k, v in g.items()}.items()))
_VECTOR = "array_to_string([" + ", ".join(f"CAST(round(({v}) * 1000) AS BIGINT)" for v in _ALL.values()) + "], ',')"
_LONG = "l AS (SELECT id, label, unnest(x) AS v, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS k FROM v_vectors)"
_MEANS = f"{_LONG}, m AS (SELECT label, k, avg(v) AS mean FROM l GROUP BY label, k)"
_TOP = f"{_MEANS}, t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(mean) DESC, k) AS place FROM m QUALIFY place <= 5)"
_C = f"{_MEANS}, c AS (SELECT label, list(mean ORDER BY k) AS c FROM m GROUP BY label), d AS (SELECT v.id, v.label, c.label AS other, list_distance(v.x, c.c) AS d FROM v_vectors v, c)"
_PTS = "p AS (SELECT *, CAST(id % 7 + 1 AS DOUBLE) AS weight, x[1] AS px, x[2] AS py FROM (SELECT id, label, x FROM v_vectors UNION ALL SELECT id + 1000000, (label + 1) % 3, x FROM v_vectors WHERE id % 5 = 0))"


def _v(text: str) -> str:
    return sql(text, "vectors")


ORACLE_SQL = {k: sql(f"SELECT address, {', '.join(f'{e} AS {n}' for n, e in g.items())} FROM v_sources WHERE content <> ''", "sources") for k, g in GROUPS.items()} | {
    "src_feature_vector": sql(f"SELECT address, {_VECTOR} AS features FROM v_sources WHERE content <> ''", "sources"),
    "non_factory_source": sql("SELECT address, content <> '' AND NOT (" + " OR ".join(f"contains(lower(content), '{w}')" for w in notes.FACTORY_WORDS) + ") AS accepted FROM v_sources", "sources"),
    "standardise": _v(f"WITH {_LONG}, s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS sd FROM l GROUP BY k), z AS (SELECT id, k, CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END AS z FROM l JOIN s USING (k)) SELECT id, round(max(z) FILTER (k = 0), 6) AS x1, round(max(z) FILTER (k = 1), 6) AS x2, round(max(z) FILTER (k = 63), 6) AS x64 FROM z GROUP BY id"),
    "silhouette": _v("WITH n AS (SELECT label, count(*) AS n FROM v_vectors GROUP BY 1), d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS d FROM v_vectors a, v_vectors b GROUP BY ALL), s AS (SELECT d.id, d.label, max(n.n) FILTER (d.label = other) AS own, max(d / nullif(n.n - 1, 0)) FILTER (d.label = other) AS a, min(d / n.n) FILTER (d.label <> other) AS b FROM d JOIN n ON n.label = d.other GROUP BY ALL) SELECT round(avg(CASE WHEN b IS NULL THEN NULL WHEN own = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM s"),
    "centroid_silhouette": _v(f"WITH {_C}, s AS (SELECT id, min(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM d GROUP BY id) SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM s"),
    "davies_bouldin": _v(f"WITH {_C}, s AS (SELECT label, avg(d) AS s FROM d WHERE label = other GROUP BY label), r AS (SELECT a.label, max((a.s + b.s) / list_distance(ca.c, cb.c)) AS r FROM s a JOIN s b ON a.label <> b.label JOIN c ca ON ca.label = a.label JOIN c cb ON cb.label = b.label GROUP BY a.label) SELECT round(avg(r), 6) AS davies_bouldin FROM r"),
    "cluster_feature_means": _v(f"WITH {_MEANS} SELECT label, k, round(mean, 6) AS mean FROM m"),
    "cluster_top_features": _v(f"WITH {_TOP} SELECT label, k, round(mean, 6) AS mean, place FROM t"),
    "cluster_summary": _v(f"WITH {_TOP} SELECT label, (SELECT count(*) FROM v_vectors v WHERE v.label = t.label) AS size, string_agg(CAST(k AS VARCHAR), ',' ORDER BY place) AS top FROM t GROUP BY label"),
    "cluster_centroids": _v(f"WITH {_PTS} SELECT label, round(avg(px), 6) AS cx, round(avg(py), 6) AS cy FROM p GROUP BY label"),
    "vector_dedup": _v(f"WITH {_PTS}, k AS (SELECT *, list_transform(x, lambda v: round(v, 6)) AS key FROM p), b AS (SELECT key, label, count(*) AS n, min(id) AS first FROM k GROUP BY ALL), w AS (SELECT key, label FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first) = 1) SELECT min(k.id) AS id, any_value(w.label) AS label, count(*) AS n, sum(weight) AS weight, round(avg(px), 6) AS px, round(avg(py), 6) AS py FROM k JOIN w ON w.key = k.key GROUP BY k.key"),
    "rotate_points": _v(f"WITH {_PTS}, c AS (SELECT (min(px) + max(px)) / 2 AS cx, (min(py) + max(py)) / 2 AS cy FROM p) SELECT id, round((px - cx) * cos(radians(90)) - (py - cy) * sin(radians(90)) + cx, 6) AS px, round((px - cx) * sin(radians(90)) + (py - cy) * cos(radians(90)) + cy, 6) AS py FROM p, c"),
    "outlier_trim": _v(f"WITH {_PTS}, c AS (SELECT label, avg(px) AS cx, avg(py) AS cy, count(*) AS n FROM p GROUP BY label), d AS (SELECT p.id, p.label, n, sqrt((px - cx) ** 2 + (py - cy) ** 2) AS d FROM p JOIN c USING (label)), b AS (SELECT label, quantile_cont(d, 0.9) AS b FROM d GROUP BY label) SELECT id, label FROM d JOIN b USING (label) WHERE n < 10 OR d <= b"),
}
