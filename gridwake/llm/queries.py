"""The queries of the llm problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import components, leakage, packing, percentiles, repetition
from gridwake.sources.tables import table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
CAPACITY = 2048


def plain(text: Column) -> Column:
    """Parts in lower case with one underscore between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def site_of(region: Column) -> Column:
    """The id up to ``_presence`` or ``_absence`` without a trailing ``_val``; an id with neither is its own site."""
    head = F.regexp_replace(F.regexp_extract(region, "^(.+?)_(presence|absence)", 1), "_val$", "")
    return F.when(head != "", head).otherwise(region)


def code_of(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), F.lit(""))


def region_of(point: Column) -> Column:
    return F.regexp_replace(point, "_[0-9]+_[0-9]+$", "")


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(vertex, name)`` and edges of regions, sites, crews, science points and recorders.

    A name is what a group may be called after: a region's id, a recorder's code, or the id of a point
    without recorder. Regions meet over their sites and crews, never in pairs.
    """
    regions = table(spark, d, "training_regions").where("id IS NOT NULL").select(
        "id", "tags", plain(F.col("id")).alias("p")
    )
    node = lambda kind, c: F.concat(F.lit(kind), c)
    vertices = regions.select(node("r:", F.col("p")).alias("vertex"), F.col("id").alias("name"))
    edges = regions.select(node("r:", F.col("p")).alias("a"), node("s:", site_of(F.col("p"))).alias("b"))
    tags = regions.select("p", F.explode("tags").alias("tag"))
    crew = code_of(
        F.nullif(F.regexp_extract(F.col("tag"), "(?i)^[^a-z0-9]*crew([^a-z].*|[a-z]*[0-9].*)$", 1), F.lit(""))
    )
    edges = edges.unionByName(tags.select(node("r:", F.col("p")).alias("a"), node("c:", crew).alias("b")))
    points = table(spark, d, "science_points").where("point_id IS NOT NULL").groupBy("point_id").agg(
        F.max("recordedBy").alias("by")
    ).select(
        "point_id", plain(F.col("point_id")).alias("p"), code_of(F.col("by")).alias("code")
    )
    vertices = vertices.unionByName(
        points.select(node("p:", F.col("p")).alias("vertex"), F.coalesce("code", "point_id").alias("name"))
    )
    edges = edges.unionByName(points.select(node("p:", F.col("p")).alias("a"), node("k:", F.col("code")).alias("b")))
    return vertices, edges


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tam_samples").where("sample_id IS NOT NULL").groupBy("sample_id").agg(
        F.max("point_id").alias("point_id"), F.max("label").alias("label")
    )


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with its label and group; a sample of an unknown region belongs to that region's site."""
    vertices, edges = _entities(spark, d)
    samples = _samples(spark, d).withColumn("p", plain(F.col("point_id")))
    known = vertices.where("vertex LIKE 'p:%'").select(
        F.substring("vertex", 3, 1 << 20).alias("p"), F.lit(True).alias("is_point")
    ).distinct()
    samples = samples.join(known, "p", "left").withColumn(
        "at", F.when(F.col("is_point"), F.col("p")).otherwise(region_of(F.col("p")))
    )
    samples = samples.withColumn("vertex", F.concat(F.when(F.col("is_point"), "p:").otherwise("r:"), "at"))
    strays = samples.where("is_point IS NULL AND at IS NOT NULL").select("at").distinct()
    edges = edges.unionByName(
        strays.select(F.concat(F.lit("r:"), "at").alias("a"), F.concat(F.lit("s:"), site_of(F.col("at"))).alias("b"))
    )
    found = components.connected_components(edges, vertices.select("vertex"))
    names = found.join(vertices, "vertex").groupBy("component").agg(F.min("name").alias("grp"))
    named = found.join(names, "component", "left").select("vertex", "grp")
    return samples.join(named, "vertex", "left").select("sample_id", "label", F.coalesce("grp", "at").alias("grp"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_groups(spark, d).select("sample_id", "grp")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with its group and split."""
    samples = p1_groups(spark, d)
    weights = samples.groupBy("grp").agg(F.count(F.lit(1)).alias("weight"))
    splits = components.split_groups(weights, "grp", "weight", SHARES)
    return samples.join(splits.select("grp", "split"), "grp", "left").select(
        "sample_id", "label", "grp", F.coalesce("split", F.lit("train")).alias("split")
    )


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Usable readings as ``(batch_no, site, signal, label, v)``, each obs_id once.

    Regions are joined first, while that is a look-up; then a reading's latest delivery is kept by its number, which spreads evenly.
    """
    ndvi = F.when((F.col("scl_purity") == 1) & F.col("NDVI").between(-1, 1) & ~F.isnan("NDVI"), F.col("NDVI"))
    vh = F.when((F.col("vh") > 0) & ~F.isnan("vh"), F.col("vh"))
    wanted = table(spark, d, "observations").where("obs_id IS NOT NULL").select(
        "obs_id", "batch_no", region_of(F.col("point_id")).alias("id"), ndvi.alias("ndvi"), vh.alias("vh")
    )
    regions = table(spark, d, "training_regions").where("id IS NOT NULL").groupBy("id").agg(
        F.min("label").alias("label")
    ).withColumn("site", site_of(F.col("id")))
    placed = wanted.where("ndvi IS NOT NULL OR vh IS NOT NULL").join(regions, "id")
    once = placed.groupBy("obs_id").agg(
        F.min(F.struct("batch_no", "site", "label", "ndvi", "vh")).alias("r")
    ).select("r.*")
    signals = F.array(
        F.struct(F.lit("ndvi").alias("signal"), F.col("ndvi").alias("v")),
        F.struct(F.lit("s1_vh").alias("signal"), F.col("vh").alias("v"))
    )
    return once.select(
        "batch_no", "site", "label", F.explode(signals).alias("r")
    ).select("batch_no", "site", "r.signal", "label", "r.v").where("v IS NOT NULL")


BATCH, ALL = ["batch_no", "site", "signal", "label"], ["site", "signal", "label"]
QUARTERS = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Stated percentiles against the order statistics at the edges of the allowed ranks (4 % of the readings)."""
    ranks = {}
    for name, percent in (("p25", 25), ("median", 50), ("p75", 75)):
        # More than f + 0.04 of the readings lie below v just if this one does, in whole numbers.
        ranks[f"below_{name}"] = lambda n, p=percent + 4: F.expr(f"(n_rows * {p}) DIV 100 + 1")
        # Fewer than f - 0.04 lie at or below v just if this one lies above it.
        ranks[f"above_{name}"] = lambda n, p=percent - 4: F.expr(f"(n_rows * {p} + 99) DIV 100")
    found = percentiles.order_statistics(_readings(spark, d), BATCH, "v", ranks)
    stated = table(spark, d, "class_stats")
    wrong = None
    for name in QUARTERS:
        this = F.coalesce(F.col(f"below_{name}") < F.col(name), F.lit(False)) | F.coalesce(
            F.col(f"above_{name}") > F.col(name), F.lit(False)
        )
        wrong = this if wrong is None else wrong | this
    return stated.join(found, BATCH).where(wrong).select(*BATCH).distinct()


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.col("n_rows").alias("n"), *[F.round(q, 6).alias(q) for q in QUARTERS])


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles per batch, site, signal and label."""
    return _rounded(percentiles.percentiles(_readings(spark, d), BATCH, "v", QUARTERS), BATCH)


def p4_combined(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles per site, signal and label, combined from the summaries of the batches."""
    batches = percentiles.summary(_readings(spark, d), BATCH, "v")
    return _rounded(
        percentiles.percentiles(percentiles.summary(batches, ALL, "value", "n"), ALL, "value", QUARTERS, "n"), ALL
    )


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled: their number, the least possible number, and the used share."""
    used = p8_packed(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("n") / CAPACITY).alias("at_least"),
        F.max("n").alias("fullest"), F.round(F.sum("n") / (F.count(F.lit(1)) * CAPACITY), 6).alias("used")
    )


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """All overlaps around seed hits, with substitutions."""
    items = table(spark, d, "eval_items").dropDuplicates(["item_id"])
    return leakage.leaks(table(spark, d, "documents"), items, "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_overlaps(spark, d).where("longest_run >= 12").select("doc_id", "item_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated words of every document."""
    return repetition.repetition(table(spark, d, "documents"), "doc_id", "text", 8)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_shares(spark, d).where("share >= 0.3").select("doc_id")


def p10_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Every document's perplexity under the corpus model of its language, and whether it lies in the language's band."""
    docs = table(spark, d, "documents")
    model = repetition.kneser_ney(repetition.count_trigrams(docs, "text", "lang"))
    return repetition.bands(repetition.perplexity(docs, "doc_id", "text", "lang", model), 0.01, 0.99)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p1_splits, p4_found, p4_percentiles, p4_combined, p8_packed, p8_fill, p9_found,
        p9_overlaps, p10_found, p10_shares, p10_perplexity
    )
}

_READINGS = """
WITH o AS (SELECT DISTINCT ON (obs_id) * FROM observations),
     t AS (SELECT id, label, CASE WHEN regexp_matches(id, '_(presence|absence)') THEN regexp_replace(regexp_extract(id, '^(.+?)_(presence|absence)', 1), '_val$', '') ELSE id END AS site FROM training_regions),
     a AS (SELECT *, regexp_replace(point_id, '_[0-9]+_[0-9]+$', '') AS id FROM o),
     r AS (SELECT batch_no, site, 'ndvi' AS signal, label, NDVI::DOUBLE AS v FROM a JOIN t USING (id) WHERE scl_purity = 1 AND NDVI BETWEEN -1 AND 1 AND NOT isnan(NDVI)
           UNION ALL SELECT batch_no, site, 's1_vh', label, vh::DOUBLE FROM a JOIN t USING (id) WHERE vh > 0 AND NOT isnan(vh))
"""

_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
_SITE = "CASE WHEN regexp_matches({0}, '^.+?_(presence|absence)') THEN regexp_replace(regexp_extract({0}, '^(.+?)_(presence|absence)', 1), '_val$', '') ELSE {0} END"
_GROUPS = f"""
WITH RECURSIVE t AS (SELECT id, p, {_SITE.format('p')} AS site, tags FROM (SELECT id, {_PLAIN.format('id')} AS p, tags FROM training_regions)),
     c AS (SELECT id, regexp_replace(lower(regexp_extract(tag, '(?i)^[^a-z0-9]*crew([^a-z].*|[a-z]*[0-9].*)$', 1)), '[^a-z0-9]', '', 'g') AS crew FROM (SELECT id, unnest(tags) AS tag FROM t)),
     e AS (SELECT x.id AS a, y.id AS b FROM t x JOIN t y USING (site) UNION SELECT x.id, y.id FROM c x JOIN c y USING (crew) WHERE crew != ''),
     reach(a, b) AS (SELECT id, id FROM t UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
     g AS (SELECT p, site, min(b) AS grp FROM reach JOIN t ON t.id = a GROUP BY ALL),
     w AS (SELECT site, min(grp) AS grp FROM g GROUP BY 1),
     s AS (SELECT sample_id, max(label) AS label, {_PLAIN.format('max(point_id)')} AS p FROM tam_samples WHERE sample_id IS NOT NULL GROUP BY 1),
     k AS (SELECT {_PLAIN.format('point_id')} AS p, coalesce(nullif(regexp_replace(lower(max(recordedBy)), '[^a-z0-9]', '', 'g'), ''), point_id) AS grp FROM science_points WHERE point_id IS NOT NULL GROUP BY point_id),
     r AS (SELECT s.*, k.grp AS point_grp, regexp_replace(s.p, '_[0-9]+_[0-9]+$', '') AS base FROM s LEFT JOIN k USING (p))
"""
_GROUP = f"coalesce(point_grp, g.grp, w.grp, base) AS grp FROM r LEFT JOIN g ON g.p = base LEFT JOIN w ON w.site = {_SITE.format('base')}"

SQL = {
    "p1_found": _GROUPS + f"SELECT sample_id, {_GROUP}",
    "p1_groups": _GROUPS + f"SELECT sample_id, label, {_GROUP}",
    "p4_found": _READINGS + """, s AS (SELECT * FROM class_stats UNPIVOT (v FOR q IN (p25, median, p75)))
SELECT DISTINCT batch_no, site, signal, label FROM
 (SELECT s.batch_no, s.site, s.signal, s.label, CASE q WHEN 'p25' THEN 25 WHEN 'median' THEN 50 ELSE 75 END AS f, count(*) AS n, count(*) FILTER (r.v < s.v) AS below, count(*) FILTER (r.v <= s.v) AS upto
  FROM s JOIN r USING (batch_no, site, signal, label) GROUP BY ALL) WHERE 100 * below > (f + 4) * n OR 100 * upto < (f - 4) * n""",
    "p4_percentiles": _READINGS
    + "SELECT batch_no, site, signal, label, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS p25, "
    "round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75 FROM r GROUP BY ALL",
    "p4_combined": _READINGS
    + "SELECT site, signal, label, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, "
    "0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75 FROM r GROUP BY ALL",
}
