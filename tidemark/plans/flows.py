"""Queries of streams, model scoring, documents and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, ml
from tidemark.plans.base import query, table
from tidemark.plans.rows import ASOF, BINS, _composites
from tidemark.session import folder
from tidemark.sources import catalogue, fetch, tables

#: Weights of the scoring query's linear model: any will do.
WEIGHTS = [round((k % 7 - 3) / 8, 3) for k in range(64)]


@query(f"SELECT vec_id, round(exp(list_dot_product(list_transform(embedding, lambda x: x::double), {WEIGHTS}::double[]) + 0.5), 3) AS pred FROM embeddings")
def q_onnx_score(spark, sf):
    """A linear model of the logarithm, scored from its ONNX file; predictions go back by the exponential."""
    import numpy as np

    out = ml.score_onnx(table(spark, sf, "embeddings"), ml.linear_onnx(WEIGHTS, 0.5), "embedding", inverse=np.exp)
    return out.select("vec_id", F.round("pred", 3).alias("pred"))


def _stream(spark, sf, name):
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


@query(ASOF.format(bins=BINS.format(1995, 1999)))
def q_stream_enrich(spark, sf):
    """Arriving orders enriched with their nearest composite, batch by batch; the result is what the stream wrote."""
    from tidemark.streaming.jobs import enrich_arrivals

    out = folder(spark, "enriched")
    composites = _composites(spark, 1995, 1998)
    enrich = lambda batch: asof.nearest_day(batch, composites, left_time="o_orderdate", right_time="mid", value="path", max_days=30).select("o_orderkey", "path", "gap_days")
    enrich_arrivals(_stream(spark, sf, "orders"), enrich, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("o_orderkey", "path", "gap_days")


@query("SELECT year(ts)::int AS year, ((dayofyear(ts) - 1) // 8)::int AS bin, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def q_stream_windows(spark, sf):
    """Year-anchored windows kept as a stream's state under a watermark; the last update of each day's window counts."""
    from tidemark.streaming.jobs import latest, year_windows

    out = folder(spark, "windows")
    days = latest(year_windows(_stream(spark, sf, "events"), "ts", "value"), f"{out}/rows", f"{out}/state", ("year", "bin", "day"))
    return days.groupBy("year", "bin").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("""WITH RECURSIVE d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS v, row_number() OVER (PARTITION BY event_type ORDER BY strftime(ts, '%Y-%m-%d')) AS k FROM events GROUP BY 1, 2),
 s AS (SELECT event_type, day, v, k, v AS best, 0 AS bad, 1.0::double AS lr_scale FROM d WHERE k = 1 UNION ALL
 SELECT d.event_type, d.day, d.v, d.k, least(s.best, d.v), CASE WHEN d.v < s.best THEN 0 WHEN s.bad + 1 > 3 THEN 0 ELSE s.bad + 1 END, CASE WHEN NOT d.v < s.best AND s.bad + 1 > 3 THEN s.lr_scale * 0.5 ELSE s.lr_scale END FROM s JOIN d ON d.event_type = s.event_type AND d.k = s.k + 1)
 SELECT event_type, day, v, lr_scale FROM s""")
def q_stream_plateau(spark, sf):
    """Daily means arrive in order and each type's state is carried from batch to batch: the rate is halved after more than three days without a new best."""
    from tidemark.streaming.jobs import plateau_states

    out = folder(spark, "plateau")
    days = table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    days.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(days.schema).parquet(f"{out}/in")
    states = plateau_states(stream, "event_type", "day", "v", patience=3, factor=0.5)
    states.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(states.schema).parquet(f"{out}/rows")


@query("SELECT split, count(*) AS n, min(src) AS first_src, max(dst) AS last_dst FROM (SELECT 'in/' || p_partkey || '.png' AS src, 'out/' || split || '/' || p_partkey || '.png' AS dst, split FROM (SELECT p_partkey, CASE WHEN p_size < 20 THEN 'train' ELSE 'val' END AS split FROM part)) GROUP BY split")
def q_manifest(spark, sf):
    files = table(spark, sf, "part").select(F.concat(F.lit("in/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), F.when(F.col("p_size") < 20, "train").otherwise("val").alias("split"))
    m = tables.split_manifest(files, "out/").withColumn("split", F.element_at(F.split("dst", "/"), -2))
    return m.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_src"), F.max("dst").alias("last_dst"))


@query("SELECT doc_id::varchar AS path, doc_id % 3 <> 0 AS ok FROM documents WHERE text IS NOT NULL")
def q_checksums(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    sums = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 3 != 0, F.upper(F.sha1(F.col("text").cast("binary")))).otherwise("0").alias("sha1"))
    return fetch.checked(files, sums)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01' AND o_orderkey % 50 < 30 AND o_orderkey % 360 + 3 >= 100 AND o_orderkey % 360 <= 200")
def q_catalogue_search(spark, sf):
    k = F.col("o_orderkey")
    x = (k % 360).cast("double")
    items = table(spark, sf, "orders").select(k.alias("id"), F.col("o_orderdate").alias("datetime"), F.col("o_orderpriority").alias("collection"), F.create_map(F.lit("eo:cloud_cover"), (k % 50).cast("string")).alias("properties"), F.struct(x.alias("xmin"), F.lit(0.0).alias("ymin"), (x + 3).alias("xmax"), F.lit(1.0).alias("ymax")).alias("bbox"))
    return catalogue.search(items, collection="1-URGENT", start="1996-01-01", end="1997-12-31", area=(100.0, 0.0, 200.0, 1.0), cloud=30.0).select("id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'a/' || s_suppkey WHEN s_suppkey % 6 = 1 THEN 'b/' || s_suppkey END AS resolved FROM supplier")
def q_first_existing(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select("s_suppkey")
    listing = s.where("s_suppkey % 4 = 0").select(F.concat(F.lit("a/"), k.cast("string")).alias("path")).unionByName(s.where("s_suppkey % 6 = 1 or s_suppkey % 8 = 0").select(F.concat(F.lit("b/"), k.cast("string")).alias("path")))
    return asof.first_existing(s, [F.concat(F.lit("a/"), k.cast("string")), F.concat(F.lit("b/"), k.cast("string"))], listing)


@query("SELECT day, n, total FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) JOIN (SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 2) AS total FROM (SELECT ts + INTERVAL 3 DAY AS ts, value FROM events) GROUP BY 1) USING (day)")
def q_joined_curves(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    e = table(spark, sf, "events")
    later = e.withColumn("ts", F.col("ts") + F.expr("interval 3 days"))
    return ml.joined_curves(e.groupBy(day).agg(F.count(F.lit(1)).alias("n")), later.groupBy(day).agg(F.round(F.sum("value"), 2).alias("total")), "day")
