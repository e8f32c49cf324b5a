"""Queries of gates, parsing, names, calendars and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo, names, numeric, parse
from tidemark.operators import asof, calendars, quality, ranking
from tidemark.plans.base import query, table

GATES = """CASE WHEN l_quantity < 5 THEN 'low_quantity' WHEN l_discount > 0.08 THEN 'high_discount'
 WHEN abs(l_tax) <= 1e-10 AND abs(l_discount) <= 1e-10 THEN 'all_zero' WHEN l_returnflag IS NULL THEN 'no_flag' END"""


def _gated(spark, sf):
    gates = [("low_quantity", F.col("l_quantity") < 5), ("high_discount", F.col("l_discount") > 0.08), ("all_zero", parse.near_zero(F.col("l_tax")) & parse.near_zero(F.col("l_discount"))), ("no_flag", F.col("l_returnflag").isNull())]
    return quality.with_reason(table(spark, sf, "lineitem"), gates)


@query(f"SELECT reason, count(*) AS n FROM (SELECT {GATES} AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY reason")
def q_gate_reason(spark, sf):
    return quality.reason_counts(_gated(spark, sf))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, {GATES} AS reason FROM lineitem) WHERE reason IS NULL")
def q_gate_kept(spark, sf):
    return quality.kept(_gated(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


CHIPS = "l_orderkey || '-' || l_linenumber AS tile, cast(l_orderkey as varchar) AS scene_id, cast(cast(l_quantity * 40 as int) as varchar) AS valid_px, cast(l_discount * 4 as varchar) AS ndwi_mean"


@query("""SELECT CASE WHEN floor(l_quantity * 40) < 1024 THEN 'low_valid_px' WHEN l_discount * 4 > 0.25 THEN 'high_ndwi' END AS reason, count(*) AS n
 FROM lineitem WHERE floor(l_quantity * 40) < 1024 OR l_discount * 4 > 0.25 GROUP BY 1""")
def q_chip_gates(spark, sf):
    li = table(spark, sf, "lineitem")
    chips = li.select(F.col("l_orderkey").cast("string").alias("scene_id"), F.floor(F.col("l_quantity") * 40).cast("string").alias("valid_px"), (F.col("l_discount") * 4).cast("string").alias("ndwi_mean"))
    return quality.reason_counts(quality.with_reason(chips, quality.chip_gates(chips)))


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE trim(p_brand) = 'Brand#2' AND trim(p_type) = 'ECONOMY'")
def q_keep_filter(spark, sf):
    return quality.keep_equal(table(spark, sf, "part"), "p_brand=Brand#2,p_type=ECONOMY").select("p_partkey", "p_brand", "p_type")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey) = 1")
def q_dedupe_argmax(spark, sf):
    return quality.best_of(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT 'doc_id' AS column_name, max(CASE WHEN doc_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS has_value FROM documents
 UNION ALL SELECT 'lang', max(CASE WHEN trim(lang) NOT IN ('', 'nan', 'NaN', 'None', 'null', 'NULL') THEN 1 ELSE 0 END) = 1 FROM documents
 UNION ALL SELECT 'blank', false FROM documents GROUP BY 2""")
def q_empty_columns(spark, sf):
    return quality.fullness(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.lit("null").alias("blank")))


@query("SELECT page_id, try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS double) AS x FROM pages")
def q_permissive_parse(spark, sf):
    return table(spark, sf, "pages").select("page_id", parse.number(F.regexp_extract("url", "/([0-9]+)", 1)).alias("x"))


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, strftime(ts, '%Y-%m-%d') AS d FROM events")
def q_iso_parse(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    t = parse.timestamp(text)
    return table(spark, sf, "events").select("event_id", F.year(t).alias("y"), F.month(t).alias("m"), F.date_format(t, "yyyy-MM-dd").alias("d"))


@query("""SELECT year(o_orderdate) AS y, ['winter', 'spring', 'summer', 'autumn'][(month(o_orderdate) % 12) // 3 + 1] AS season, count(*) AS n FROM orders GROUP BY 1, 2""")
def q_season(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), numeric.season(F.month("o_orderdate")).alias("season")).agg(F.count(F.lit(1)).alias("n"))


#: Suites and variables of the products in file names: fixed values.
SUITES = {"chlor_a": ("CHL", "chlor_a"), "Kd_490": ("KD", "Kd_490"), "nflh": ("FLH", "nflh")}
BINS = """SELECT y AS year, k AS bin, (make_date(y, 1, 1) + (8 * k)::int)::date AS d0, least((make_date(y, 1, 1) + (8 * k + 7)::int)::date, make_date(y, 12, 31)) AS d1
 FROM range({0}, {1}) a(y), range(0, 46) b(k)"""


@query(f"""WITH b AS (SELECT * FROM ({BINS.format(1990, 2005)}) SEMI JOIN (SELECT year(o_orderdate) AS year, (dayofyear(o_orderdate) - 1) // 8 AS bin FROM orders) USING (year, bin)), p(product, suite, variable) AS (VALUES ('chlor_a', 'CHL', 'chlor_a'), ('Kd_490', 'KD', 'Kd_490'), ('nflh', 'FLH', 'nflh'))
 SELECT product, 'AQUA_MODIS.' || strftime(d0, '%Y%m%d') || '_' || strftime(d1, '%Y%m%d') || '.L3m.8D.' || suite || '.' || variable || '.4km.nc' AS name, strftime(d0, '%Y-%m-%d') AS d0,
 strftime(d1, '%Y-%m-%d') AS d1, strftime(d0::timestamp + (d1::timestamp - d0::timestamp) / 2, '%Y-%m-%d %H') AS mid FROM b, p""")
def q_name_dates(spark, sf):
    """Names of the products of all bins that have orders, and the dates in them."""
    year, k = calendars.year_bin(F.col("o_orderdate"))
    used = table(spark, sf, "orders").select(year.alias("year"), k.alias("bin")).distinct()
    bins = calendars.eight_day_bins(spark, 1990, 2004).join(used, ["year", "bin"], "left_semi")
    rows = calendars.file_names(bins, SUITES, "8D").select("product", "name")
    a, b = names.date_range(F.col("name"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("product", "name", day(a).alias("d0"), day(b).alias("d1"), F.date_format(names.middle(F.col("name")), "yyyy-MM-dd HH").alias("mid"))


@query("""SELECT p_partkey, CASE WHEN b >= 'N' THEN 32600 + z ELSE 32700 + z END AS epsg FROM (SELECT p_partkey, (p_partkey % 60 + 1)::int AS z, 'CDEFGHJKLMNPQRSTUVWX'[p_partkey * 7 % 20 + 1] AS b FROM part)""")
def q_mgrs_epsg(spark, sf):
    """The projection of each part's tile."""
    k = F.col("p_partkey")
    band = F.element_at(F.split(F.lit("C,D,E,F,G,H,J,K,L,M,N,P,Q,R,S,T,U,V,W,X"), ","), (k * 7 % 20 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", names.utm_epsg(F.concat(F.lit("S2_T"), F.lpad((k % 60 + 1).cast("string"), 2, "0"), band, F.lit("QG"))).alias("epsg"))


@query(r"""SELECT page_id, regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS file,
 CASE WHEN contains(lower(url), 'utm') THEN 'utm' WHEN contains(lower(url), 'page') THEN 'page' ELSE 'none' END AS kind FROM pages""")
def q_url_parse(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[^/]*//([^/?#]*)", 1).alias("host"), names.file_name(F.col("url")).alias("file"), names.first_containing(F.col("url"), ("utm", "page"), "none").alias("kind"))


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS int), -1) AS k, -1 AS missing FROM events""")
def q_json_props(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", parse.get(m, "k", F.lit("-1")).try_cast("int").alias("k"), parse.get(m, "none", F.lit("-1")).cast("int").alias("missing"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, cast(format('{:.5e}', sqrt(l_extendedprice)) AS double) AS x FROM lineitem")
def q_sigfig(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parse.significant(F.sqrt("l_extendedprice")).alias("x"))


@query("""SELECT strftime(d, '%Y-%m-%d') AS d0, strftime(last_day(d), '%Y-%m-%d') AS d1, strftime(d + 14, '%Y-%m-%d') AS tag, (SELECT count(*) FROM orders WHERE o_orderdate >= d AND o_orderdate < last_day(d) + 1) AS n FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::date AS d)""")
def q_calendar_months(spark, sf):
    """Orders by calendar month, months without any included."""
    n = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("d0")).agg(F.count(F.lit(1)).alias("n"))
    out = calendars.months(spark, 1995, 2001).join(n, "d0", "left")
    return out.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("d0", "d1", "tag")], F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT year(o_orderdate) AS year, ((dayofyear(o_orderdate) - 1) // 8)::int AS bin, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def q_calendar_8day(spark, sf):
    y, k = calendars.year_bin(F.col("o_orderdate"))
    return table(spark, sf, "orders").groupBy(y.alias("year"), k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""SELECT year::int AS year, bin::int AS bin, d0::varchar AS d0, d1::varchar AS d1, (SELECT count(*) FROM orders WHERE o_orderdate >= d0 AND o_orderdate < d1 + 1) AS n FROM ({BINS.format(1995, 2002)})""")
def q_eight_day_bins(spark, sf):
    """Orders by year-anchored bin, empty ones included."""
    year, k = calendars.year_bin(F.col("o_orderdate"))
    n = table(spark, sf, "orders").groupBy(year.alias("year"), k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = calendars.eight_day_bins(spark, 1995, 2001).join(n, ["year", "bin"], "left")
    return out.select("year", "bin", F.col("d0").cast("string").alias("d0"), F.col("d1").cast("string").alias("d1"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT k::int AS k, (DATE '2024-01-03' + (8 * k)::int)::date::varchar AS d0, least((DATE '2024-01-03' + (8 * k + 7)::int)::date, DATE '2024-01-29')::varchar AS d1, (SELECT count(*) FROM events WHERE ts::date BETWEEN DATE '2024-01-03' + (8 * k)::int
 AND least((DATE '2024-01-03' + (8 * k + 7)::int)::date, DATE '2024-01-29')) AS n FROM range(0, 4) t(k)""")
def q_calendar_running(spark, sf):
    w = calendars.running_windows(spark, "2024-01-29", "2024-01-03")
    days = w.select("k", F.col("d0").cast("string").alias("d0"), F.col("d1").cast("string").alias("d1"), F.explode(F.sequence("d0", "d1", F.expr("interval 1 day"))).alias("day"))
    per_day = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    return days.join(per_day, "day", "left").groupBy("k", "d0", "d1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


ASOF = """WITH b AS ({bins}), f AS (SELECT (d0 + (date_diff('day', d0, d1) // 2)::int)::date AS mid, 'f' || strftime(d0, '%Y%m%d') AS path FROM b)
 SELECT o_orderkey, path, gap_days FROM (SELECT o_orderkey, CASE WHEN gap <= 30 THEN path END AS path, (CASE WHEN gap <= 30 THEN gap END)::int AS gap_days,
 row_number() OVER (PARTITION BY o_orderkey ORDER BY gap, path) AS r FROM (SELECT o_orderkey, path, abs(date_diff('day', mid, o_orderdate::date)) AS gap FROM orders, f)) WHERE r = 1"""


def _composites(spark, first, last):
    b = calendars.eight_day_bins(spark, first, last)
    return b.select(F.date_add("d0", F.floor(F.date_diff("d1", "d0") / 2).cast("int")).alias("mid"), F.concat(F.lit("f"), F.date_format("d0", "yyyyMMdd")).alias("path"))


@query(ASOF.format(bins=BINS.format(1995, 1999)))
def q_asof_nearest(spark, sf):
    return asof.nearest_day(table(spark, sf, "orders"), _composites(spark, 1995, 1998), left_time="o_orderdate", right_time="mid", value="path", max_days=30).select("o_orderkey", "path", "gap_days")


@query("""SELECT event_id, d AS nearest, gap_days FROM (SELECT event_id, CASE WHEN gap <= 1 THEN d END AS d, (CASE WHEN gap <= 1 THEN gap END)::int AS gap_days, row_number() OVER (PARTITION BY event_id ORDER BY gap, d) AS r
 FROM (SELECT event_id, d, abs(date_diff('day', d::date, ts::date)) AS gap FROM events, (SELECT unnest(['2024-01-03', '2024-01-10', '2024-01-20']) AS d))) WHERE r = 1""")
def q_asof_tolerance_miss(spark, sf):
    right = spark.createDataFrame([("2024-01-03",), ("2024-01-10",), ("2024-01-20",)], "nearest string")
    right = right.withColumn("t", F.col("nearest").cast("date"))
    return asof.nearest_day(table(spark, sf, "events"), right, left_time="ts", right_time="t", value="nearest", max_days=1).select("event_id", "nearest", "gap_days")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey + 12")
def q_lookup_inner(spark, sf):
    """Suppliers with the nation twelve before theirs; the first twelve nations have none."""
    lut = table(spark, sf, "nation").withColumn("s_nationkey", F.col("n_nationkey") + 12).drop("n_nationkey")
    return asof.lookup(table(spark, sf, "supplier"), lut, "s_nationkey", how="inner").select("s_suppkey", "n_name")


@query("SELECT s_suppkey, coalesce(n_name, s_name) AS s_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey + 12")
def q_lookup_left(spark, sf):
    lut = table(spark, sf, "nation").select((F.col("n_nationkey") + 12).alias("s_nationkey"), F.col("n_name").alias("s_name"))
    return asof.lookup(table(spark, sf, "supplier"), lut, "s_nationkey", keep_old=["s_name"]).select("s_suppkey", "s_name")


@query("SELECT l_orderkey, max_by(l_quantity, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS q FROM lineitem GROUP BY l_orderkey")
def q_last_of(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("q"), (F.col("l_linenumber") * F.lit(10**10) + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("pos"))
    return asof.last_of(rows, "l_orderkey", "pos")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_semi(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey, count(l_orderkey)::int AS n, coalesce(sum(l_quantity), 0)::double AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def q_collect_nested(spark, sf):
    out = asof.nested(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", ["l_quantity"], order=["l_linenumber", "l_partkey"])
    return out.select("o_orderkey", F.size("items").alias("n"), F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("total"))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def q_product_calendar(spark, sf):
    return table(spark, sf, "nation").crossJoin(F.broadcast(table(spark, sf, "region"))).select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 5 AND 15")
def q_bbox(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_acctbal").between(0, 5000) & F.col("c_nationkey").between(5, 15)).select("c_custkey")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS http, round(6378137 * radians((o_orderkey % 360 - 180)), 4) AS x, round(6378137 * ln(tan(pi() / 4 + radians(o_orderkey % 80) / 2)), 4) AS y FROM orders""")
def q_mercator(spark, sf):
    x, y = geo.to_web_mercator((F.col("o_orderkey") % 360 - 180).cast("double"), (F.col("o_orderkey") % 80).cast("double"))
    return table(spark, sf, "orders").select("o_orderkey", names.http_date(F.col("o_orderdate")).alias("http"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


#: The transverse Mercator projection by its expansion in the longitude's distance from the zone's middle.
UTM = """WITH p AS (SELECT o_orderkey, radians(15.0::double + o_orderkey % 11) AS phi, radians(o_orderkey % 6 / 2.0::double) AS dl FROM orders), c AS (SELECT *, 6378137.0::double AS a, 0.006694379990141317::double AS e2, 0.006739496742276435::double AS ep FROM p),
 t AS (SELECT *, a / sqrt(1 - e2 * pow(sin(phi), 2)) AS n, pow(tan(phi), 2) AS t, ep * pow(cos(phi), 2) AS c, dl * cos(phi) AS l, a * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * phi - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * phi)
 + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * phi) - 35 * pow(e2, 3) / 3072 * sin(6 * phi)) AS m FROM c)
 SELECT o_orderkey, round(500000 + 0.9996 * n * (l + (1 - t + c) * pow(l, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(l, 5) / 120)) AS east,
 round(0.9996 * (m + n * tan(phi) * (l * l / 2 + (5 - t + 9 * c + 4 * c * c) * pow(l, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(l, 6) / 720))) AS north FROM t"""


@query(UTM)
def q_utm(spark, sf):
    """Positions in metres of zone 39, in whole metres, against another expansion."""
    k = F.col("o_orderkey")
    east, north = geo.to_utm(51.0 + k % 6 / 2, 15.0 + k % 11, F.lit(32639))
    return table(spark, sf, "orders").select("o_orderkey", F.round(east).alias("east"), F.round(north).alias("north"))


@query("""SELECT o_orderkey, (51.0 + o_orderkey % 6)::double AS lon, (15.0 + o_orderkey % 11)::double AS lat FROM orders""")
def q_utm_round_trip(spark, sf):
    lon, lat = (F.lit(51.0) + F.col("o_orderkey") % 6), (F.lit(15.0) + F.col("o_orderkey") % 11)
    e, n = geo.to_utm(lon, lat, F.lit(32639))
    rows = table(spark, sf, "orders").select("o_orderkey", e.alias("e"), n.alias("n"))
    a, b = geo.from_utm(F.col("e"), F.col("n"), F.lit(32639))
    return rows.select("o_orderkey", F.round(a, 6).alias("lon"), F.round(b, 6).alias("lat"))


@query("""WITH w AS (SELECT k, DATE '1995-01-01' + (8 * k)::int AS d0 FROM range(0, 320) t(k)) SELECT k, o_orderkey, rank FROM (SELECT k::int AS k, o_orderkey, (row_number() OVER (PARTITION BY k ORDER BY o_totalprice NULLS LAST, o_orderkey))::int AS rank
 FROM orders, w WHERE o_orderdate::date BETWEEN d0 AND least(d0 + 7, DATE '2001-12-31')) WHERE rank <= 2""")
def q_topk_window(spark, sf):
    w = calendars.running_windows(spark, "1995-01-01", "2001-12-31")
    return calendars.per_window(table(spark, sf, "orders"), w, time="o_orderdate", id_col="o_orderkey", cost="o_totalprice", per=2).select("k", "o_orderkey", "rank")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::int AS k FROM part")
def q_seq_ids(spark, sf):
    return ranking.numbered_in(ranking.numbered(table(spark, sf, "part"), ["p_name", "p_partkey"]), "p_brand", ["p_partkey"]).select("p_partkey", "id", "k")


@query("""SELECT c_custkey, CASE WHEN r <= floor(n * .70) THEN 'train' WHEN r <= floor(n * .70) + floor(n * .15) THEN 'val' ELSE 'test' END AS split FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey)) AS r, count(*) OVER () AS n FROM customer)""")
def q_rank_split(spark, sf):
    return ranking.split_by_rank(table(spark, sf, "customer"), F.col("c_custkey")).select("c_custkey", "split")


@query("""SELECT p_partkey, p_brand, CASE WHEN r <= floor(n * .75) THEN 'train' ELSE 'test' END AS split FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42:' || p_partkey)) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)""")
def q_stratified_split(spark, sf):
    return ranking.stratified(table(spark, sf, "part"), "p_brand", F.col("p_partkey")).select("p_partkey", "p_brand", "split")


@query("""WITH a AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS lo, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS hi FROM part),
 r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || p_partkey)) AS k FROM a WHERE lo > 10 AND hi > 10)
 SELECT p_partkey, 'best' AS "group" FROM a WHERE lo <= 10 UNION ALL SELECT p_partkey, 'worst' FROM a WHERE hi <= 10 UNION ALL SELECT p_partkey, 'random' FROM r WHERE k <= 10""")
def q_best_worst(spark, sf):
    return ranking.best_worst_rest(table(spark, sf, "part"), "p_retailprice", "p_partkey", 30).select("p_partkey", "group")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q_global_topk(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 25")
def q_set_difference(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).distinct().join(table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")), "k", "left_anti")


@query("SELECT 'supplier' AS kind, s_nationkey AS nation FROM supplier UNION ALL SELECT 'customer', c_nationkey FROM customer")
def q_union_all(spark, sf):
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    return s.unionByName(table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation")))
