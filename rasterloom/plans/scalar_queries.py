"""Queries of column functions: scene geometry, sun, tags, codes and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import encode, geo, tags
from rasterloom.operators import focal, ranks, scenery
from rasterloom.plans.focal_queries import S_SQL, _grad_sql
from rasterloom.plans.registry import Registry, rounded
from rasterloom.plans.score_queries import M_SQL, metres
from rasterloom.sources import views

registry = Registry()
SCENES = f"WITH {views.SCENES_SQL} "


@registry.add(
    SCENES
    + """SELECT scene_id, CASE WHEN transform IS NULL OR transform[1] = 0 OR transform[5] = 0 THEN 1.0 ELSE round(sqrt(
      abs(transform[1]) * (CASE WHEN is_geographic THEN 111320 * cos(radians(lat)) ELSE 1 END) * abs(transform[5]) * (CASE WHEN is_geographic THEN 111320 ELSE 1 END)), 4) END AS gsd_m,
  transform IS NULL AS is_assumed FROM scenes"""
)
def gsd_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    gsd, assumed = geo.gsd_metres(F.col("transform"), F.col("is_geographic"), F.col("lat"))
    return rounded(views.scenes(spark, sf_dir).select("scene_id", gsd.alias("gsd_m"), assumed.alias("is_assumed")), 4)


@registry.add(
    SCENES
    + """SELECT scene_id, round(cos(radians(sun_el)) * sin(radians(lon)), 6) AS d_col, round(-cos(radians(sun_el)) * cos(radians(lon)), 6) AS d_row, round(sin(radians(sun_el)), 6) AS d_z,
  round(10 * tan(radians(sun_el)), 6) AS height_m, round(10 / greatest(tan(radians(sun_el)), 1e-6), 6) AS length_m FROM scenes WHERE sun_el IS NOT NULL"""
)
def sun_and_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scenes(spark, sf_dir).filter("sun_el is not null")
    col, row, up = geo.sun_vector(F.col("lon"), F.col("sun_el"))
    ten = F.lit(10.0)
    return rounded(
        rows.select(
            "scene_id", col.alias("d_col"), row.alias("d_row"), up.alias("d_z"),
            geo.shadow_height(ten, F.col("sun_el")).alias("height_m"), geo.shadow_length(ten, F.col("sun_el")).alias("length_m"),
        )
    )


@registry.add(
    f"WITH {views.SCENES_SQL}, {views.ANCHORS_SQL.strip()}"
    + """SELECT anchor_id, s.scene_id, round(t[1] * (col + 0.5) + t[2] * ("row" + 0.5) + t[3], 6) AS x, round(t[4] * (col + 0.5) + t[5] * ("row" + 0.5) + t[6], 6) AS y,
  CAST("row" AS DOUBLE) AS row_back, CAST(col AS DOUBLE) AS col_back FROM anchors a JOIN (SELECT scene_id, transform AS t FROM scenes WHERE transform IS NOT NULL) s ON s.scene_id = a.scene_id"""
)
def pixel_to_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors' world places, and their pixels again from those."""
    placed = views.anchors(spark, sf_dir).join(views.scenes(spark, sf_dir).filter("transform is not null").select("scene_id", "transform"), "scene_id")
    x, y = geo.pixel_to_world(F.col("transform"), F.col("row"), F.col("col"))
    row, col = geo.world_to_pixel(F.col("transform"), x, y)
    return rounded(placed.select("anchor_id", "scene_id", x.alias("x"), y.alias("y"), row.alias("row_back"), col.alias("col_back")))


@registry.add(
    SCENES
    + """SELECT scene_id, round(CASE WHEN sun_el BETWEEN 20 AND 75 THEN least(1, greatest(0, (sun_el - 20) / 10)) * least(1, greatest(0, (75 - sun_el) / 10)) ELSE 0 END, 6) AS gate FROM scenes"""
)
def sun_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.scenes(spark, sf_dir).select("scene_id", geo.sun_quality_gate(F.col("sun_el")).alias("gate")))


@registry.add(
    """WITH e AS (SELECT event_id, ts, CAST(user_id % 120 AS DOUBLE) - 60 AS lat, CAST(user_id % 360 AS DOUBLE) - 180 AS lon,
  (epoch_us(ts) / 1000000.0 - 946728000) / 86400.0 / 36525.0 AS t FROM events),
a AS (SELECT *, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m, radians(125.04 - 1934.136 * t) AS node,
  ((280.46646 + t * (36000.76983 + t * 0.0003032)) % 360 + 360) % 360 AS l0 FROM e),
b AS (SELECT *, radians(l0 + sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 - 0.00569 - 0.00478 * sin(node)) AS app,
  radians(23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(node)) AS eps, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS ecc FROM a),
c AS (SELECT *, asin(sin(eps) * sin(app)) AS decl, pow(tan(eps / 2), 2) AS y FROM b),
d AS (SELECT *, 4 * degrees(y * sin(2 * radians(l0)) - 2 * ecc * sin(m) + 4 * ecc * y * sin(m) * cos(2 * radians(l0)) - 0.5 * y * y * sin(4 * radians(l0)) - 1.25 * ecc * ecc * sin(2 * m)) AS eot FROM c),
f AS (SELECT *, radians((((hour(ts) * 60 + minute(ts) + second(ts) / 60.0 + eot + 4 * lon) % 1440 + 1440) % 1440) / 4 - 180) AS ha, radians(lat) AS phi FROM d),
g AS (SELECT *, acos(greatest(-1, least(1, sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha)))) AS z FROM f),
h AS (SELECT *, degrees(acos(greatest(-1, least(1, (sin(phi) * cos(z) - sin(decl)) / (cos(phi) * sin(z)))))) AS side FROM g)
SELECT event_id, round(CASE WHEN ha > 0 THEN (side + 180) % 360 ELSE (540 - side) % 360 END, 4) AS azimuth, round(90 - degrees(z), 4) AS elevation FROM h"""
)
def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    lat, lon = (F.col("user_id") % 120).cast("double") - 60, (F.col("user_id") % 360).cast("double") - 180
    azimuth, elevation = geo.solar_position(lat, lon, F.col("ts"))
    return rounded(rows.select("event_id", azimuth.alias("azimuth"), elevation.alias("elevation")), 4)


@registry.add("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END::TIMESTAMP AS utc FROM events""")
def parse_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in four spellings, and one that isn't a time, read back."""
    rows = views.read(spark, sf_dir, "events").select("event_id", "ts")
    k = F.col("event_id") % 5
    spelled = (
        F.when(k == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
        .when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 3, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.lit("yesterday"))
    )
    return rows.select("event_id", geo.parse_utc(spelled).cast("timestamp_ntz").alias("utc"))


@registry.add(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN CAST(s_nationkey AS VARCHAR) WHEN s_suppkey % 4 = 2 THEN 'v' || s_nationkey ELSE CAST(s_nationkey + 100 AS VARCHAR) END AS azimuth FROM supplier"""
)
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey").cast("string")
    pairs = (
        F.when(k == 0, F.create_map(F.lit("SUN_AZ"), F.lit("  "), F.lit("other"), n))
        .when(k == 1, F.create_map(F.lit("sun azimuth"), F.concat(n, F.lit(" ")), F.lit("SUN_AZ"), F.lit("0")))
        .when(k == 2, F.create_map(F.lit("NITF_SUN_AZIMUTH"), F.concat(F.lit("v"), n)))
        .otherwise(F.create_map(F.lit("SUN_AZ"), (F.col("s_nationkey") + 100).cast("string"), F.lit("X_SUN_AZIMUTH"), n))
    )
    found = geo.tag_lookup(pairs, ("SUN_AZIMUTH", "SUN_AZ"))
    return views.read(spark, sf_dir, "supplier").select("s_suppkey", found.alias("azimuth"))


@registry.add(
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'data/SRTM_' || p_size || '.tif' WHEN 1 THEN 'sim:' || p_size WHEN 2 THEN 'x/glo30.tif' WHEN 3 THEN 'Aster.tif' WHEN 4 THEN 'srtm/own.tif' END AS spec FROM part),
n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'srtm' WHEN 1 THEN 'copernicus' WHEN 2 THEN 'copernicus' WHEN 3 THEN 'aster' WHEN 4 THEN 'unknown' END AS name FROM p)
SELECT p_partkey, name, CASE name WHEN 'srtm' THEN 6.0 WHEN 'copernicus' THEN 3.0 WHEN 'aster' THEN 8.5 WHEN 'unknown' THEN 6.0 ELSE 0.0 END::DOUBLE AS sigma_m,
  round(CASE name WHEN 'copernicus' THEN 1.0 WHEN 'aster' THEN 3 / 8.5 ELSE 0.5 END::DOUBLE, 6) AS weight FROM n"""
)
def dem_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    spec = (
        F.when(k == 0, F.concat(F.lit("data/SRTM_"), size, F.lit(".tif"))).when(k == 1, F.concat(F.lit("sim:"), size))
        .when(k == 2, "x/glo30.tif").when(k == 3, "Aster.tif").when(k == 4, "srtm/own.tif")
    )
    rows = views.read(spark, sf_dir, "part").select("p_partkey", geo.dem_source_name(spec).alias("name"))
    return rounded(rows.select("p_partkey", "name", geo.reference_sigma(F.col("name")).alias("sigma_m"), geo.dem_weight(F.col("name")).alias("weight")))


@registry.add(
    SCENES
    + """, g AS (SELECT c_nationkey AS k, count(*) FILTER (c_acctbal > 9000) AS n FROM customer GROUP BY 1)
SELECT scene_id, CASE WHEN coalesce(n, 0) >= 3 THEN 'B' WHEN crs IS NOT NULL AND scene_id % 2 = 0 THEN 'A' ELSE 'C' END AS tier FROM scenes LEFT JOIN g ON k = scene_id"""
)
def select_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("scene_id")).agg(F.count_if(F.col("c_acctbal") > 9000).alias("n"))
    rows = views.scenes(spark, sf_dir).join(points, "scene_id", "left")
    tier = geo.select_tier(F.coalesce("n", F.lit(0)), F.col("crs").isNotNull(), F.col("scene_id") % 2 == 0)
    return rows.select("scene_id", tier.alias("tier"))


@registry.add(
    M_SQL
    + """, c AS (SELECT scene_id, "row", col, ref, CAST(least(greatest(round_even((ref + 10000) / 0.1, 0), 0), 16777215) AS BIGINT) AS v FROM m)
SELECT scene_id, "row", col, CAST(v >> 16 AS INTEGER) AS red, CAST((v >> 8) & 255 AS INTEGER) AS green, CAST(v & 255 AS INTEGER) AS blue, round(-10000 + v * 0.1, 4) AS decoded FROM c"""
)
def terrain_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = encode.encode_terrain_rgb(F.col("ref"))
    out = metres(spark, sf_dir).select("scene_id", "row", "col", r.alias("red"), g.alias("green"), b.alias("blue"))
    return rounded(out.withColumn("decoded", encode.decode_terrain_rgb(F.col("red"), F.col("green"), F.col("blue"))), 4)


@registry.add(
    M_SQL
    + """, s AS (SELECT scene_id, min(ref) AS lo, max(ref) AS hi FROM m GROUP BY scene_id),
c AS (SELECT m.scene_id, "row", col, ref, lo, hi, CAST(round_even((ref - lo) / (hi - lo) * 4095, 0) AS BIGINT) * 4096 AS v FROM m JOIN s USING (scene_id))
SELECT scene_id, count(*) AS n, count(DISTINCT v) AS n_codes, round((max(hi) - max(lo)) / 4095, 6) AS step,
  round(max(abs(lo + v / 16777215.0 * ((hi - lo) * 16777215.0 / 16773120.0) - ref)), 4) AS worst,
  bool_and(abs(lo + v / 16777215.0 * ((hi - lo) * 16777215.0 / 16773120.0) - ref) <= (hi - lo) / 4095 / 2 + 1e-6) AS within FROM c GROUP BY scene_id"""
)
def linear_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 12-bit linear code of each scene: codes used, step and the worst error after decoding."""
    m = metres(spark, sf_dir)
    span = m.groupBy("scene_id").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi"))
    rows = m.join(F.broadcast(span), "scene_id")  # one row a scene
    rgb = encode.encode_linear_bits(F.col("ref"), F.col("lo"), F.col("hi"), 12)
    low, high = encode.linear_range_for_bits(F.col("lo"), F.col("hi"), 12)
    off = F.abs(encode.decode_linear(*rgb, low, high) - F.col("ref"))
    step = encode.linear_step(F.col("lo"), F.col("hi"), 12)
    return rounded(
        rows.groupBy("scene_id").agg(
            F.count("*").alias("n"), F.count_distinct(encode.unpack24(*rgb)).alias("n_codes"), F.round(F.max(step), 6).alias("step"),
            F.round(F.max(off), 4).alias("worst"), F.bool_and(off <= step / 2 + 1e-6).alias("within"),
        )
    )


@registry.add(
    M_SQL
    + """SELECT scene_id, "row", col, round((0.299 * r + 0.587 * g + 0.114 * b) / 255.0, 9) AS lum,
  round((greatest(r, g, b) - least(r, g, b)) / 255.0 / greatest(greatest(r, g, b) / 255.0, 1e-6), 9) AS sat,
  round((2 * g - r - b) / 255.0 / greatest((r + g + b) / 255.0, 1e-6), 9) AS exg, round((2 * b - r - g) / 255.0 / greatest((r + g + b) / 255.0, 1e-6), 9) AS exb FROM m"""
)
def spectral_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = encode.spectral_channels(F.col("r"), F.col("g"), F.col("b"))
    return rounded(views.px(spark, sf_dir).select("scene_id", "row", "col", *(c.alias(k) for k, c in own.items())), 9)


@registry.add(
    M_SQL
    + """, c AS (SELECT scene_id, "row", col, (0.299 * r + 0.587 * g + 0.114 * b) / 255.0 AS lum, atan2(b / 255.0, greatest(r / 255.0, g / 255.0, 1e-6)) AS c3 FROM m),
s AS (SELECT scene_id, min(c3) AS lo, max(c3) AS hi FROM c GROUP BY scene_id)
SELECT scene_id, "row", col, round((c3 - lo) / greatest(hi - lo, 1e-6) * (1 - lum), 6) AS shadow_index FROM c JOIN s USING (scene_id)"""
)
def shadow_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blue against the stronger of red and green, scaled over the scene, in the dark."""
    return rounded(scenery.shadow_index(views.px(spark, sf_dir)).select("scene_id", "row", "col", "shadow_index"))


@registry.add(
    M_SQL
    + """, s AS (SELECT scene_id, quantile_cont(ref, 0.02) AS lo, quantile_cont(ref, 0.98) AS hi FROM m GROUP BY scene_id)
SELECT scene_id, "row", col, CAST(trunc(least(greatest((ref - lo) / (CASE WHEN hi - lo < 1e-6 THEN 1 ELSE hi - lo END), 0), 1) * 255) AS INTEGER) AS stretched FROM m JOIN s USING (scene_id)"""
)
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band between its 2nd and 98th percentile as 0 to 255, cut down to whole numbers."""
    m = metres(spark, sf_dir)
    q = ranks.exact_quantiles(m, "ref", (0.02, 0.98), ("scene_id",)).select("scene_id", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    width = F.when(F.col("hi") - F.col("lo") < 1e-6, 1.0).otherwise(F.col("hi") - F.col("lo"))
    share = F.least(F.greatest((F.col("ref") - F.col("lo")) / width, F.lit(0.0)), F.lit(1.0))
    return m.join(q, "scene_id").select("scene_id", "row", "col", (share * 255).cast("int").alias("stretched"))


@registry.add(
    M_SQL
    + """SELECT scene_id, "row", col, round(least(1, 2.0 / greatest(abs(err), 1e-9)), 6) AS huber, round(sqrt(sigma * sigma + 9 + 0.25), 6) AS sigma_all,
  round(greatest((CASE WHEN least("row", 63 - "row") < 8 THEN 0.5 - 0.5 * cos(pi() * (least("row", 63 - "row") + 0.5) / 8) ELSE 1 END)
    * (CASE WHEN least(col, 63 - col) < 8 THEN 0.5 - 0.5 * cos(pi() * (least(col, 63 - col) + 0.5) / 8) ELSE 1 END), 0.001), 6) AS blend, round(greatest(ref - pred, 0), 6) AS ndsm FROM m"""
)
def pixel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huber weight of the error, combined sigma, chip blending weight, and height above another surface."""
    return rounded(
        metres(spark, sf_dir).select(
            "scene_id", "row", "col", encode.huber_weight(F.col("err"), 2.0).alias("huber"),
            encode.combine_sigma(F.col("sigma"), F.lit(3.0), F.lit(None).cast("double"), F.lit(0.5)).alias("sigma_all"),
            encode.blend_weight(F.col("row"), F.col("col"), 64, 8).alias("blend"), F.greatest(F.col("ref") - F.col("pred"), F.lit(0.0)).alias("ndsm"),
        )
    )


@registry.add(
    """SELECT c_custkey, CAST(coalesce((SELECT min(s.range) FROM range(1, 17) s WHERE 2 * ((h - 1) // s.range) * ((w - 1) // s.range) <= 350000), 16) AS INTEGER) AS stride
FROM (SELECT c_custkey, 200 + c_custkey % 5000 AS h, 300 + c_custkey * 7 % 9000 AS w FROM customer)"""
)
def choose_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return views.read(spark, sf_dir, "customer").select("c_custkey", encode.choose_stride(200 + k % 5000, 300 + k * 7 % 9000).cast("int").alias("stride"))


@registry.add(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN greatest(3, 3 * (p_size % 4)) WHEN 2 THEN 12 WHEN 3 THEN 6 ELSE 2.5 END::DOUBLE AS width_m, p_partkey % 3 = 0 AS elevated FROM part"""
)
def road_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    bridge = F.when(k % 3 == 0, F.lit("yes")).when(k % 3 == 1, F.lit("no")).otherwise(F.lit(""))
    one = lambda key, value: F.create_map(F.lit(key), value, F.lit("bridge"), bridge)
    said = (
        F.when(k % 5 == 0, one("width", F.concat(size.cast("string"), F.lit(",5 m")))).when(k % 5 == 1, one("lanes", (size % 4).cast("string")))
        .when(k % 5 == 2, one("highway", F.lit("primary"))).when(k % 5 == 3, one("highway", F.lit("raceway"))).otherwise(one("highway", F.lit("footway")))
    )
    rows = views.read(spark, sf_dir, "part").select("p_partkey", said.alias("tags"))
    return rows.select("p_partkey", tags.road_width(F.col("tags")).alias("width_m"), tags.elevated_flag(F.col("tags")).alias("elevated"))


@registry.add(
    S_SQL
    + f', g AS ({_grad_sql("z", 0.5)}), n AS (SELECT *, sqrt(gx * gx + gy * gy + 1) AS k FROM g) '
    + """SELECT scene_id, "row", col, CAST(round_even((-gx / k + 1) * 0.5 * 255, 0) AS INTEGER) AS nx, CAST(round_even((gy / k + 1) * 0.5 * 255, 0) AS INTEGER) AS ny,
  CAST(round_even((1 / k + 1) * 0.5 * 255, 0) AS INTEGER) AS nz FROM n"""
)
def normal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface normals as bytes: east, north, up."""
    out = focal.gradient(views.surface(spark, sf_dir), "z", 0.5)
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)
    byte = lambda c: F.rint((c / length + 1) * 0.5 * 255).cast("int")
    return out.select("scene_id", "row", "col", byte(-F.col("gx")).alias("nx"), byte(F.col("gy")).alias("ny"), byte(F.lit(1.0)).alias("nz"))


@registry.add(
    M_SQL
    + """, q AS (SELECT scene_id, quantile_cont(ref, 0.01) AS lo, quantile_cont(ref, 0.99) AS hi FROM m GROUP BY scene_id),
i AS (SELECT m.scene_id, "row", col, CAST(least(greatest((ref - lo) / (hi - lo), 0), 1) * 255 AS DOUBLE) AS t FROM m JOIN q USING (scene_id))
SELECT scene_id, "row", col, CAST(trunc(t) AS INTEGER) AS shade, CAST(255 - trunc(t) AS INTEGER) AS inverse FROM i"""
)
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-channel ramp over the 1st to 99th percentile, by a table of 256 colours."""
    m = metres(spark, sf_dir)
    q = ranks.exact_quantiles(m, "ref", (0.01, 0.99), ("scene_id",)).select("scene_id", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    share = F.least(F.greatest((F.col("ref") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    at = m.join(q, "scene_id").select("scene_id", "row", "col", (share * 255).cast("int").alias("shade"))
    ramp = spark.range(256).select(F.col("id").cast("int").alias("shade"), (255 - F.col("id")).cast("int").alias("inverse"))
    return at.join(F.broadcast(ramp), "shade").select("scene_id", "row", "col", "shade", "inverse")
