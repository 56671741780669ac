"""Queries on labels, their coordinates and the KML sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.constants import EXCLUDED_TYPES, LABELS
from wetlens.functions import labels as L
from wetlens.functions.geo import BETA, CENTRAL, DELTA, FALSE_EAST, RADIUS, to_grid, to_lonlat
from wetlens.operators.regions import ring_area
from wetlens.plans.oracle import grid_sql
from wetlens.plans.proxies import PTS_SQL, pts
from wetlens.session import load
from wetlens.sinks import kml as sink
from wetlens.sources import kml


def fn_to_3067(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pts(spark, sf_dir).select("c_custkey", to_grid(F.col("lon"), F.col("lat")).alias("g"))
    return p.select("c_custkey", F.round("g.e", 4).alias("e"), F.round("g.n", 4).alias("n"))


def fn_to_4326(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "mask_segment").select("seg_id", to_lonlat(F.col("x1"), F.col("y1")).alias("g"))
    return p.select("seg_id", F.round("g.lon", 8).alias("lon"), F.round("g.lat", 8).alias("lat"))


def _placemarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "kml_label").select("label_id", kml.parse_placemark(F.col("placemark")).alias("p")).select("label_id", "p.name", "p.coordinates")


def src_kml_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and coordinate text of each placemark."""
    return _placemarks(spark, sf_dir)


def fn_feature_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placemarks(spark, sf_dir).select("label_id", L.feature_type(F.col("name")).alias("feature_type"))


def fn_coord_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each well-formed vertex of each placemark."""
    c = _placemarks(spark, sf_dir).select("label_id", F.posexplode(L.coordinates(F.col("coordinates"))).alias("vertex", "v"))
    return c.select("label_id", "vertex", "v.lon", "v.lat")


def agg_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point each placemark stands for."""
    c = _placemarks(spark, sf_dir).select("label_id", L.centroid(L.coordinates(F.col("coordinates"))).alias("c")).filter("c is not null")
    return c.select("label_id", F.round("c.lon", 8).alias("lon"), F.round("c.lat", 8).alias("lat"))


def src_kml_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points in metres of the placemarks, without the excluded types."""
    p = kml.labels(_placemarks(spark, sf_dir), "label_id").filter(~F.col("feature_type").isin(*EXCLUDED_TYPES))
    return p.select("label_id", "feature_type", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def fn_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of each manifest row's feature type, and the label with 1 and 2 as one."""
    value = L.label(F.col("feature_type"))
    return load(spark, sf_dir, "manifest").select("row_idx", value.alias("label"), L.collapsed(value).alias("flooded"))


def agg_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives by feature type."""
    return load(spark, sf_dir, "manifest").filter("label = 1").groupBy("feature_type").agg(F.count("*").alias("n_rows"))


def fn_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "roi").select("roi_idx", L.tier(F.col("confidence")).alias("tier"))


def fn_placemark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, description and style of each region's placemark."""
    r = load(spark, sf_dir, "roi").filter("confidence is not null and area_m2 is not null and not isnan(confidence) and not isnan(area_m2)")
    return r.select("roi_idx", *sink.fields(F.col("roi_idx"), F.col("confidence"), F.col("area_m2"), F.col("model_type")))


def fn_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate text of each region's ring."""
    return load(spark, sf_dir, "roi").select("roi_idx", sink.ring_text(F.col("geom")).alias("coordinates"))


def agg_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each region's ring beside the area given."""
    return load(spark, sf_dir, "roi").select("roi_idx", F.round(ring_area(F.col("geom")), 3).alias("ring_m2"), "area_m2")


_NAME = "CASE WHEN placemark LIKE '%<name>%' THEN nullif(regexp_extract(placemark, '<name>([^<]*)</name>', 1), '') END"
_COORDS = "CASE WHEN placemark LIKE '%<coordinates>%' THEN nullif(regexp_extract(placemark, '<coordinates>([^<]*)</coordinates>', 1), '') END"
_UNESC = lambda s: f"replace(replace(replace(replace(replace({s}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&')"
_P = f"p AS (SELECT label_id, replace({_UNESC(_NAME)}, chr(13), chr(10)) AS name, {_UNESC(_COORDS)} AS coordinates FROM kml_label)"
_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\v]"
_TYPE = f"CASE WHEN name IS NULL OR name = '' THEN 'unknown' ELSE lower(regexp_replace(name, '^{_WS}+|{_WS}+$', '', 'g')) END"
_V = f"""{_P}, t AS (SELECT label_id, unnest(string_split_regex(trim(coordinates), '\\s+')) AS token, unnest(range(1000)) AS i FROM p WHERE coordinates IS NOT NULL),
 f AS (SELECT label_id, i, try_cast(split_part(token, ',', 1) AS double) AS lon, CASE WHEN token LIKE '%,%' THEN try_cast(split_part(token, ',', 2) AS double) END AS lat FROM t WHERE token IS NOT NULL),
 v AS (SELECT label_id, cast(row_number() OVER (PARTITION BY label_id ORDER BY i) - 1 AS INTEGER) AS vertex, lon, lat FROM f WHERE lon IS NOT NULL AND lat IS NOT NULL)"""
_CASE = " ".join(f"WHEN feature_type = '{k}' THEN {v}" for k, v in LABELS.items())


def _inverse(source: str, x: str, y: str, keep: str) -> str:
    """CTEs that end in ``geo``: ``keep``, lon and lat of x and y of a source."""
    beta = lambda f, g: " - ".join(["", *(f"{b!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, b in enumerate(BETA, 1))])
    delta = " + ".join(f"{d!r} * sin({2 * j} * chi)" for j, d in enumerate(DELTA, 1))
    return f"""a AS (SELECT {keep}, {y} / {RADIUS!r} AS xi, ({x} - {FALSE_EAST!r}) / {RADIUS!r} AS eta FROM {source}),
      b AS (SELECT {keep}, xi{beta("sin", "cosh")} AS xi, eta{beta("cos", "sinh")} AS eta FROM a),
      c AS (SELECT {keep}, asin(sin(xi) / cosh(eta)) AS chi, atan2(sinh(eta), cos(xi)) AS d FROM b),
      geo AS (SELECT {keep}, {CENTRAL!r} + degrees(d) AS lon, degrees(chi + {delta}) AS lat FROM c)"""


QUERIES = {f.__name__: f for f in (fn_to_3067, fn_to_4326, src_kml_xml, fn_feature_type, fn_coord_parse, agg_centroid, src_kml_labels, fn_label_map, agg_by_type, fn_tier, fn_placemark, fn_ring, agg_area)}
SQL = {
    "fn_to_3067": f"WITH pts AS ({PTS_SQL}), {grid_sql('pts', 'lon', 'lat', 'c_custkey')} SELECT c_custkey, round(e, 4) AS e, round(n, 4) AS n FROM grid",
    "fn_to_4326": f"WITH {_inverse('mask_segment', 'x1', 'y1', 'seg_id')} SELECT seg_id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM geo",
    "fn_ring": f"""WITH v AS (SELECT roi_idx, unnest(geom) AS p, unnest(range(len(geom))) AS i FROM roi), {_inverse('v', 'p.x', 'p.y', 'roi_idx, i')},
      t AS (SELECT roi_idx, string_agg(format('{{:.6f}},{{:.6f}},0', lon, lat), ' ' ORDER BY i) AS coordinates FROM geo GROUP BY 1) SELECT roi_idx, coordinates FROM roi LEFT JOIN t USING (roi_idx)""",
    "src_kml_xml": f"WITH {_P} SELECT label_id, name, coordinates FROM p",
    "fn_feature_type": f"WITH {_P} SELECT label_id, {_TYPE} AS feature_type FROM p",
    "fn_coord_parse": f"WITH {_V} SELECT label_id, vertex, lon, lat FROM v",
    "agg_centroid": f"WITH {_V} SELECT label_id, round(avg(lon), 8) AS lon, round(avg(lat), 8) AS lat FROM v GROUP BY 1",
    "src_kml_labels": f"""WITH {_V}, q AS (SELECT label_id, avg(lon) AS lon, avg(lat) AS lat FROM v GROUP BY 1), {grid_sql('q', 'lon', 'lat', 'label_id')},
      k AS (SELECT label_id, {_TYPE} AS feature_type FROM p) SELECT label_id, feature_type, round(e, 3) AS x, round(n, 3) AS y FROM grid JOIN k USING (label_id) WHERE feature_type NOT IN ('lodge', 'dam')""",
    "fn_label_map": f"SELECT row_idx, CASE {_CASE} ELSE 2 END AS label, least(CASE {_CASE} ELSE 2 END, 1) AS flooded FROM manifest",
    "agg_by_type": "SELECT feature_type, count(*) AS n_rows FROM manifest WHERE label = 1 GROUP BY 1",
    "fn_tier": "SELECT roi_idx, CASE WHEN confidence >= 0.8 AND cast(confidence AS VARCHAR) <> 'nan' THEN 'high' WHEN confidence >= 0.6 AND cast(confidence AS VARCHAR) <> 'nan' THEN 'medium' ELSE 'low' END AS tier FROM roi",
    "fn_placemark": """WITH r AS (SELECT *, coalesce(model_type IN ('rf', 'cnn', 'both'), false) AS known, 'Flooded area ' || roi_idx AS n, format('Confidence: {:.2f}' || chr(10) || 'Area: {:.0f} m²', confidence, area_m2) AS t FROM roi
        WHERE confidence IS NOT NULL AND area_m2 IS NOT NULL AND cast(confidence AS VARCHAR) <> 'nan' AND cast(area_m2 AS VARCHAR) <> 'nan')
      SELECT roi_idx, CASE WHEN known THEN n || ' [' || upper(model_type) || ']' ELSE n END AS name, CASE WHEN known THEN 'Model: ' || upper(model_type) || chr(10) || t ELSE t END AS description,
        CASE WHEN known THEN '#model_' || model_type ELSE '#flood_' || CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END END AS style FROM r""",
    "agg_area": """WITH v AS (SELECT roi_idx, area_m2, unnest(geom) AS p, unnest(range(len(geom))) AS i FROM roi), w AS (SELECT a.roi_idx, sum(a.p.x * b.p.y - b.p.x * a.p.y) AS s FROM v a JOIN v b ON a.roi_idx = b.roi_idx AND b.i = a.i + 1 GROUP BY 1)
      SELECT roi_idx, round(abs(s) / 2, 3) AS ring_m2, area_m2 FROM roi JOIN w USING (roi_idx)""",
}
