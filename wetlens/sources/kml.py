"""KML and KMZ label files."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetlens.functions.geo import to_grid
from wetlens.functions.labels import centroid, coordinates, feature_type

#: Geometry elements in the order they are tried.
GEOMETRIES = ("Point", "Polygon", "LineString", "MultiGeometry")

_PARSED = T.StructType([T.StructField("name", T.StringType()), T.StructField("coordinates", T.StringType())])


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def placemark(element: ET.Element) -> tuple[str | None, str | None]:
    """(name, coordinate text) of a placemark element, whatever its namespace.

    The first geometry, in the order of ``GEOMETRIES``, that has non-empty coordinates
    counts; the name is NULL if there is none.
    """
    name = next((e.text for e in element if _local(e.tag) == "name"), None)
    for kind in GEOMETRIES:
        shape = next((e for e in element.iter() if _local(e.tag) == kind), None)
        if shape is not None:
            c = next((e for e in shape.iter() if _local(e.tag) == "coordinates"), None)
            if c is not None and c.text:
                return name, c.text
    return name, None


@F.pandas_udf(_PARSED)
def _parse(xml: pd.Series) -> pd.DataFrame:
    out = []
    for s in xml:
        try:
            out.append(placemark(ET.fromstring(s)) if s else (None, None))
        except ET.ParseError:
            out.append((None, None))
    return pd.DataFrame(out, columns=["name", "coordinates"], dtype=object)


def parse_placemark(xml: Column) -> Column:
    """struct<name, coordinates> of one placemark's XML; NULLs where it is not well-formed."""
    return _parse(xml)


def labels(placemarks: DataFrame, *keep: str) -> DataFrame:
    """keep..., feature_type, x, y of placemarks (name, coordinates); those without coordinates are left out.

    Several vertices count by their mean in longitude and latitude.
    """
    c = placemarks.withColumn("c", centroid(coordinates(F.col("coordinates")))).filter("c is not null")
    g = c.select(*keep, feature_type(F.col("name")).alias("feature_type"), to_grid(F.col("c.lon"), F.col("c.lat")).alias("g"))
    return g.select(*keep, "feature_type", F.col("g.e").alias("x"), F.col("g.n").alias("y"))


def _texts(path: str, content: bytes) -> str:
    if not path.lower().endswith(".kmz"):
        return content.decode("utf-8")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".kml")]
        if not names:
            raise ValueError(f"there is no .kml file in {path}")
        return z.read(names[0]).decode("utf-8")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, place, name, coordinates of the placemarks of all .kml and .kmz files under a folder (or of one file).

    Of an archive the first .kml entry counts; one without fails.  Each file is read once.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.lower("path").rlike(r"\.km[lz]\z"))
    schema = "path string, place int, name string, coordinates string"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                root = ET.fromstring(_texts(path, content))
                rows += [(path, i, *placemark(e)) for i, e in enumerate(e for e in root.iter() if _local(e.tag) == "Placemark")]
            yield pd.DataFrame(rows, columns=["path", "place", "name", "coordinates"])

    return files.select("path", "content").mapInPandas(split, schema)
