"""Station tables and feature collections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions import scalars as S

STATION_SCHEMA = "WEATHER_STATION_ID string, ISO_8601_TIMESTAMP string, LONGITUDE double, LATITUDE double, RAINRATE_VALUE double"


def _stations(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("WEATHER_STATION_ID").alias("station"), S.iso_timestamp(F.col("ISO_8601_TIMESTAMP")).alias("ts"), F.col("LONGITUDE").alias("lon"), F.col("LATITUDE").alias("lat"), S.finite(F.col("RAINRATE_VALUE")).alias("rate")
    )


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station records of a CSV file or of all files in a folder, headers required; values that are no numbers are NULL."""
    return _stations(spark.read.schema(STATION_SCHEMA).csv(path, header=True, enforceSchema=False)).withColumn("record", F.monotonically_increasing_id())


def stream_stations(spark: SparkSession, path: str) -> DataFrame:
    return _stations(spark.readStream.schema(STATION_SCHEMA).csv(path, header=True))


_COLLECTION = "type string, features array<struct<type: string, id: variant, geometry: string, properties: map<string, variant>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(idx, feature_id, geom_type, geometry, properties, id, values) of GeoJSON feature collections; an error for other documents.

    ``properties`` are texts, as rules compare them; ``id`` and ``values`` keep the types of the document.
    """
    text = spark.read.text(path, wholetext=True)
    d = text.select(F.from_json("value", _COLLECTION).alias("d")).select("d.*")
    bad = F.when(F.col("type").eqNullSafe("FeatureCollection") & F.col("features").isNotNull(), F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast(d.schema["features"].dataType))
    f = d.select(F.posexplode(bad).alias("idx", "f"))
    kind = F.get_json_object("f.geometry", "$.type")
    texts = F.transform_values("f.properties", lambda _, v: v.cast("string"))
    f = f.withColumn("texts", texts)
    own = F.coalesce(F.col("f.id").cast("string"), F.try_element_at("texts", F.lit("id")), F.col("idx").cast("string"))
    return f.select("idx", own.alias("feature_id"), kind.alias("geom_type"), F.col("f.geometry").alias("geometry"), F.col("texts").alias("properties"), F.col("f.id").alias("id"), F.col("f.properties").alias("values"))


def with_values(features: DataFrame, names: list[str]) -> DataFrame:
    """``features`` with the columns ``names`` among their properties; a property of the same name is replaced."""
    new = F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(F.col(n).cast("variant") for n in names)))
    old = F.coalesce("values", F.create_map().cast("map<string,variant>"))
    return features.withColumn("values", F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(names)), new))


def overlay(features: DataFrame, wanted: str | None = None) -> DataFrame:
    """Features with ``label``: the wanted property, else the first filled one of the usual names."""
    usual = ["name", "Name", "NAME", "nome", "NOME", "NOME_COM", "COMUNE"]  # fixed values
    return features.withColumn("label", S.first_filled(F.col("properties"), ([wanted] if wanted else []) + usual))


def rings(features: DataFrame) -> DataFrame:
    """``features`` with ``ring`` (flat outer ring of polygons) and its box x0, y0, x1, y1; NULL for other geometries."""
    outer = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>")[0]
    f = features.withColumn("outer", F.when(F.col("geom_type") == "Polygon", outer))
    xs, ys = F.transform("outer", lambda p: p[0]), F.transform("outer", lambda p: p[1])
    return f.withColumn("ring", F.flatten(F.transform("outer", lambda p: F.slice(p, 1, 2)))).select("*", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")).drop("outer")


def _line(features: DataFrame) -> F.Column:
    properties = F.col("values") if "values" in features.columns else F.col("properties")
    own = F.col("id") if "id" in features.columns else F.col("feature_id")
    own = F.coalesce(own, F.col("feature_id").cast("variant")) if "id" in features.columns else own
    return F.to_json(F.struct(F.lit("Feature").alias("type"), own.alias("id"), F.parse_json("geometry").alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def write_features(features: DataFrame, path: str) -> None:
    """One feature to a line, in order of ``idx``, as newline-delimited GeoJSON that Spark and other tools read in parts."""
    features.repartitionByRange("idx").sortWithinPartitions("idx").select(_line(features).alias("value")).write.text(path)


def write_collection(features: DataFrame, path: str, properties: dict | None = None) -> None:
    """One FeatureCollection in order of ``idx``; features go through the driver one by one."""
    rows = features.select("idx", _line(features).alias("value")).orderBy("idx").select("value").toLocalIterator()

    def pieces():
        yield '{"type":"FeatureCollection",' + (f'"properties":{json.dumps(properties)},' if properties else "") + '"features":['
        for k, r in enumerate(rows):
            yield (",\n" if k else "\n") + r["value"]
        yield "\n]}\n"

    _write(features.sparkSession, path, pieces())


def write_outflow(arrays: DataFrame, grid: DataFrame, path: str, interval_s: float) -> None:
    """Points of outflow (node, base, particles_per_interval, total) as newline-delimited GeoJSON."""
    a = arrays.join(grid.select(F.col("cell_id").alias("node"), "r", "c", "x", "y"), "node")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    properties = F.struct(F.col("r").alias("row"), F.col("c").alias("col"), "particles_per_interval", F.col("total").alias("total_particles"), F.col("base").alias("interval_index_offset"), F.lit(float(interval_s)).alias("save_interval_s"))
    a.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def _write(spark: SparkSession, path: str, pieces) -> None:
    """A text file on any file system that Spark reaches, written beside its place and renamed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    here, there = hadoop(path), hadoop(path + ".part")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(there, True)
    try:
        for x in pieces:
            out.write(bytearray(x.encode()))
    finally:
        out.close()
    fs.delete(here, False)
    if not fs.rename(there, here):
        raise OSError(f"cannot rename {there} to {here}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _write(spark, path, [text])
