"""GFF3 rows with their attributes as a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chrom string, origin string, type string, left long, right long, score string, strand string, phase string, attrs string"


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(line, chrom, type, left, right, strand, attributes) of a plain or gzipped file.

    ``line`` ascends in the order of the file.  Values of attributes are percent-decoded.
    """
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(SCHEMA).csv(path).where("type IS NOT NULL")
    pairs = F.filter(F.split("attrs", ";"), lambda x: F.trim(x) != "")
    entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.url_decode(F.replace(F.regexp_replace(x, "^[^=]*=?", ""), F.lit("+"), F.lit("%2B"))).alias("value"))
    # Of an attribute given twice the last counts.
    attributes = F.aggregate(F.transform(pairs, entry), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))
    return rows.select(F.monotonically_increasing_id().alias("line"), "chrom", "type", "left", "right", "strand", attributes.alias("attributes"))
