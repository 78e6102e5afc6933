"""Columns derived from a path. A path is bytes; text made from it is for reading only."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLASH = b"/"


def lossy(path: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(path.cast("string"))


def parent_of(text: Column) -> Column:
    return F.when(F.instr(text, "/") > 0, F.regexp_extract(text, "(?s)^(.*)/[^/]*$", 1))


def name_of(text: Column) -> Column:
    return F.regexp_extract(text, "(?s)([^/]*)$", 1)


def extension_of(name: Column) -> Column:
    """After the last dot that is neither first nor last, ASCII letters lower-cased; else null."""
    found = F.translate(F.regexp_extract(name, "(?s)^.+[.]([^.]+)$", 1), UPPER, LOWER)
    return F.when(found != "", found)


def mime_dimension(spark: SparkSession) -> DataFrame:
    """(extension, mime_type) of the types that Python's standard library knows, not those of this machine. Changing it makes files look updated."""
    known = mimetypes.MimeTypes(filenames=())
    table = {e[1:].lower(): t for e, t in sorted(known.types_map[True].items())}
    keys, values = F.lit("\n".join(table)), F.lit("\n".join(table.values()))
    zipped = F.arrays_zip(F.split(keys, "\n").alias("extension"), F.split(values, "\n").alias("mime_type"))
    return spark.range(1).select(F.explode(zipped).alias("m")).select("m.extension", "m.mime_type")


def described(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """df with parent_path, name, extension, mime_type and mime_source. The table of types has a fixed size and is broadcast."""
    df = df.withColumn("_text", lossy(F.col(path)))
    df = df.withColumn("parent_path", parent_of(F.col("_text"))).withColumn("name", name_of(F.col("_text"))).withColumn("extension", extension_of(F.col("name"))).drop("_text")
    df = df.join(F.broadcast(mime_dimension(df.sparkSession)), "extension", "left")
    return df.withColumn("mime_source", F.when(F.col("mime_type").isNotNull(), "extension").otherwise("unknown"))


def absolute(base: Column, path: Column) -> Column:
    return F.concat(base, F.lit("/"), path.cast("string"))


def ancestors_or_self(path: Column) -> Column:
    """The path and every prefix of it that ends before a slash, as bytes; the empty path isn't among them."""
    cuts = F.filter(F.sequence(F.lit(2), F.octet_length(path)), lambda i: F.substring(path, i, F.lit(1)) == F.lit(SLASH))
    above = F.transform(cuts, lambda i: F.substring(path, F.lit(1), i - 1))
    return F.when(F.octet_length(path) >= 2, F.array_append(above, path)).when(F.octet_length(path) == 1, F.array(path)).otherwise(F.array().cast("array<binary>"))


def hidden(path: Column) -> Column:
    """Whether any part of a text path starts with a dot."""
    return F.startswith(path, F.lit(".")) | F.contains(path, F.lit("/."))
