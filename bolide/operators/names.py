"""Shortened names: initials, surname and a few digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that are not shortened by the rule.
EXCEPTIONS = {
    "Fred L. Drake, Jr.": "FL Drake2",
    "Walker Hale IV": "W Hale4",
    "Jonas H.": "Jonas H",
    "Tattoo Mabonzo K.": "tmk",
    "Sarah K.": "Sarah K",
    "Sunny K": "Sunny K",
    "Donald Wallace Rouse II": "DW Rouse2",
    "Constantina S.": "Constantina S",
    "Matthieu S": "Matthieu S",
    'Jean-Baptiste "Jiba" Lamy': "J Lamy",
    'Bruno "Polaco" Penteado': "P Penteado",
    "Bryce \"Zooko\" Wilcox-O'Hearn": "Z Wilcox-O'Hearn",
}


def name_digits(name: Column) -> Column:
    """Two to eight digits that depend only on the name."""
    digest = F.md5(name)
    length = F.lit(2) + F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 7
    return F.substring(F.translate(digest, "abcdef", "012345"), F.lit(3), length)


def short_name(name: Column) -> Column:
    """Initials of the forenames that start with a letter, surname, digits."""
    clean = F.trim(name)
    words = F.split(clean, r"\s+")
    forenames = F.slice(words, F.lit(1), F.size(words) - 1)
    lettered = F.filter(forenames, lambda w: F.regexp_like(w, F.lit(r"^\p{L}")))
    initials = F.array_join(F.transform(lettered, lambda w: F.substring(w, 1, 1)), "")
    rule = F.trim(F.concat_ws(" ", initials, F.element_at(words, -1), name_digits(clean)))
    special = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(special, clean), rule)


def read_names(spark: SparkSession, path: str, header_lines: int = 13) -> DataFrame:
    """Names after the header lines of each text file under ``path``.

    A split's lines are numbered one by one, so a line's place in its file's first split
    is its number less the split's smallest. The header must lie in the first split.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("name"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    firsts = lines.filter("block = 0").groupBy("file").agg(F.min("place").alias("first"))
    return (
        lines.join(firsts, "file")
        .filter((F.col("block") > 0) | (F.col("place") - F.col("first") >= header_lines))
        .select(F.trim("name").alias("name"))
        .filter(F.length("name") > 0)
    )


def write_names(names: DataFrame, path: str) -> None:
    """One name per line, in an order that looks random but depends on the name."""
    names.orderBy(F.md5("name")).select("name").write.mode("overwrite").text(path)
