"""Country names and codes by a dimension join.

A dimension is a table ``alpha2, alpha3, name`` with unique ``alpha2``. No join
hint is given: Spark broadcasts it when its size is under the session's
threshold and shuffles the (already aggregated) other side otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSION = "alpha2 string, alpha3 string, name string"


def iso_countries(spark: SparkSession) -> DataFrame:
    """The ISO 3166 countries as the JVM's locale data knows them."""
    locale = spark._jvm.java.util.Locale
    rows = []
    for code in locale.getISOCountries():
        country = locale("", code)
        rows.append((code, country.getISO3Country(), country.getDisplayCountry(locale.ENGLISH)))
    return spark.createDataFrame(rows, DIMENSION)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """A dimension of your own from a CSV file with a header."""
    return spark.read.schema(DIMENSION).option("header", True).csv(path)


def with_country_name(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Add ``country_name`` for ``country_code``; the code itself if it is unknown."""
    names = countries.select(F.col("alpha2").alias("country_code"), "name")
    code = F.col("country_code")
    return (
        df.join(names, "country_code", "left")
        .withColumn("country_name", F.when(code == "", "Unknown").otherwise(F.coalesce("name", code)))
        .drop("name")
    )


def with_alpha3(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Add ``country_code_alpha3`` and drop the countries that have none."""
    codes = countries.filter(F.col("alpha3").isNotNull()).select(
        F.col("alpha2").alias("country_code"), F.col("alpha3").alias("country_code_alpha3")
    )
    return df.join(codes, "country_code")
