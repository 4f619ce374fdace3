"""Brands: normalisation, car-page titles, and the dictionaries they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import folded, stripped

# Other names of brands.
ALIASES = {
    "ISCH": ["Isch"], "Moskvitch": ["azlk", "Moskvitch"], "Lada": ["LADA", "WAS", "VAZ"], "Abarth": ["abarth", "ABARTH"], "Fiat": ["PSA / Fiat", "PSA/Fiat", "Fiat"],
    "B. Engineering": ["B Engineering"], "VW": ["vw", "volkswagen", "VOLKSWAGEN C.V.", "Volkswagen"], "Opel": ["opel"], "Vauxhall": ["Vauxhall", "vauxhall", "vauxhall motors"],
    "Škoda": ["skoda"], "BMW": ["bmw"], "Audi": ["audi"], "Kia": ["kia"],
    "Mercedes-Benz": ["Mercedes", "mercedes", "mercedes benz", "Daimler", "daimler", "daimler benz", "benz", "Benz", "Mercedes Benz", "mercedes benz", "Mercedes-AMG"],
    "Nissan": ["nissan"], "Mitsubishi": ["mitsubishi"], "Renault": ["renault", "Renault Sport"], "Ford": ["ford", "fornd"], "Mazda": ["mazda"], "Chrysler": ["chrysler", "Chrysler-Simca"],
    "Toyota": ["toyota", "tokyo"], "Suzuki": ["suzuki", "susuki", "Mazdaspeed"], "Volvo": ["volvo"], "Peugeot": ["peugeot"], "Seat": ["seat", "SEAT"], "GMC": ["gmc"],
    "Citroën": ["citroen", "DS", "ds"], "Porsche": ["porsche", " VW-Porsche"], "Lexus": ["lexus"], "Chevrolet": ["chevrolet"], "Dacia": ["dacia"], "Jaguar": ["jaguar"],
    "Daihatsu": ["daihatsu"], "Jeep": ["jeep", "CHRYSLER JEEP"], "Smart": ["smart"], "Hyundai": ["hyundai"], "Mini": ["mini"], "Dodge": ["dodge"], "Honda": ["honda"], "Talbot": ["talbot"],
    "Subaru": ["subaru"], "Buick": ["buick"], "Saab": ["saab"], "Land Rover": ["Range Rover", "Range-Rover", "Land-Rover"], "Yue Loong": ["Arex", "AREX"], "TagAZ": ["Tagaz"],
    "Harper Sports Cars": ["HSC"], "Morgan Motor": ["MORGAN MOTOR COMPANY", "Morgan"], "Rolls-Royce": ["Rolls Royce", "Rolls-Royce Motor Cars"], "Aston Martin": ["ASTON MARTIN LAGONDA"],
    "Bentley": ["BENTLEY MOTORS"], "MAN": ["MAN-Büssing", "MAN-Meccanica", "MAN-VW"],
}


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(brand, alias, priority): a brand's own name comes before its aliases, brands in the order given."""
    rows = [(b, a, i) for i, (b, names) in enumerate((aliases or ALIASES).items()) for a in (b, *names)]
    return spark.createDataFrame(rows, "brand string, alias string, priority int")


def _names(aliases: DataFrame, brands: DataFrame) -> DataFrame:
    """(folded name, brand): aliases first, then the list of brands (brand)."""
    both = aliases.select(folded(F.col("alias")).alias("name"), "brand", "priority").unionByName(brands.select(folded(F.col("brand")).alias("name"), "brand", F.lit(1 << 30).alias("priority")))
    return both.filter("name <> ''").groupBy("name").agg(F.min(F.struct("priority", "brand")).getField("brand").alias("_brand"))


def normalized(df: DataFrame, column: str, aliases: DataFrame, brands: DataFrame, out: str = "brand") -> DataFrame:
    """df with the brand that column names, whatever its case; '' where it names none (null and empty included)."""
    return df.join(_names(aliases, brands), folded(F.col(column)) == F.col("name"), "left").withColumn(out, F.coalesce("_brand", F.lit(""))).drop("name", "_brand")


def normalized_loosely(df: DataFrame, column: str, aliases: DataFrame, brands: DataFrame, out: str = "brand") -> DataFrame:
    """The same, and an alias counts that contains what column says. The distinct values are met with the few aliases
    first, by the three-letter pieces they share, and the rest as above; shorter values must be an alias."""
    asked = df.select(folded(F.col(column)).alias("asked")).filter("asked <> ''").distinct()
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    named = aliases.select(folded(F.col("alias")).alias("alias"), "brand", "priority").withColumn("piece", F.explode(pieces(F.col("alias"))))
    first = asked.withColumn("piece", F.substring("asked", 1, 3))
    met = first.join(named, "piece").filter(F.col("alias").contains(F.col("asked"))).groupBy("asked").agg(F.min(F.struct("priority", "brand")).getField("brand").alias("_loose"))
    exact = normalized(df, column, aliases, brands, "_exact")
    return exact.join(met, folded(F.col(column)) == F.col("asked"), "left").withColumn(out, F.coalesce("_loose", "_exact")).drop("asked", "_loose", "_exact")


def title_to_car(titles: DataFrame, aliases: DataFrame, brands: DataFrame, vehicles: DataFrame, ignored: DataFrame, column: str = "title") -> DataFrame:
    """(title, brand, model): each distinct page title split by the longest of its prefixes that names a brand.

    Titles on the ignore list go. A title in the vehicle dictionary (raw, brand, name) is that. Of one length an alias
    comes before a brand, which must end where a word ends. What follows the prefix is the model, without a dash or
    slash in front; a title whose model is empty or all in brackets goes. Prefixes are exploded, at most the title's
    length, and met by equality.
    """
    rows = titles.select(F.col(column).alias("title")).filter("title is not null and title <> ''").distinct()
    rows = rows.join(ignored.select(F.col(ignored.columns[0]).alias("title")), "title", "left_anti")
    exact = vehicles.select(F.col("raw").alias("title"), F.col("brand").alias("v_brand"), F.col("name").alias("v_model")).dropDuplicates(["title"])
    rows = rows.join(exact, "title", "left")
    cut = rows.filter("v_brand is null").select("title", F.explode(F.sequence(F.length("title"), F.lit(1), F.lit(-1))).alias("n"))
    cut = cut.withColumn("prefix", folded(F.substring(F.col("title"), F.lit(1), F.col("n"))))
    names = aliases.select(folded(F.col("alias")).alias("prefix"), "brand", "priority").unionByName(brands.select(folded(F.col("brand")).alias("prefix"), "brand", F.lit(1 << 30).alias("priority")))
    met = cut.join(names.filter("prefix <> ''"), "prefix")
    rest = F.regexp_replace(stripped(F.substring(F.col("title"), F.col("n") + 1, F.lit(1 << 30))), r"^[-/]", "")
    met = met.withColumn("model", stripped(rest)).filter((F.col("priority") < 1 << 30) | (F.substring(F.col("title"), F.col("n") + 1, F.lit(1)).rlike(r"^\W?$")))
    met = met.filter((F.col("model") != "") & ~F.col("model").rlike(r"^\(.*\)$"))
    first = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("n"), "priority", "brand"))
    by_prefix = met.withColumn("rank", first).filter("rank = 1").select("title", "brand", "model")
    return rows.filter("v_brand is not null").select("title", F.col("v_brand").alias("brand"), F.col("v_model").alias("model")).unionByName(by_prefix)
