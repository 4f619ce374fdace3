"""Fuel-price histories: block fill, currency, merging, means, latest rows and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import inserted

PRICES = ("euro_ttc", "euro_ht", "diesel_ttc", "diesel_ht")
UNIT, QUANTITY = "liter", 1000


def constants(prices: DataFrame) -> DataFrame:
    """prices with unit, quantity and the price of a euro in euros."""
    return prices.withColumns({"unit": F.lit(UNIT), "quantity": F.lit(QUANTITY), "euro_price": F.lit(1.0)})


def filled_blocks(sheet: DataFrame) -> DataFrame:
    """(sheet, row_idx, code, ...) where a code stands in a block's header row only: the rows below get it, up to the
    next code; header rows, which have no date, go."""
    above = F.last("code", ignorenulls=True).over(Window.partitionBy("sheet").orderBy("row_idx"))
    return sheet.withColumn("code", above).filter("date is not null and code is not null")


def in_euros(prices: DataFrame, *columns: str) -> DataFrame:
    """Values in foreign money (euro_price 0) divided by the exchange rate taux."""
    return prices.withColumns({c: F.when(F.col("euro_price") == 0, F.try_divide(F.col(c), F.col("taux"))).otherwise(F.col(c)) for c in columns})


def per_unit(price: Column, quantity: Column) -> Column:
    return F.try_divide(price, quantity)


def merged_tax_sides(with_tax: DataFrame, without_tax: DataFrame, *keys: str) -> DataFrame:
    """Rows with tax (euro_super_95, diesel) and without, full outer on keys, as euro_ttc, diesel_ttc, euro_ht, diesel_ht."""
    names = {"euro_super_95": "euro", "diesel": "diesel"}
    side = lambda df, end: df.select(*keys, *[F.col(c).alias(f"{n}_{end}") for c, n in names.items()])
    return side(with_tax, "ttc").join(side(without_tax, "ht"), list(keys), "full_outer")


def merged_histories(old: DataFrame, new: DataFrame, *keys: str, fields: tuple[str, ...] = PRICES) -> DataFrame:
    """Two histories, full outer on keys; a field of the later one wins where it has a value."""
    left = old.select(*keys, *[F.col(c).alias(f"{c}__old") for c in fields])
    return left.join(new.select(*keys, *fields), list(keys), "full_outer").select(*keys, *[F.coalesce(F.col(c), F.col(f"{c}__old")).alias(c) for c in fields])


def mean_over_countries(prices: DataFrame) -> DataFrame:
    """The price of each date for all countries: the mean over those that have one."""
    return prices.groupBy("date").agg(*[F.avg(c).alias(c) for c in PRICES], F.max("quantity").alias("quantity"))


def latest(prices: DataFrame, *keys: str) -> DataFrame:
    """The row of the latest date for each key, per litre; a single row without keys. Repeated dates: the least values'."""
    fields = F.struct("date", *[F.negate(F.col(c)).alias(c) for c in PRICES], "quantity")
    out = prices.groupBy(*keys).agg(F.max(fields).alias("p")).filter("p is not null")
    return out.select(*keys, F.col("p.date").alias("date"), *[per_unit(-F.col(f"p.{c}"), F.col("p.quantity")).alias(c) for c in PRICES])


def first_year(prices: DataFrame) -> DataFrame:
    """The year of each country's first price."""
    return prices.groupBy("country").agg(F.year(F.min("date")).alias("first_year"))


def not_yet_stored(new: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Rows of new whose keys aren't stored; of a repeated key the greatest row by the other columns. A null in a key is a value
    like any other."""
    return inserted(stored, new, *keys)


def excel_date(serial: Column, datemode: int = 0) -> Column:
    """The date of a spreadsheet's serial number; datemode 1 counts from 1904."""
    return F.date_add(F.lit("1904-01-01" if datemode else "1899-12-30").cast("date"), serial.cast("int"))
