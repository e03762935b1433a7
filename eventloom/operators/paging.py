"""Sorts, pages and top-k with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.predicates import end


def keyset_page(df: DataFrame, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """limit + 1 rows after (start_date, key): the extra one tells that there is more."""
    if after:
        d, k = F.lit(after[0]).cast("date"), F.lit(after[1])
        df = df.filter((F.col("start_date") > d) | ((F.col("start_date") == d) & (F.col("key") > k)))
    return df.orderBy("start_date", "key").limit(limit + 1)


def browse_order(today: Column) -> list[Column]:
    """Upcoming soonest first, then past most recent first."""
    past = end() < today
    return [past.asc(), F.when(~past, F.col("start_date")).asc(), F.when(~past, F.col("key")).asc(), F.when(past, F.col("start_date")).desc(), F.when(past, F.col("key")).desc()]


def offset_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the total; the total is one small aggregate, not a window over all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group (Spark keeps n per group before it shuffles)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def stratified(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """One of each group first, then the rest in order, n rows in all."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.orderBy(F.col("rn") > 1, *order).limit(n)
