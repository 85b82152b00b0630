"""Filters over catalogues and event streams. Null conditions drop a row, as in SQL, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.operators.ranking import with_position


def by_set_rank(df: DataFrame, set_col: str, start: int | None, end: int | None) -> DataFrame:
    """Rows of the sets whose place among sorted distinct set ids is in [start, end)."""
    ids = with_position(df.select(set_col).distinct(), [set_col], "_place")
    ids = ids.where((F.col("_place") >= (start or 0)) & (F.lit(True) if end is None else F.col("_place") < end))
    return df.join(ids.select(set_col), set_col, "left_semi")


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def catalogue(
    df: DataFrame,
    date_col: str,
    difficulty_col: str,
    mode_col: str,
    modes: list | None = None,
    years: tuple[int | None, int | None] = (None, None),
    difficulty: tuple[float | None, float | None] = (None, None),
) -> DataFrame:
    """Modes by list, years half-open on the date so that the scan can skip, difficulty closed. Absent bounds are open."""
    if modes is not None:
        df = df.where(F.col(mode_col).isin(modes))
    low, high = years
    if low is not None:
        df = df.where(F.col(date_col) >= F.lit(f"{low}-01-01").cast("timestamp_ntz"))
    if high is not None:
        df = df.where(F.col(date_col) < F.lit(f"{high + 1}-01-01").cast("timestamp_ntz"))
    low, high = difficulty
    if low is not None:
        df = df.where(F.col(difficulty_col) >= low)
    if high is not None:
        df = df.where(F.col(difficulty_col) <= high)
    return df


def sets_with(df: DataFrame, set_col: str, condition: Column) -> DataFrame:
    """Rows of sets for which an aggregate condition holds (HAVING): aggregated first, then a semi-join."""
    return df.join(df.groupBy(set_col).agg(condition.alias("_holds")).where("_holds").select(set_col), set_col, "left_semi")


def last_of_set(df: DataFrame, set_col: str, order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(set_col).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def of_types(df: DataFrame, type_col: str, types: list[str], keep: bool = True) -> DataFrame:
    test = F.col(type_col).isin(types)
    return df.where(test if keep else ~test)


def time_range(df: DataFrame, time_col: str, start=None, end=None, closed: bool = False) -> DataFrame:
    """[start, end), or [start, end] if closed; an absent bound is open."""
    if start is not None:
        df = df.where(F.col(time_col) >= start)
    if end is not None:
        df = df.where(F.col(time_col) <= end if closed else F.col(time_col) < end)
    return df


def replace_fragment(old: DataFrame, new: DataFrame, time_col: str, start, end) -> DataFrame:
    """`old` outside [start, end] with `new` inside it."""
    inside = F.col(time_col).between(start, end)
    return old.where(~inside).unionByName(new.where(inside))


def from_first(df: DataFrame, part: str, time_col: str, flag: Column) -> DataFrame:
    """Rows not before their group's first flagged row; groups without a flagged row go."""
    first = F.min(F.when(flag, F.col(time_col))).over(Window.partitionBy(part))
    return df.withColumn("_first", first).where(F.col(time_col) >= F.col("_first")).drop("_first")


def filled(defaults: dict, zero_is_missing: bool = False) -> list[Column]:
    """Columns with null (and zero, if so asked) replaced by defaults."""
    value = lambda c, d: F.nullif(F.col(c), F.lit(0).cast("double")) if zero_is_missing else F.col(c)
    return [F.coalesce(value(c, d), F.lit(d)).alias(c) for c, d in defaults.items()]


def non_default(settings: Column, defaults: Column) -> Column:
    """Entries of a map whose values differ from those of another map (null counts as a value)."""
    return F.map_filter(settings, lambda k, v: ~v.eqNullSafe(F.element_at(defaults, k)))
