"""From raw inventory to a clean, labelled table: file-name metadata, label join, rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.scalars import (as_col, base_name, hourly_rate, named_groups, period_of_day,
                                      regex_group, to_number)

# Default renames of a ground-truth file and the readable column order.
LABEL_RENAMES = {"TIMESTAMP": "timestamp", "filename": "file_name", "total_rain": "mm_5min",
                 "rain_class": "category", "rain": "is_rain"}
COLUMN_ORDER = ["file_name", "timestamp", "period", "is_rain", "mm_5min", "mm_hr", "category",
                "recorder", "location", "file_path"]
TIME_PARTS = ["year", "month", "day", "hour", "minute", "second"]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; the table has {df.columns}")


def extract_groups(df: DataFrame, source: str, pattern: str) -> DataFrame:
    """One column per named group of a regex, searched anywhere in the source column."""
    if source not in df.columns:
        return df
    java, groups = named_groups(pattern)
    return df.withColumns({name: regex_group(source, java, i) for name, i in groups.items()})


def clean_recorder(c: str | Column) -> Column:
    return F.coalesce(regex_group(c, r"(SMM\d+)", 1), as_col(c))


def dashed_number(c: str | Column) -> Column:
    """`'0-2'` is 0.2; anything unreadable is NULL."""
    return to_number(F.translate(as_col(c), "-", "."))


def timestamp_from_parts(year, month, day, hour, minute, second) -> Column:
    """NULL for an impossible date or a missing part."""
    y, mo, d, h, mi, s = (as_col(c).cast("string") for c in (year, month, day, hour, minute, second))
    text = F.concat(y, F.lit("-"), mo, F.lit("-"), d, F.lit(" "), h, F.lit(":"), mi, F.lit(":"), s)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def extract_filename_metadata(df: DataFrame, pattern: str) -> DataFrame:
    """Regex groups of `file_name` plus the columns derived from them; a group that the pattern lacks is skipped."""
    out = extract_groups(df, "file_name", pattern)
    new: dict[str, Column] = {}
    if "recorder" in out.columns:
        new["recorder"] = clean_recorder("recorder")
    if "rain_mm_str" in out.columns:
        new["mm_5min"] = dashed_number("rain_mm_str")
        new["mm_hr"] = hourly_rate(dashed_number("rain_mm_str"))
    if all(p in out.columns for p in TIME_PARTS):
        new["timestamp"] = timestamp_from_parts(*TIME_PARTS)
    if "hour" in out.columns:
        new["period"] = period_of_day("hour")
    if "category" in out.columns:
        new["category"] = F.coalesce(F.col("category"), F.lit("unlabeled"))
    return out.withColumns(new).drop("rain_mm_str") if new else out


def robust_boolean(c: str | Column) -> Column:
    """0/1 to boolean; every other value is NULL (count them with `unreadable_booleans`)."""
    number = to_number(as_col(c).cast("string")) if not isinstance(c, str) else to_number(F.col(c).cast("string"))
    return F.when(number == 1, F.lit(True)).when(number == 0, F.lit(False))


def unreadable_booleans(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count_if(F.col(c).isNotNull() & robust_boolean(c).isNull()).alias("unreadable"),
                  F.count("*").alias("total"))


def first_per_key(df: DataFrame, key: str, ordinal: str | Column) -> DataFrame:
    """First row per key by an explicit order; an aggregate with map-side combine, so a hot key is no hot task."""
    order = as_col(ordinal)
    row = F.min_by(F.struct(*df.columns), F.struct(order.alias("o")))
    return df.groupBy(F.col(key).alias("_k")).agg(row.alias("_r")).select("_r.*")


def merge_labels(df: DataFrame, labels: DataFrame, key: str = "file_name", renames: Mapping[str, str] | None = None,
                 no_overwrite: Sequence[str] = (), ordinal: str | Column | None = None) -> DataFrame:
    """Left join of recordings with ground truth.

    One label row per key (the first by `ordinal`; tables have no file order, so without it the
    smallest row wins), label values win over raw ones unless they are NULL or the column is
    protected. Labels are joined by AQE's choice: broadcast if measured small.
    """
    gt = labels.withColumnsRenamed(dict(LABEL_RENAMES if renames is None else renames))
    require_columns(df, key)
    require_columns(gt, key)
    if "is_rain" in gt.columns:
        gt = gt.withColumn("is_rain", robust_boolean("is_rain"))
    if dict(gt.dtypes)[key] == "string":
        gt = gt.withColumn(key, base_name(key))
    if ordinal is not None:
        gt = first_per_key(gt, key, ordinal)
    else:
        gt = first_per_key(gt, key, F.struct(*[c for c in gt.columns if c != key]))
    shared = [c for c in gt.columns if c in df.columns and c != key]
    right = gt.withColumnsRenamed({c: f"{c}_gt" for c in shared})
    joined = df.join(right, key, "left")
    resolved = joined.withColumns(
        {c: F.coalesce(F.col(f"{c}_gt"), F.col(c)) for c in shared if c not in no_overwrite}) if shared else joined
    return readable_order(resolved.drop(*[f"{c}_gt" for c in shared]))


def readable_order(df: DataFrame, first: Sequence[str] = tuple(COLUMN_ORDER)) -> DataFrame:
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def clean_category(c: str | Column) -> Column:
    v = F.lower(F.trim(as_col(c)))
    return F.nullif(F.when(v == "no rain", F.lit("no-rain")).otherwise(v), F.lit("nan"))


def sanitise(df: DataFrame) -> DataFrame:
    """Drop the raw `rain` flag, unify categories, recompute the hourly rate."""
    out = df.drop("rain")
    new = {}
    if "category" in out.columns:
        new["category"] = clean_category("category")
    if "mm_5min" in out.columns:
        new["mm_hr"] = hourly_rate("mm_5min")
    return out.withColumns(new) if new else out


def discard(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Remove rows for which any rule (a SQL expression) is true. NULL keeps the row. One pushed-down filter."""
    keep = None
    for rule in rules:
        one = ~F.coalesce(F.expr(rule).cast("boolean"), F.lit(False))
        keep = one if keep is None else keep & one
    return df if keep is None else df.filter(keep)


def discard_audit(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Rows removed by each rule, counted at the first rule that hits; rule 0 is the kept rest."""
    hit = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        hit = F.when(F.coalesce(F.expr(rule).cast("boolean"), F.lit(False)), F.lit(i)).otherwise(hit)
    return df.groupBy(hit.alias("rule")).agg(F.count("*").alias("rows"))


def daily_status(amount: str | Column) -> Column:
    """NULL counts as dry."""
    return F.when(as_col(amount) > 0, F.lit("Wet (Rain)")).otherwise(F.lit("Dry (No Rain)"))


def season_filter(df: DataFrame, ts: str, amount: str, months: Sequence[int] = (1, 2, 3, 4, 5, 6, 7)) -> DataFrame:
    """Rows of the rainy months with a positive amount, plus the short month name."""
    return (df.filter(F.month(ts).isin(list(months)) & (F.col(amount) > 0))
            .withColumn("month_name", F.date_format(ts, "MMM")))


def in_list(df: DataFrame, c: str, values: Sequence | DataFrame) -> DataFrame:
    """Membership: literals become IN, a table becomes a semi join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(c)), c, "left_semi")
    return df.filter(F.col(c).isin(list(values)))
