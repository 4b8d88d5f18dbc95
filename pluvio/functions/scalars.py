"""Column expressions shared by the operators. All of them stay on the JVM side."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Period-of-day limits (left-closed hours) and their names in order.
PERIOD_EDGES = [0, 6, 12, 18, 24]
PERIOD_LABELS = ["overnight", "morning", "afternoon", "night"]


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """Pattern in Java syntax without group names, plus name -> group number."""
    groups = dict(re.compile(pattern).groupindex)
    plain = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{groups[m.group(1)]}", pattern)
    return re.sub(r"\(\?P<[^>]+>", "(", plain), groups


def regex_group(c: ColumnLike, java_pattern: str, index: int) -> Column:
    """First match anywhere; NULL when the group did not take part (or matched the empty string)."""
    return F.nullif(F.regexp_extract(as_col(c), java_pattern, index), F.lit(""))


def to_number(c: ColumnLike) -> Column:
    """Numeric coercion: anything that is not a finite number becomes NULL."""
    return finite(as_col(c).try_cast("double"))


def finite(c: ColumnLike) -> Column:
    """NaN and infinities to NULL."""
    v = as_col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def finite_sql(name: str) -> str:
    """`finite` of a column as SQL text, for tables with many features."""
    return f"if(isnan(double(`{name}`)) or abs(double(`{name}`)) = double('infinity'), null, double(`{name}`))"


def bucketize(c: ColumnLike, edges: Sequence[float], labels: Sequence) -> Column:
    """Left-closed bins `[e0, e1), [e1, e2) ...`; values outside and NULL give NULL."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one label per bin")
    v, out = as_col(c), None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (v >= low) & (v < high)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def period_of_day(hour: ColumnLike) -> Column:
    return bucketize(to_number(hour), PERIOD_EDGES, PERIOD_LABELS)


def hourly_rate(mm_5min: ColumnLike) -> Column:
    """mm per 5 minutes to mm per hour, rounded half to even at 2 places."""
    return F.rint(as_col(mm_5min) * 12 * 100) / 100


def month_key(ts: ColumnLike) -> Column:
    return F.trunc(as_col(ts), "MM")


def month_label(ts: ColumnLike) -> Column:
    """`Jan 2025`; sort by `month_key`, not by this text."""
    return F.date_format(as_col(ts), "MMM yyyy")


def literal_map(mapping: Mapping[str, str], key: ColumnLike) -> Column:
    """Look a value up in a small fixed map; NULL when absent."""
    k, out = as_col(key), None
    for source, target in mapping.items():
        hit = k == source
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return F.lit(None).cast("string") if out is None else out


def base_name(path: ColumnLike) -> Column:
    """Last component of a `/` or `\\` path, trailing separators ignored."""
    return F.regexp_extract(as_col(path), r"([^/\\]+)[/\\]*$", 1)


def hash_id(file_name: ColumnLike, device: ColumnLike | None = None, timestamp: ColumnLike | None = None) -> Column:
    """First 16 hex digits of SHA-256 over `name_device_timestamp`; absent parts are empty."""
    parts = [F.coalesce(as_col(p).cast("string"), F.lit("")) if p is not None else F.lit("")
             for p in (file_name, device, timestamp)]
    return F.substring(F.sha2(F.concat_ws("_", *parts), 256), 1, 16)


def normalise_label(c: ColumnLike) -> Column:
    """Lower case, dashes and underscores to blanks, trimmed."""
    return F.trim(F.translate(F.lower(as_col(c).cast("string")), "-_", "  "))


def title_case(c: ColumnLike) -> Column:
    """Every run of letters starts upper case, the rest lower (a slash or dash also starts a word)."""
    words = F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.initcap(w)), "")


def safe_ratio(num: ColumnLike, den: ColumnLike, zero: Column | None = None) -> Column:
    """num / den, or `zero` (NULL by default) when den is 0."""
    ratio = F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))
    return ratio if zero is None else F.coalesce(ratio, zero)


def seeded_hash(keys: Sequence[ColumnLike], seed: int) -> Column:
    """Reproducible random order: md5 of the row key and the seed, the same on any cluster."""
    parts = [F.coalesce(as_col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_bucket(h: ColumnLike, digits: int = 3) -> Column:
    """Leading hex digits as an integer; keeps the order of the hash."""
    return F.conv(F.substring(as_col(h), 1, digits), 16, 10).cast("int")


def hash_number(h: ColumnLike) -> Column:
    """Leading 60 bits of an md5 text; keeps its order and fits a number column."""
    return F.conv(F.substring(as_col(h), 1, 15), 16, 10).cast("bigint")


def hash_int(h: ColumnLike) -> Column:
    """Leading 32 bits of an md5 text as a non-negative integer."""
    return F.conv(F.substring(as_col(h), 1, 8), 16, 10).cast("bigint")


def hash_unit(keys: Sequence[ColumnLike], seed: int) -> Column:
    """Uniform number in [0, 1) from the seeded hash."""
    return hash_int(seeded_hash(keys, seed)) / F.lit(4294967296.0)
