"""Order of columns and rows in tables that people read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.reshape import quoted

#: Columns that tell where a row is from; they stand at the end.
PATH_COLUMNS = ("file", "rel_path", "path", "directory_path", "rel_directory")


def reordered(df: DataFrame, first: Sequence[str], prefixes: Sequence[str] = (), second: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """First columns, those with a prefix by name, second ones, the rest by name, and the last ones; absent names are skipped."""
    have, out = list(df.columns), []
    ends = [c for c in last if c in have]
    starts = [*first, *(c for p in prefixes for c in sorted(have) if c.startswith(p)), *second, *sorted(have)]
    for c in [*(x for x in starts if x not in ends), *ends]:
        if c in have and c not in out:
            out.append(c)
    return df.select(*[quoted(c) for c in out])


def paths_last(df: DataFrame) -> DataFrame:
    """The path columns after all others, whose order stays."""
    return df.select(*[quoted(c) for c in df.columns if c not in PATH_COLUMNS], *[quoted(c) for c in PATH_COLUMNS if c in df.columns])


def grouped_order(df: DataFrame, groups: Sequence[Sequence[str]], info: Sequence[str] = ()) -> DataFrame:
    """Groups of columns in order, then others as they come, then the columns of information."""
    listed = [c for g in groups for c in g if c in df.columns]
    rest = [c for c in df.columns if c not in listed and c not in info]
    return df.select(*[quoted(c) for c in dict.fromkeys([*listed, *rest, *(c for c in info if c in df.columns)])])


def without_columns(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Without the columns whose name contains one of the parts, whatever the case."""
    return df.select(*[quoted(c) for c in df.columns if not any(p.lower() in c.lower() for p in parts)])


def first_present(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Columns renamed to the names that they are aliases of, whatever their case; a name without any alias is an error."""
    have = {c.lower(): c for c in df.columns}
    found = {name: next((have[a.lower()] for a in (name, *others) if a.lower() in have), None) for name, others in aliases.items()}
    if missing := [name for name, c in found.items() if c is None]:
        raise KeyError(f"no column for {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df.withColumnsRenamed({c: name for name, c in found.items()})


def number_in(text: Column) -> Column:
    """The first number of a text, by which events are sorted."""
    return F.regexp_extract(text, r"([0-9]*\.?[0-9]+)", 1).try_cast("double")


def sorted_by(df: DataFrame, columns: Sequence[str | Column], descending: bool = False) -> DataFrame:
    """Rows in order of those columns that there are."""
    there = [c for c in columns if not isinstance(c, str) or c in df.columns]
    by = [quoted(c) if isinstance(c, str) else c for c in there]
    return df.orderBy(*[b.desc_nulls_last() if descending else b.asc_nulls_last() for b in by]) if by else df


def unique_sorted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, values): the distinct values of each group, as numbers in order if all are numbers, else as text."""
    own = quoted(value).cast("string")
    one = df.filter(quoted(value).isNotNull()).groupBy(*keys).agg(F.collect_set(own).alias("_v"))
    numbers = F.transform("_v", lambda x: F.struct(x.try_cast("double").alias("n"), x.alias("t")))
    plain = F.forall(numbers, lambda x: x["n"].isNotNull())
    by_number = F.transform(F.array_sort(numbers), lambda x: x["t"])
    return one.select(*keys, F.when(plain, by_number).otherwise(F.array_sort("_v")).alias("values"))


def clean_numbers(df: DataFrame, doubles: Sequence[str] = (), integers: Sequence[str] = ()) -> DataFrame:
    """Columns as numbers: what isn't one is 0 in ``doubles`` and null in ``integers``; columns that aren't there are left out."""
    as_double = {c: F.coalesce(F.nanvl(quoted(c).cast("string").try_cast("double"), F.lit(None)), F.lit(0.0)) for c in doubles if c in df.columns}
    whole = lambda c: quoted(c).cast("string").try_cast("double")
    as_long = {c: F.when(whole(c) == F.floor(whole(c)), whole(c).try_cast("long")) for c in integers if c in df.columns}
    return df.withColumns(as_double | as_long)


def number_or(text: Column, default: float | int | None, kind: str = "double") -> Column:
    """A text as a number, or the default where it isn't one."""
    return F.coalesce(F.trim(text).try_cast(kind), F.lit(default).cast(kind))


def grouping_keys(df: DataFrame, optional: Sequence[str], required: Sequence[str]) -> list[str]:
    """Those of the optional keys that there are, and the required ones; an error names what is required and missing."""
    if missing := [c for c in required if c not in df.columns]:
        raise KeyError(f"no column {', '.join(missing)} to group by; there are {', '.join(df.columns)}")
    return [c for c in (*optional, *required) if c in df.columns]
