"""Codes for the values of a text column whose order is the text's, over the whole table, and columns that data name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.reshape import quoted

#: Parts that the range of values is cut into; bytes after what all values begin with that tell a value's part.
PARTS, BYTES = 4096, 6


def _shared(low: Column, high: Column) -> Column:
    """How many characters two texts begin with together; all texts between them begin with these."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(low), F.length(high)), F.lit(1))), lambda i: (F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i)) & (F.length(low) >= i) & (F.length(high) >= i)))


def _place(text: Column, skip: Column) -> Column:
    """A number that never falls as the text rises."""
    head = F.substring(F.encode(F.substring(text, skip + 1, F.length(text)), "utf-8"), 1, BYTES)
    return F.conv(F.rpad(F.hex(head), 2 * BYTES, "0"), 16, 10).cast("double")


def ordered_codes(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """(value, code): each distinct value's place, from 0, in the order of the text; nulls are called ``missing`` or left out.

    Values are dealt into parts of their range, after what all of them begin with, and numbered within a part after the
    counts of the parts before, so that no task sees all of them.
    """
    own = quoted(column).cast("string")
    values = df.select((own if missing is None else F.coalesce(own, F.lit(missing))).alias("value")).filter("value is not null").distinct()
    ends = values.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    ends = ends.select(_shared(F.col("_lo"), F.col("_hi")).alias("_skip"), "_lo", "_hi")
    ends = ends.select("_skip", _place(F.col("_lo"), F.col("_skip")).alias("_lo"), _place(F.col("_hi"), F.col("_skip")).alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (_place(F.col("value"), F.col("_skip")) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    placed = values.join(F.broadcast(ends)).select("value", F.floor(share * (PARTS - 1)).cast("int").alias("_part"))  # one row of ends
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of PARTS rows
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("value"))
    return placed.withColumn("_within", within).join(counts, "_part").select("value", (F.col("_before") + F.col("_within") - 1).alias("code"))


def encoded(df: DataFrame, column: str, codes: DataFrame, name: str, missing: str | None = None) -> DataFrame:
    """``df`` with the code of its column's value; -1 for what has none."""
    sought = quoted(column).cast("string") if missing is None else F.coalesce(quoted(column).cast("string"), F.lit(missing))
    named = codes.select(F.col("value").alias("_value"), F.col("code").cast("long").alias("_code"))
    out = df.withColumn("_sought", sought).join(named, F.col("_sought") == F.col("_value"), "left")
    return out.select(*[quoted(c) for c in df.columns], F.coalesce("_code", F.lit(-1)).alias(name))


def merged(codes: DataFrame, df: DataFrame, column: str, missing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(codes of the old and new values together, (old_code, code) by which what is encoded already can be renewed)."""
    own = quoted(column).cast("string")
    new = df.select((own if missing is None else F.coalesce(own, F.lit(missing))).alias("value"))
    every = ordered_codes(codes.select("value").unionByName(new), "value")
    return every, codes.select("value", F.col("code").alias("old_code")).join(every, "value").select("old_code", "code")


def token_columns(df: DataFrame, tokens: str, prefix: str = "R", limit: int = 99) -> DataFrame:
    """``df`` with a column for each place of an array, R01, R02 and so on, as many as the longest has.

    One pass over the arrays' sizes tells how many, when the query is built; more than ``limit`` are an error.
    """
    n = df.agg(F.max(F.size(quoted(tokens)))).first()[0] or 0
    if n > limit:
        raise ValueError(f"{tokens} has {n} places, more than {limit}")
    return df.withColumns({f"{prefix}{k + 1:02d}": F.get(quoted(tokens), F.lit(k)) for k in range(n)})


def flattened(df: DataFrame, entries: str, suffix: str = "_meta", limit: int = 200) -> DataFrame:
    """``df`` with a column for each key of a map instead of the map; a key that is a column's name gets the suffix.

    The keys are gathered once, when the query is built; more than ``limit`` are an error, and so are two of one name.
    """
    found = [r["k"] for r in df.select(F.explode(F.map_keys(quoted(entries))).alias("k")).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{entries} has more than {limit} keys")
    kept = [c for c in df.columns if c != entries]
    taken = {c.lower() for c in kept}
    names = {k: k if k.lower() not in taken else f"{k}{suffix}" for k in sorted(found)}
    lowered = [n.lower() for n in names.values()]
    if clash := sorted({n for n in lowered if lowered.count(n) > 1 or n in taken}):
        raise ValueError(f"{entries} gives several columns called {', '.join(clash)}")
    return df.select(*[quoted(c) for c in kept], *[quoted(entries).getItem(k).alias(n) for k, n in names.items()])


def renewed(df: DataFrame, code: str, mapping: DataFrame) -> DataFrame:
    """``df`` with codes of an older dictionary replaced by those of ``merged``; -1 stays."""
    out = df.join(mapping.withColumnsRenamed({"old_code": "_old", "code": "_new"}), quoted(code) == F.col("_old"), "left")
    return out.select(*[F.coalesce("_new", quoted(code)).alias(c) if c == code else quoted(c) for c in df.columns])
