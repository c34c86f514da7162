"""Filters, header and range checks, duplicates and missing members of ensembles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY_COLUMNS = ("Chan ID", "Location", "Node ID", "ID")


def entity_filter(df: DataFrame, wanted: Sequence[str], columns: Sequence[str] = ENTITY_COLUMNS) -> DataFrame:
    """Rows whose first present identifier column, trimmed, is wanted; no such column, or nothing wanted, filters nothing."""
    names = [w.strip() for w in wanted if w.strip()]
    column = next((c for c in columns if c in df.columns), None)
    return df.filter(F.trim(F.col(f"`{column}`")).isin(names)) if column and names else df


def allowed(name: Column, include: Sequence[str], exclude: Sequence[str] = (), case_sensitive: bool = False, empty_allows: bool = True) -> Column:
    """In ``include`` (if empty, ``empty_allows`` says whether all are) and not in ``exclude``."""
    fold = (lambda s: s.strip()) if case_sensitive else (lambda s: s.strip().lower())
    own = F.trim(name) if case_sensitive else F.lower(F.trim(name))
    inside = own.isin([fold(x) for x in include]) if include else F.lit(empty_allows)
    return inside & ~own.isin([fold(x) for x in exclude]) if exclude else inside


def containing(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column contains the text, whatever the case; all rows if none does."""
    hit = F.coalesce(F.contains(F.lower(F.col(f"`{column}`")), F.lit(part.lower())), F.lit(False))
    some = df.agg(F.coalesce(F.max(hit), F.lit(False)).alias("_some"))
    return df.join(F.broadcast(some), hit | ~F.col("_some")).drop("_some")  # one row


def filtered_tables(tables: Mapping[str, DataFrame], wanted: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of several data types with the wanted entities alone; those that are left without rows go."""
    own = {k: entity_filter(df, wanted) for k, df in tables.items()}
    return {k: df for k, df in own.items() if not df.isEmpty()}


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def header_status(found: Sequence[str], needed: Sequence[str], exact: bool = False) -> str:
    """SUCCESS, HEADER_MISMATCH for another order or other columns where the header is exact, FAILURE if some are missing."""
    if set(needed) - set(found):
        return "FAILURE"
    return "HEADER_MISMATCH" if exact and list(found) != list(needed) else "SUCCESS"


def expected_members(count: int = 10) -> Column:
    return F.array(*[F.lit(f"TP{i:02d}") for i in range(1, count + 1)])


def member_sets(df: DataFrame, keys: Sequence[str], tp: str, count: int = 10) -> DataFrame:
    """Missing members of each ensemble, null keys kept; ``complete`` if none is."""
    have = df.groupBy(*keys).agg(F.collect_set(F.when(F.array_contains(expected_members(count), F.col(tp)), F.col(tp))).alias("_have"))
    missing = F.array_except(expected_members(count), F.col("_have"))
    return have.select(*keys, missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def missing_members(df: DataFrame, keys: Sequence[str], tp: str, count: int = 10) -> DataFrame:
    """A row for each missing member; none at all unless some ensemble is complete."""
    sets = member_sets(df, keys, tp, count)
    some = sets.filter("complete").select(F.lit(1).alias("_some")).limit(1)
    return sets.join(some, F.lit(True), "left_semi").select(*keys, F.explode("missing").alias("missing_tp"))


def coverage_grid(df: DataFrame, run: str, aep: str, duration: str, tp: str, count: int = 10) -> DataFrame:
    """For each run the grid of its event and duration values: how many members are missing, and a message.

    Six missing members or more are told by their number alone.
    """
    sets = member_sets(df, [run, aep, duration], tp, count)
    grid = df.select(run, aep).distinct().join(df.select(run, duration).distinct(), run)
    out = grid.join(sets, [run, aep, duration], "left").withColumn("missing", F.coalesce("missing", expected_members(count)))
    n = F.size("missing")
    text = F.when(n == 0, "complete").when(n >= 6, F.concat(n.cast("string"), F.lit(" missing"))).otherwise(F.array_join("missing", ","))
    return out.select(run, aep, duration, n.alias("n_missing"), text.alias("message"))


def duplicates(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Groups with more than one row, with their first and last member."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).filter("n > 1")


def counts_with_first(df: DataFrame, keys: Sequence[str], member: str, first: int) -> DataFrame:
    """(keys, n, member): how many rows each group has, and its ``first`` least members, cut down before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    least = df.select(*keys, member).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(member))).filter(F.col("_r") <= first)
    return least.drop("_r").join(counts, list(keys))


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, parts: int = 1024) -> DataFrame:
    """``df`` with the place of each row, from 1, in its group by a number ``order``, however few and large the groups are.

    The numbers' range is cut into equal parts; rows are numbered within a part, after the counts of the parts before.
    Nulls come first; rows of equal numbers follow each other in any order.
    """
    span = df.agg(F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    part = F.when(F.col(order).isNull(), -1).otherwise(F.floor(share * parts))
    placed = df.join(F.broadcast(span)).withColumn("_part", part).drop("_lo", "_hi")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order))
    out = placed.withColumn("_within", within)
    named = counts.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    out = out.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [out["_part"] == named["_part"]])
    return out.select(*df.columns, (F.col("_within") + F.col("_before")).cast("int").alias(name))


def duplicate_contents(df: DataFrame, member: str, content: str, kind: str) -> DataFrame:
    """Members of equal content with the one that is kept, the least. Contents are hashed where they are read."""
    hashed = df.select(member, kind, F.octet_length(content).alias("size"), F.sha2(content, 256).alias("digest"))
    groups = hashed.groupBy(kind, "size", "digest").agg(F.min(member).alias("kept"), F.count("*").alias("copies")).filter("copies > 1")
    return hashed.join(groups, [kind, "size", "digest"]).filter(F.col(member) != F.col("kept"))
