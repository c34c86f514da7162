"""The layouts of result files as data: suffixes, columns and types, checked when they are loaded."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.sources import readers

KINDS = ("table", "series", "points", "summary", "culverts", "log", "binary")
TYPES = ("string", "double", "long", "boolean")
_COLUMN = {"name": str, "type": str, "required": bool}
_LAYOUT = {"type": str, "suffixes": list, "group": str, "layout": str, "columns": dict}


@dataclass(frozen=True)
class LayoutColumn:
    label: str
    name: str
    type: str
    required: bool


@dataclass(frozen=True)
class Layout:
    type: str
    suffixes: tuple[str, ...]
    group: str
    layout: str
    columns: tuple[LayoutColumn, ...]

    @property
    def schema(self) -> StructType:
        """What the columns are read as."""
        out = StructType()
        for c in self.columns:
            out = out.add(c.name, c.type, not c.required)
        return out

    @property
    def names(self) -> dict[str, str]:
        return {c.label: c.name for c in self.columns}

    @property
    def texts(self) -> list[str]:
        return [c.name for c in self.columns if c.type == "string"]

    @property
    def optional(self) -> list[str]:
        return [c.label for c in self.columns if not c.required]


def problems(entries: object) -> list[str]:
    """Everything that is wrong with the layouts' data, none where they can be used."""
    if not isinstance(entries, list):
        return ["the layouts are no list"]
    out, types, suffixes = [], set(), set()
    for k, e in enumerate(entries):
        where = f"layout {k}" if not isinstance(e, dict) else str(e.get("type", f"layout {k}"))
        if not isinstance(e, dict) or set(e) != set(_LAYOUT):
            out.append(f"{where}: has {sorted(e) if isinstance(e, dict) else e!r}, needs {sorted(_LAYOUT)}")
            continue
        wrong = [f"{where}: {f} is no {t.__name__}" for f, t in _LAYOUT.items() if not isinstance(e[f], t)]
        out += wrong
        if wrong:
            continue
        if e["type"] in types:
            out.append(f"{where}: given twice")
        types.add(e["type"])
        out += [f"{where}: unknown layout {e['layout']!r}"] * (e["layout"] not in KINDS) + [f"{where}: no suffix"] * (not e["suffixes"])
        for s in e["suffixes"]:
            if not isinstance(s, str) or not s or s.lower() in suffixes:
                out.append(f"{where}: suffix {s!r} is empty or taken")
            suffixes.add(str(s).lower())
        for label, c in e["columns"].items():
            if not isinstance(c, dict) or set(c) != set(_COLUMN) or any(not isinstance(c[f], t) for f, t in _COLUMN.items()):
                out.append(f"{where}: column {label!r} needs {sorted(_COLUMN)}")
            elif c["type"] not in TYPES:
                out.append(f"{where}: column {label!r} has the unknown type {c['type']!r}")
        names = [c["name"] for c in e["columns"].values() if isinstance(c, dict) and "name" in c]
        out += [f"{where}: two columns are called {n!r}" for n in sorted({n for n in names if names.count(n) > 1})]
        out += [f"{where}: a {e['layout']} needs columns"] * (e["layout"] in ("table", "series") and not e["columns"])
    return out


def load(text: str | None = None) -> dict[str, Layout]:
    """Layouts by data type, of JSON; those of the library without one. An error names all that is wrong."""
    try:
        entries = json.loads(text if text is not None else Path(__file__).with_name("layouts.json").read_text(encoding="utf-8"))
    except json.JSONDecodeError as error:
        raise ValueError(f"the layouts are no JSON: {error}") from error
    if wrong := problems(entries):
        raise ValueError("; ".join(wrong))
    columns = lambda e: tuple(LayoutColumn(label, c["name"], c["type"], c["required"]) for label, c in e["columns"].items())
    return {e["type"]: Layout(e["type"], tuple(e["suffixes"]), e["group"], e["layout"], columns(e)) for e in entries}


LAYOUTS = load()


def by_suffix(layouts: dict[str, Layout] = LAYOUTS) -> dict[str, str]:
    """Data type by suffix, the longest first, as one may end another."""
    pairs = [(s, t) for t, layout in layouts.items() for s in layout.suffixes]
    return dict(sorted(pairs, key=lambda p: (-len(p[0]), p[0])))


def of_group(group: str, layouts: dict[str, Layout] = LAYOUTS) -> list[str]:
    return [t for t, layout in layouts.items() if layout.group == group]


def cast(text: Column, kind: str) -> Column:
    """A cell as its type; null for a blank one, and for what isn't of the type."""
    own = F.nullif(F.trim(text), F.lit(""))
    return own if kind == "string" else readers.number(own) if kind == "double" else own.try_cast(kind)


def _fails(text: Column, kind: str) -> Column:
    """Whether a cell that says something isn't of its type; NaN is a number that isn't known."""
    said = F.nullif(F.trim(text), F.lit(""))
    known = said.try_cast("double") if kind == "double" else said.try_cast(kind)
    return said.isNotNull() & known.isNull() if kind != "string" else F.lit(False)


def faults(lines: DataFrame, layout: Layout) -> DataFrame:
    """(path, reason) of the files whose lines aren't of the layout: what they lack, or the first cell that isn't of its type.

    A file is taken whole or not at all. Files without any line that isn't blank aren't seen here.
    """
    if layout.layout == "table":
        own = readers.headed(lines)
        need = F.array(*[F.lit(c.label) for c in layout.columns if c.required]).cast("array<string>")
        lacks = F.array_except(need, "head_1")
        head = F.when(F.size(lacks) > 0, F.concat(F.lit("lacks "), F.array_join(lacks, ", ")))
        cell = lambda c: F.get("cells", F.array_position("head_1", F.lit(c.label)).cast("int") - 1)
        bad = [F.when(_fails(cell(c), c.type), _said(c.label, cell(c), c.type)) for c in layout.columns if c.type != "string"]
        first_body = 1
    elif layout.layout in ("series", "points"):
        heads = 1 if layout.layout == "series" else 2
        own = readers.headed(lines, heads=heads, least=2)
        head = F.when(F.size("cells") < 3, F.lit("has no columns of values"))
        kind = layout.columns[0].type if layout.columns else "double"
        at = F.lit(1) if heads == 1 else F.coalesce(readers.place_of(F.col("head_2"), "time"), readers.place_of(F.col("head_1"), "time"), F.lit(1)).cast("int")
        timed = F.when(_fails(F.get("cells", at), "double"), _said("time", F.get("cells", at), "double"))
        values = F.filter(F.slice("cells", 3, F.greatest(F.size("cells"), F.lit(1))), lambda v: _fails(v, kind))
        bad, first_body = [timed, F.when(F.size(values) > 0, _said("a value", values[0], kind))], heads
    else:
        return _without_rows(lines, layout)
    line = Window.partitionBy("path").orderBy("place")
    reason = F.when(F.col("place") == 1, head).when(F.col("place") > first_body, F.coalesce(*bad, F.lit(None).cast("string")))
    judged = own.withColumns({"_reason": reason, "_last": F.lead("place").over(line).isNull()})
    none = F.when(F.col("_last") & (F.col("place") <= first_body), F.lit("has no rows"))
    told = judged.select("path", "place", F.coalesce("_reason", none).alias("reason")).filter("reason is not null")
    return told.groupBy("path").agg(F.min_by("reason", "place").alias("reason"))


def _said(label: str, cell: Column, kind: str) -> Column:
    return F.concat(F.lit("line "), (F.col("row") + 1).cast("string"), F.lit(f", {label}: "), F.trim(cell), F.lit(f" is no {kind}"))


#: What lines of the other layouts hold.
MARKS = {"culverts": "CULVERT AND PIPE DATA", "log": "Simulation FINISHED"}


def _without_rows(lines: DataFrame, layout: Layout) -> DataFrame:
    mark = MARKS.get(layout.layout)
    if mark is None:
        return lines.select("path", F.lit(None).cast("string").alias("reason")).limit(0)
    seen = lines.groupBy("path").agg(F.max(F.contains("text", F.lit(mark))).alias("_m"))
    return seen.filter(~F.col("_m")).select("path", F.lit(f"has no line with {mark!r}").alias("reason"))


def headers_match(lines: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(path, matches) of each file's first line that isn't blank."""
    wanted = F.array(*[F.lit(c) for c in expected]).cast("array<string>")
    return readers.headed(lines).filter("place = 1").select("path", (F.col("cells") == wanted).alias("matches"))
