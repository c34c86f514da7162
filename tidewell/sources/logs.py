"""Run logs: what a log's head and tail tell of a run, in one pass over its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scenario import found, token_like, tokens
from tidewell.sources.files import file_name, with_scenario

#: Lines at a log's end that tell how the run ended; a head that is known whole is read no further than HEAD lines.
TAIL, HEAD, KNOWN = 100, 4000, 4
#: Field, label, whether lines begin with it, and how the value is taken; the last line that gives one counts.
HEAD_LABELS = [
    ("version", "Build:", True, "text"), ("username", "Simulations Log Folder == ", True, "leaf"), ("computer", "Computer Name:", True, "text"),
    ("gpu_ids", "GPU Device IDs", False, "ids"), ("bc_dbase", "BC Database == ", False, "leaf"), ("tgc", "Geometry Control File == ", False, "leaf"),
    ("tbc", "BC Control File == ", False, "leaf"), ("ecf", "ESTRY Control File == ", False, "stem"), ("tef", "BC Event File == ", False, "stem"),
    ("tef", "Trying to open (I) file ", False, "opened"), ("results_path", "Output Files to be Pre-fixed by:", False, "text"),
]
#: The same of the tail.
TAIL_LABELS = [
    ("tcf_path", "Input File:", True, "text"), ("log_path", "Log File:", True, "text"), ("model_end", "End Time (h):", False, "number"), ("model_start", "Start Time (h):", False, "number"),
    ("mass_error", "Final Cumulative ME:", False, "percent"), ("end_status", "Simulation FINISHED", False, "line"),
]
#: Labels of run times, and the sections of the tail that give one each.
CLOCKS, SECTIONS = {"runtime": "Clock Time:", "cpu": "Processor Time:"}, {"init": "Initialisation Times", "final": "Final Times"}
_NUMBERS = ("model_end", "model_start", "mass_error")
_OLD_SOLVER = "! GPU Solver from 2016-03 Release or earlier invoked."


def told(line: Column, label: str, begins: bool, kind: str) -> Column:
    """What a line tells after its label, null where it doesn't: all of it, the last part of a path or that up to a dot, the
    file that was opened, a number, one before a per cent sign or the hours in brackets, or the line itself."""
    at = F.instr(line, label)
    rest = F.trim(F.substring(line, at + len(label), F.length(line)))
    leaf = F.when(F.contains(rest, F.lit("\\")), F.trim(F.substring_index(rest, "\\", -1)))
    opened = F.substring_index(leaf, "...OK.", 1)
    value = {
        "text": rest, "leaf": leaf, "stem": F.substring_index(leaf, ".", 1), "opened": F.when(F.endswith(opened, F.lit(".tef")) & (opened != leaf), opened), "ids": F.nullif(F.trim(F.translate(rest, "=", " ")), F.lit("")),
        "number": F.substring_index(rest, " ", 1).try_cast("double").cast("string"), "percent": F.when(F.contains(rest, F.lit("%")), F.substring_index(rest, "%", 1).try_cast("double").cast("string")),
        "hours": F.trim(F.substring_index(F.substring_index(rest, "[", -1), "h]", 1)).try_cast("double").cast("string"), "line": F.trim(line),
    }[kind]
    return F.when(at == 1 if begins else at > 0, value)


def last_told(rules: list[tuple[str, str, bool, str]], within: Column) -> dict[str, Column]:
    """Aggregates: for each field the value of the last line within that tells it."""
    fields = {}
    for field, *rule in rules:
        fields.setdefault(field, []).append(told(F.col("text"), *rule))
    return {k: F.max_by(F.coalesce(*v), F.when(within & F.coalesce(*v).isNotNull(), F.col("line"))) for k, v in fields.items()}


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with the block that they stand in, the section of the tail, and how much of the head is known by then."""
    text, order = F.col("text"), Window.partitionBy("path").orderBy("line")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.trim(text) == "", "").when(F.contains(text, F.lit("Specified Events:")), "event").when(F.contains(text, F.lit("Specified Scenarios:")), "scenario")
    opens = opens.when(F.contains(text, F.lit("Number of defined variables:")), "variable")
    started = F.try_to_timestamp(found(text, r"^Simulation Started\s*:\s*(.+?)\.?\s*$"), F.lit("yyyy-MMM-dd HH:mm"))
    out = lines.withColumns({"_block": F.last(opens, ignorenulls=True).over(before), "_started": started, "_n": F.max("line").over(Window.partitionBy("path"))})
    ends = (F.trim(text) == "") & F.col("_block").isin("event", "scenario")
    said = text.rlike(r"^Computer Name:") | F.col("_started").isNotNull() | ends | text.rlike(r"No Specified (Scenarios|Events)\.")
    out = out.withColumn("_told", F.coalesce(said, F.lit(False)).cast("int")).withColumn("_known", F.sum("_told").over(upto))
    enough = F.when((F.col("_known") == KNOWN) & (F.col("line") >= HEAD), F.col("line"))
    out = out.withColumns({"_tail": F.col("line") > F.col("_n") - TAIL, "_head": F.col("line") <= F.coalesce(F.min(enough).over(Window.partitionBy("path")), F.col("_n"))})
    done = F.when(F.col("_tail") & F.contains(text, F.lit("Simulation FINISHED")), F.col("line"))
    out = out.withColumn("_done", F.min(done).over(Window.partitionBy("path")))
    error = told(text, "Final Cumulative ME:", False, "percent")
    final = F.when(F.col("_tail") & error.isNotNull() & (F.col("line") > F.col("_done")), F.col("line"))
    out = out.withColumn("_final", F.min(final).over(Window.partitionBy("path")))
    section = F.coalesce(*[F.when(F.contains(text, F.lit(label)), k) for k, label in SECTIONS.items()])
    out = out.withColumn("_section", F.last(F.when(F.col("_tail"), section), ignorenulls=True).over(upto))
    return out.withColumn("_tail", F.col("_tail") & (F.col("line") <= F.coalesce("_final", "_n")))


def settings(marked: DataFrame) -> DataFrame:
    """(path, settings): events, scenarios, variables and event sources of each log; of equal keys the last one counts."""
    text, block = F.col("text"), F.col("_block")
    source = r"(?i)BC Event Source\s*==\s*([^|]+?)\s*\|\s*(.+?)\s*$"
    variable = r"(?i)^\s*Set Variable\s+(~[ES]\d*~|\w+)\s*==\s*(.+?)\s*$"
    pair = r"^\s*(\S+)\s+(.*\S)\s*$"
    named = F.lower(F.regexp_replace(found(text, source), r"(?i)~([ES]\d*)~", "-$1"))
    of = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    entry = F.when(text.rlike(source), of(F.concat(F.lit("bcdbase: "), named), found(text, source, 2)))
    entry = entry.when(F.col("_head") & block.isin("event", "scenario") & text.rlike(pair), of(found(text, pair), found(text, pair, 2)))
    entry = entry.when(F.col("_head") & (block == "variable") & text.rlike(variable) & ~text.rlike(r"(?i)^\s*Set Variable\s+~[ES]\d*~"), of(found(text, variable), found(text, variable, 2)))
    each = marked.select("path", "line", entry.alias("e")).filter("e is not null")
    last = each.groupBy("path", "e.k").agg(F.max_by("e.v", "line").alias("v"))
    return last.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("settings"))


def run_summary(lines: DataFrame) -> DataFrame:
    """A row for each log that is complete, with what its head, its tail and its file's name tell.

    ``completion`` is 1 once the run is said to have finished and 2 once the final mass error follows; a log counts as
    complete with 2, or with 1 and a final run time. The head must have told computer, start, events and scenarios.
    """
    marked = _marked(lines)
    head = [c.alias(k) for k, c in last_told(HEAD_LABELS, F.col("_head")).items()]
    tail = [(c.cast("double") if k in _NUMBERS else c).alias(k) for k, c in last_told(TAIL_LABELS, F.col("_tail")).items()]
    clocks = [(f"{s}_{k}", label, s) for s in SECTIONS for k, label in CLOCKS.items()]
    times = [last_told([(k, label, False, "hours")], F.col("_tail") & (F.col("_section") == s))[k].cast("double").alias(k) for k, label, s in clocks]
    note = F.max(F.when(F.col("_head") & F.contains("text", F.lit(_OLD_SOLVER)), F.lit(_OLD_SOLVER))).alias("version_note")
    known = F.max(F.when(F.col("_head"), F.col("_known"))).alias("_known")
    start = F.max_by("_started", F.when(F.col("_head") & F.col("_started").isNotNull(), F.col("line"))).alias("start")
    completion = F.when(F.max("_final").isNotNull(), 2).when(F.max("_done").isNotNull(), 1).otherwise(0).alias("completion")
    out = marked.groupBy("path").agg(start, *head, note, *tail, *times, completion, known)
    out = out.filter((F.col("completion") == 2) | (F.col("completion") == 1) & F.col("final_runtime").isNotNull()).filter(F.col("_known") == KNOWN).drop("_known")
    out = out.join(settings(marked), "path", "left").withColumn("settings", F.coalesce("settings", F.create_map().cast("map<string,string>")))
    out = out.withColumn("tcf", F.regexp_extract("tcf_path", r"([^/\\]*)$", 1))
    named = with_scenario(out.withColumn("name", file_name(F.col("path"))))
    return named.withColumn("trim_tcf", without_values(F.col("run_code"), F.col("settings"))).drop("name", "data_type")


def without_values(code: Column, known: Column) -> Column:
    """The run code without the tokens that are values of its events (-e) and scenarios (-s)."""
    values = F.transform(F.map_values(F.map_filter(known, lambda k, v: k.startswith("-e") | k.startswith("-s"))), F.lower)
    return F.array_join(F.filter(tokens(code), lambda t: (F.trim(t) != "") & ~F.array_contains(values, F.lower(t))), "_")


def checked(text: Column, kind: str) -> Column:
    """The pattern, duration or event that a name must tell; an error where it doesn't."""
    pattern = {"tp": r"TP(\d{1,2})", "duration": r"(\d{3,5})m", "aep": r"(\d+(?:\.\d{1,2})?)p"}[kind]
    own = token_like(text, pattern)
    return F.when(own.isNotNull(), own).otherwise(F.raise_error(F.concat(F.lit(f"no {kind} in "), F.coalesce(text, F.lit("null")))))
