"""Cutting texts into chunks: by number of lines with blank-line breaks, and by code structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.files import BLANK, read_lines

MAX_LINES, BREAK_LINES = 30, 5
CHUNK_CHARS, BOUNDARY_SHARE = 4000, 0.6

# What begins a structure, tried in this order on a stripped line.
STRUCTURES = (
    (r"^class\s+(\w+)", "class"),
    (r"^(?:public|private|protected|abstract)\s+class\s+(\w+)", "class"),
    (r"^def\s+(\w+)", "function"),
    (r"^async\s+def\s+(\w+)", "function"),
    (r"^function\s+(\w+)", "function"),
    (r"^func\s+(\w+)", "function"),
    (r"^(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(?:\w+\s+)+\w+\s*\([^(]*\)", "method"),
    (r"^(?:fun\s+)?\w+\s*\.\w+\s*\(", "method"),
    (r"^pub\s+fn\s+(\w+)", "function"),
    (r"^fn\s+(\w+)", "function"),
    (r"^interface\s+(\w+)", "interface"),
    (r"^enum\s+(\w+)", "enum"),
    (r"^struct\s+(\w+)", "struct"),
    (r"^(?:struct|class)\s+\w+", "class"),
)
#: What every line that begins a structure begins with, so that most lines are told by one pattern.
ANY_STRUCTURE = r"^(?:class|public|private|protected|abstract|def|async|function|func|fun|\w+\s*\.|pub|fn|interface|enum|struct)"


def line_ranges(lines: Column, most: int = MAX_LINES, least: int = BREAK_LINES) -> Column:
    """Array of (start, end), 0-based and inclusive: a chunk ends at a blank line once it has `least` lines, at `most` lines, or
    with the text. The state is one number and the ranges so far, so a text costs time in its lines and ranges."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    rows = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.rlike(BLANK).alias("blank")))

    def step(state: Column, row: Column) -> Column:
        size = row["i"] - state["start"] + 1
        close = (size >= most) | (row["blank"] & (size >= least)) | (row["i"] == F.size(lines) - 1)
        new = F.array(F.struct(state["start"].alias("start"), row["i"].alias("end")))
        return F.struct(
            F.when(close, row["i"] + 1).otherwise(state["start"]).alias("start"),
            F.when(close, F.concat(state["out"], new)).otherwise(state["out"]).alias("out")
        )

    return F.aggregate(rows, F.struct(F.lit(0).alias("start"), empty.alias("out")), step, lambda s: s["out"])


def line_chunks(files: DataFrame, most: int = MAX_LINES, least: int = BREAK_LINES) -> DataFrame:
    """path, chunk_no (in the file, of all chunks), start_line, end_line, content for files(path, content). Chunks of
    white space alone are left out, but count in line numbers."""
    lines = files.select("path", read_lines(F.coalesce("content", F.lit(""))).alias("lines"))
    ranges = lines.select("path", "lines", F.posexplode(line_ranges(F.col("lines"), most, least)).alias("chunk_no", "r"))
    out = ranges.select(
        "path", "chunk_no", (F.col("r.start") + 1).alias("start_line"), (F.col("r.end") + 1).alias("end_line"),
        F.array_join(F.slice("lines", F.col("r.start") + 1, F.col("r.end") - F.col("r.start") + 1), "\n").alias("content"),
    )
    return out.where(~F.col("content").rlike(BLANK))


def structure_of(line: Column) -> Column:
    """Struct of kind and name of the structure that a line begins, null if none; the name is the kind where the pattern has none."""
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for pattern, kind in reversed(STRUCTURES):
        name = F.regexp_extract(line, pattern, 1) if "(\\w+)" in pattern else F.lit(kind)
        found = F.when(line.rlike(pattern), F.struct(F.lit(kind).alias("kind"), name.alias("name"))).otherwise(found)
    return F.when(line.rlike(ANY_STRUCTURE), found)


def structural_chunks(files: DataFrame, most: int = CHUNK_CHARS, share: float = BOUNDARY_SHARE) -> DataFrame:
    """path, chunk_id, start_line, end_line, chunk_type, chunk_name, content for files(path, content). A chunk ends before a line
    once it has `most` characters, or `share` of them and the line begins a structure. Its type is that of the last structure in
    it, its name that of the first; without one it is a block, or the tail at the end."""
    lines = files.select("path", F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("lines"))
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def describe(x: Column, i: Column) -> Column:
        found = F.get(F.transform(F.array(stripped(x)), structure_of), F.lit(0))
        return F.struct(i.alias("i"), (F.length(x) + 1).alias("len"), found.alias("found"))

    empty = F.array().cast("array<struct<start:int,end:int,kind:string,name:string>>")
    start = F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"),
        empty.alias("out")
    )

    def step(s: Column, row: Column) -> Column:
        new = row["found"]
        cut = (row["i"] > s["start"]) & ((s["len"] >= most) | (new.isNotNull() & (s["len"] >= most * share)))
        closed = F.array(F.struct(s["start"].alias("start"), (row["i"] - 1).alias("end"), s["kind"].alias("kind"), s["name"].alias("name")))
        return F.struct(
            F.when(cut, row["i"]).otherwise(s["start"]).alias("start"),
            (F.when(cut, 0).otherwise(s["len"]) + row["len"]).alias("len"),
            F.coalesce(new["kind"], F.when(~cut, s["kind"])).alias("kind"),
            F.coalesce(F.when(~cut, s["name"]), new["name"]).alias("name"),
            F.when(cut, F.concat(s["out"], closed)).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), F.lit(-1).alias("end"), s["kind"].alias("kind"), s["name"].alias("name"))))

    cuts = lines.select("path", "lines", F.posexplode(F.aggregate(F.transform("lines", describe), start, step, finish)).alias("n", "c"))
    last = F.col("c.end") < 0
    end = F.when(last, F.size("lines") - 1).otherwise(F.col("c.end"))
    return cuts.select(
        "path", F.concat(F.lit("chunk-"), F.col("n").cast("string")).alias("chunk_id"), (F.col("c.start") + 1).alias("start_line"), (end + 1).alias("end_line"),
        F.coalesce("c.kind", F.when(last, "tail").otherwise("block")).alias("chunk_type"),
        F.coalesce("c.name", F.when(last, F.lit("tail")).otherwise(F.concat(F.lit("block-"), F.col("n").cast("string")))).alias("chunk_name"),
        F.array_join(F.slice("lines", F.col("c.start") + 1, end - F.col("c.start") + 1), "\n").alias("content"),
    )
