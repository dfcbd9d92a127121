"""Lexing in column expressions: segments, elements and components without leaving the JVM.

For questions that need no loops (counts, codes, amounts by segment) on files without a release byte; Catalyst prunes the
columns that aren't asked for. Bytes are read as Latin-1, so every byte is one character and offsets are those of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TRIVIA = r"[ \t\r\n]*"


def _literal(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def delimiters_of(contents: DataFrame) -> DataFrame:
    """filename, text, element, component, segment, repetition; the last four are null if the text is no interchange."""
    text = F.decode("content", "ISO-8859-1")
    head = F.regexp_replace(text, "^(ï»¿)?" + _TRIVIA, "")
    element = F.when(F.substring(head, 1, 3) == "ISA", F.substring(head, 4, 1))
    parts = F.split(head, _literal(element), 17)
    ok = (F.size(parts) == 17) & (F.length(F.get(parts, F.lit(16))) >= 2)
    at = lambda i: F.when(ok, F.substring(F.get(parts, F.lit(16)), i, 1))
    repetition = F.when(ok & (F.get(parts, F.lit(12)) >= "00402") & (F.length(F.get(parts, F.lit(11))) == 1) & ~F.get(parts, F.lit(11)).rlike("[0-9A-Za-z]"), F.get(parts, F.lit(11)))
    return contents.select("filename", text.alias("text"), F.when(ok, element).alias("element"), at(1).alias("component"), at(2).alias("segment"), repetition.alias("repetition"))


def segments(contents: DataFrame, spans: bool = False) -> DataFrame:
    """filename, segment, id, elements (components of each element), terminated; spans: also raw_start and raw_end.

    Files that are no interchange have no rows.
    """
    d = delimiters_of(contents).filter("element is not null").withColumnRenamed("segment", "terminator")
    # the number of frames is computed beside the array: beside the generator it would be computed for each row
    cut = d.select("filename", "element", "component", F.split("text", _literal(F.col("terminator"))).alias("frames"))
    cut = cut.select("filename", "element", "component", "frames", F.size("frames").alias("n"))
    frames = cut.select("filename", "element", "component", "n", F.posexplode("frames").alias("segment", "frame"))
    last = F.col("segment") == F.col("n") - 1
    frames = frames.filter(~(last & (F.length("frame") == 0))).withColumn("terminated", ~last)
    body = F.regexp_replace(F.when(F.col("segment") == 0, F.regexp_replace("frame", "^ï»¿", "")).otherwise(F.col("frame")), "^" + _TRIVIA, "")
    pieces = F.split(body, _literal(F.col("element")))
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    out = frames.select("filename", F.col("segment").cast("bigint").alias("segment"), F.get(pieces, F.lit(0)).alias("id"), F.transform(rest, lambda e: F.split(e, _literal(F.col("component")))).alias("elements"), "terminated", *([(F.length("frame") + F.col("terminated").cast("int")).cast("bigint").alias("size")] if spans else []))
    if not spans:
        return out
    end = F.sum("size").over(Window.partitionBy("filename").orderBy("segment"))
    return out.withColumn("raw_end", end).withColumn("raw_start", F.col("raw_end") - F.col("size")).drop("size")


def element(position: int, component: int = 1, elements: str = "elements") -> Column:
    """A component of an element of a row of segments; null if it isn't there."""
    return F.get(F.get(F.col(elements), F.lit(position - 1)), F.lit(component - 1))
