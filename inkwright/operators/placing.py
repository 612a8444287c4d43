"""Where pieces of a table belong: rows that a box holds together, lines of tall cells, headings above a ruled box; and where a rewrite puts each place of a text."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.functions import geometry as G
from inkwright.functions.arrow import arrow


def boxed_rows(rows: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, to_row: rows (row and box) whose middle stands in a drawn box (box and sides) with that of another row; they join the first of them. Of several boxes the one with the earliest row counts."""
    own = rows.withColumns({"_cx": G.centre_x(), "_cy": G.centre_y()}).select(*keys, "row", "_cx", "_cy")
    held = own.join(boxes.select(*keys, "box", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]), keys).filter(F.col("_cx").between(F.col("_x0"), F.col("_x1")) & F.col("_cy").between(F.col("_y0"), F.col("_y1")))
    first = held.groupBy(*keys, "box").agg(F.min("row").alias("to_row"), F.count_distinct("row").alias("_n")).filter("_n > 1").drop("_n")
    return held.select(*keys, "box", "row").join(first, [*keys, "box"]).groupBy(*keys, "row").agg(F.min("to_row").alias("to_row"))


def dealt_lines(lines: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cell, row, text: the lines (cell, line, text, y0, y1) of tall cells given to the rows (row, top, foot) they share most height with, the first of equals; lines that share none go to no row."""
    met = lines.join(rows, keys).withColumn("_s", F.least("y1", "foot") - F.greatest("y0", "top")).filter("_s > 0")
    best = met.groupBy(*keys, "cell", "line", "text", "y0").agg(F.max_by("row", F.struct(F.col("_s"), -F.col("row"))).alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "line", "text"))), lambda s: s["text"]), " ")
    return best.groupBy(*keys, "cell", "row").agg(text.alias("text"))


def headings_above(words: DataFrame, columns: DataFrame, keys: list[str], size: float = 10.0) -> DataFrame:
    """keys, tab, col, text: words (word, text, box) just above a table's top and within its columns (tab, col, low, high, top), if they fall in two columns or more: a heading that the drawn box has missed."""
    centre = (F.col("x0") + F.col("x1")) / 2
    near = words.join(columns, keys).filter((F.col("top") - F.col("y1")).between(-0.3 * size, 1.5 * size) & (centre >= F.col("low")) & (centre < F.col("high")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "word", "text"))), lambda s: s["text"]), " ")
    found = near.groupBy(*keys, "tab", "col").agg(text.alias("text"))
    enough = found.groupBy(*keys, "tab").agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys, "tab")
    return found.join(enough, [*keys, "tab"], "left_semi")


def places(rule: re.Pattern, replacement: str, value: str) -> tuple[str, np.ndarray]:
    """The text rewritten, and where each of its places, and its end, went; four bytes a place, as a batch holds those of all its texts."""
    out, at, done, shift = [], array("i"), 0, 0
    for m in rule.finditer(value):
        new = m.expand(replacement)
        at.extend(range(done + shift, m.start() + shift))
        at.extend(m.start() + shift + min(i, len(new)) for i in range(m.end() - m.start()))
        out += [value[done : m.start()], new]
        done, shift = m.end(), shift + len(new) - (m.end() - m.start())
    at.extend(range(done + shift, len(value) + 1 + shift))
    return "".join([*out, value[done:]]), np.frombuffer(at, "int32")


def rewritten(text: Column, pattern: str, replacement: str) -> Column:
    """A struct of the text with the pattern replaced, and of the place that each of its places, and its end, has there.

    Within a stretch that is replaced a place keeps its distance from the start, as far as the replacement goes. Null stays null.
    """
    rule = re.compile(pattern)

    @arrow("struct<text:string,at:array<int>>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else places(rule, replacement, v) for v in values], columns=["text", "at"])

    return run(text)
