"""Characters and lines as a text layer hands them over, mended: spaced letters, tall initials, TeX codes, loose accents, small lines beside large ones.

Each rule looks at neighbours within a line, or at a page's few candidates, so its windows and joins carry the
line or the page as key.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwright.functions import geometry as G

# The codes of TeX's text encodings, and accents that stand alone with the marks that they are.
OT1 = {
    0x00: "Γ", 0x01: "Δ", 0x02: "Θ", 0x03: "Λ", 0x04: "Ξ", 0x05: "Π", 0x06: "Σ", 0x07: "Υ", 0x08: "Φ", 0x09: "Ψ", 0x0A: "Ω",
    0x0B: "ff", 0x0C: "fi", 0x0D: "fl", 0x0E: "ffi", 0x0F: "ffl",
    0x10: "ı", 0x11: "ȷ", 0x12: "`", 0x13: "´", 0x14: "ˇ", 0x15: "˘", 0x16: "¯", 0x17: "˚",
    0x18: "¸", 0x19: "ß", 0x1A: "æ", 0x1B: "œ", 0x1C: "ø", 0x1D: "Æ", 0x1E: "Œ", 0x1F: "Ø",
}
T1 = {0x1B: "ff", 0x1C: "fi", 0x1D: "fl", 0x1E: "ffi", 0x1F: "ffl"}
ACCENTS = {"ˆ": "̂", "˜": "̃", "´": "́", "¨": "̈", "¸": "̧", "˚": "̊", "¯": "̄", "ˇ": "̌", "˘": "̆", "˙": "̇", "˝": "̋"}
LETTER = r"^\p{L}$"
RAW = r"^[\x00-\x08\x0B-\x1F]$"


def _pairs(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _composed() -> dict[str, str]:
    """Accent and letter to the one character that is both, for every Latin letter that has one."""
    letters = [chr(c) for c in range(0x41, 0x180) if chr(c).isalpha()]
    made = {a + b: unicodedata.normalize("NFC", b + mark) for a, mark in ACCENTS.items() for b in letters}
    return {k: v for k, v in made.items() if len(v) == 1}


def spaced_letters(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, x0, x1: the words (text, size, x0, x1) of a line, those set letter by letter closed up.

    A line of six words or more, seven tenths of them single letters or digits, is spaced if its middle gap is no wider
    than three quarters of the size; gaps of up to one and a half of it are within a word.
    """
    line, along = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("x0", "x1", "text")
    rows = words.withColumn("_g", F.col("x0") - F.lag("x1").over(along))
    gaps = F.array_sort(F.collect_list(F.when(F.col("_g") > 0, F.col("_g"))).over(line))
    rows = rows.withColumns({"_n": F.count("*").over(line), "_one": F.count_if(F.col("text").rlike(r"^[\p{L}\p{N}]$")).over(line), "_m": F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")), "_s": F.max("size").over(line)})
    spaced = (F.col("_n") >= 6) & (F.col("_one") >= 0.7 * F.col("_n")) & F.col("_m").isNotNull() & ~((F.col("_s") > 0) & (F.col("_m") > 0.75 * F.col("_s")))
    opens = F.when(spaced & (F.col("_g") <= 1.5 * F.col("_m")), 0).otherwise(1)
    rows = rows.withColumn("_o", opens).withColumn("_w", F.sum("_o").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda s: s["text"]), "")
    return rows.groupBy(*keys, "_w").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_w")


def drop_caps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (line, text, size, box) with each tall initial put back in front of the topmost line that begins at its edge, within its height.

    An initial is a letter alone, twice as large as that line or more. Of two initials on one line the left one comes first.
    """
    caps = lines.filter(F.trim("text").rlike(LETTER)).select(*keys, F.col("line").alias("_cap"), F.trim("text").alias("_ch"), F.col("size").alias("_cs"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    gap = F.col("x0") - F.col("_x1")
    near = caps.join(lines, keys).filter(
        (F.col("line") != F.col("_cap")) & (F.col("_cs") >= 2.0 * F.col("size")) & gap.between(-0.1 * F.col("_cs"), 0.5 * F.col("_cs")) & F.col("y0").between(F.col("_y0") - 0.5 * F.col("size"), F.col("_y1") - 0.5 * F.col("size"))
    )
    first = near.groupBy(*keys, "_cap", "_ch", "_x0").agg(F.min(F.struct("y0", "line")).alias("_f")).select(*keys, "_cap", "_ch", "_x0", F.col("_f.line").alias("_to"))
    joined = first.groupBy(*keys, F.col("_to").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_x0", "_ch"))), lambda s: s["_ch"]), "").alias("_lead"), F.min("_x0").alias("_left"))
    rest = lines.join(first.select(*keys, F.col("_cap").alias("line")), [*keys, "line"], "left_anti").join(joined, [*keys, "line"], "left")
    return rest.withColumn("text", F.concat(F.coalesce("_lead", F.lit("")), F.col("text"))).withColumn("x0", F.least("x0", F.coalesce("_left", F.col("x0")))).select(*lines.columns)


def tex_letters(chars: DataFrame, page: list[str], line: list[str]) -> DataFrame:
    """chars (at, ch, font, x0, x1) with the raw codes of TeX's text faces as the letters they stand for, a code's box dealt to its letters; part counts them.

    A face of twenty characters or more that are mostly letters, mostly in words of three or more, is of the old encoding if it uses a
    ligature's code, and of the newer one if it uses no codes but that one's ligatures. A code is read where a letter of its face is beside it.
    """
    along = W.partitionBy(*line).orderBy("at")
    own = chars.withColumns({"_l": F.col("ch").rlike(LETTER), "_r": F.col("ch").rlike(RAW)})
    own = own.withColumn("_k", F.when(F.col("_l"), F.col("font")))
    runs = own.withColumn("_o", F.when(F.col("_k") == F.lag("_k").over(along), 0).otherwise(1)).withColumn("_run", F.sum("_o").over(along))
    runs = runs.withColumn("_len", F.count("*").over(W.partitionBy(*line, "_run")))
    seen = runs.filter((F.trim("ch") != "") | F.col("_r"))
    code = F.when(F.col("_r"), F.ascii("ch"))
    faces = seen.groupBy(*page, "font").agg(
        F.count("*").alias("n"), F.count_if("_l").alias("letters"), F.count_if(F.col("_l") & (F.col("_len") >= 3)).alias("in_words"),
        F.bool_or(code.between(0x0B, 0x0F)).alias("old"), F.bool_and(F.when(F.col("_r"), code.between(0x1B, 0x1F))).alias("new"),
    )
    text = (F.col("n") >= 20) & (F.col("letters") >= 0.5 * F.col("n")) & (F.col("in_words") >= 0.5 * F.col("n"))
    faces = faces.filter(text).select(*page, "font", F.when(F.col("old"), "OT1").when(F.col("new"), "T1").alias("_e")).filter("_e IS NOT NULL")
    beside = lambda f: F.coalesce((f("font").over(along) == F.col("font")) & f("_l").over(along), F.lit(False))
    known = own.withColumn("_b", beside(F.lag) | beside(F.lead)).join(faces, [*page, "font"], "left")
    stands = F.when(F.col("_e") == "OT1", F.try_element_at(_pairs(OT1), F.ascii("ch"))).when(F.col("_e") == "T1", F.try_element_at(_pairs(T1), F.ascii("ch")))
    letters = F.when(F.col("_r") & F.col("_b"), F.filter(F.split(stands, ""), lambda x: x != ""))
    dealt = known.withColumn("_n", F.coalesce(F.size(F.nullif(letters, F.array().cast("array<string>"))), F.lit(1))).select("*", F.posexplode(F.coalesce(letters, F.array("ch"))).alias("part", "_ch"))
    step = (F.col("x1") - F.col("x0")) / F.col("_n")
    return dealt.withColumns({"ch": F.col("_ch"), "x0": F.col("x0") + F.col("part") * step, "x1": F.when(F.col("part") + 1 == F.col("_n"), F.col("x1")).otherwise(F.col("x0") + (F.col("part") + 1) * step)}).select(*chars.columns, "part")


def composed_accents(chars: DataFrame, line: list[str]) -> DataFrame:
    """chars (at, ch, font, size, x0, x1) of a line with accents of their own joined to the letter of their face that they are over: the one before, else the one behind."""
    along = W.partitionBy(*line).orderBy("at")
    middle = (F.col("x0") + F.col("x1")) / 2
    accent = F.col("ch").isin(*ACCENTS)

    def over(f) -> Column:
        of = lambda c: f(c).over(along)
        slack = 0.15 * F.greatest(of("size"), F.lit(1.0))
        made = F.try_element_at(_pairs(_composed()), F.concat("ch", of("ch")))
        return F.when(accent & (of("font") == F.col("font")) & middle.between(of("x0") - slack, of("x1") + slack), made)

    marked = chars.withColumns({"_before": over(F.lag), "_behind": over(F.lead)})
    marked = marked.withColumn("_behind", F.when(F.col("_before").isNull(), F.col("_behind")))
    text = F.coalesce(F.lead("_before").over(along), F.lag("_behind").over(along), F.col("ch"))
    return marked.withColumn("ch", text).filter(F.col("_before").isNull() & F.col("_behind").isNull()).select(*chars.columns)


def satellites(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, satellite, host: small lines (line, n_words, size, baseline, box) of up to six words that stand on a larger one: within its span and, by their baseline, within its height."""
    host = lines.filter("n_words >= 2").select(*keys, F.col("line").alias("host"), F.col("size").alias("_s"), F.col("baseline").alias("_b"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    met = lines.filter("n_words <= 6").join(host, keys).filter(
        (F.col("line") != F.col("host")) & (F.col("size") < 0.85 * F.col("_s")) & (F.col("x0") >= F.col("_x0")) & (F.col("x1") <= F.col("_x1")) & F.col("baseline").between(F.col("_y0"), F.col("_y1"))
    )
    best = F.min(F.struct(F.abs(F.col("baseline") - F.col("_b")).alias("d"), F.col("host")))
    return met.groupBy(*keys, F.col("line").alias("satellite")).agg(best.alias("m")).select(*keys, "satellite", F.col("m.host").alias("host"))


def standing_numbers(lines: DataFrame, name: str = "line") -> DataFrame:
    """lines (text in `name`, x0, x1) with value and x for each number of one to four digits that stands alone in it: where it is along the line by its share of the characters."""
    rule = r"(?<![\w./:\-–,$])([0-9]{1,4})(?![\w./:\-–%$,])"
    found = F.regexp_extract_all(name, F.lit(rule), F.lit(1))
    gaps = F.split(F.col(name), rule)
    length = F.length(name)
    # what is in front of the nth number: all gaps before it and the numbers between them
    start = lambda i: F.aggregate(F.slice("_gaps", F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("_found", F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g))
    rows = lines.withColumns({"_found": found, "_gaps": gaps}).filter(F.size("_found") > 0)
    spots = F.transform("_found", lambda v, i: F.struct(v.cast("long").alias("value"), ((start(i) + F.length(v) / 2) / F.greatest(F.lit(1), length)).alias("share")))
    each = rows.select(*lines.columns, F.explode(spots).alias("_s"))
    return each.select(*lines.columns, F.col("_s.value").alias("value"), (F.col("x0") + F.col("_s.share") * (F.col("x1") - F.col("x0"))).alias("x"))


# ---- tests of a row, a cell, a box ------------------------------------------------------------------


def across_columns(placed: DataFrame, keys: list[str], size: float = 10.0) -> DataFrame:
    """keys, across: whether a line's words (col, x0, x1) go from one column to another over less than a wide word space."""
    along = W.partitionBy(*keys).orderBy("x0", "x1", "col")
    steps = placed.withColumn("_a", (F.col("col") != F.lag("col").over(along)) & (F.col("x0") - F.lag("x1").over(along) < 0.6 * size))
    return steps.groupBy(*keys).agg(F.coalesce(F.bool_or("_a"), F.lit(False)).alias("across"))


def multicell(segments: DataFrame, keys: list[str], size: float = 10.0) -> DataFrame:
    """keys, multicell: whether two neighbours of a row's segments (x0, x1) stand at least four fifths of the size apart."""
    along = W.partitionBy(*keys).orderBy("x0", "x1")
    return segments.withColumn("_g", F.col("x0") - F.lag("x1").over(along)).groupBy(*keys).agg(F.coalesce(F.max("_g") >= 0.8 * size, F.lit(False)).alias("multicell"))


def runs_on(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, runs_on: whether the lines (text) read as one paragraph: few of them begin with a capital, or there are fewer than three."""
    said = lines.filter(F.trim("text") != "")
    return said.groupBy(*keys).agg(((F.count("*") < 3) | (F.count_if(F.trim("text").rlike(r"^\p{Lu}")) <= 0.3 * F.count("*"))).alias("runs_on"))


def has_text(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def column_of(boxes: DataFrame, columns: DataFrame, keys: list[str], box_id: str) -> DataFrame:
    """keys, box_id, col: the column (col, low, high) that a box shares most with, the first of equals."""
    met = boxes.join(columns, keys)
    shared = F.least("x1", "high") - F.greatest("x0", "low")
    return met.groupBy(*keys, box_id).agg(F.max_by("col", F.struct(F.greatest(shared, F.lit(-1.0)).alias("s"), (-F.col("col")).alias("c"))).alias("col"))


LETTER_PAGE = 792.0  # points of the longer side, from which marks scale
LEAST_MARK, MOST_MARK = 3.0, 30.0


def mark_sized(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Whether a mark could be drawn in a box of that size and no long shape, on a page of that size: pages larger than a letter draw larger marks."""
    scale = F.greatest(F.lit(1.0), F.greatest(F.coalesce(page_width, F.lit(0.0)), F.coalesce(page_height, F.lit(0.0))) / LETTER_PAGE)
    side = lambda x: x.between(LEAST_MARK * scale, MOST_MARK * scale)
    return side(width) & side(height) & (width / F.greatest(height, F.lit(0.1))).between(0.4, 2.5)


def icons(figures: DataFrame, tables: DataFrame, lines: DataFrame, keys: list[str], size: float = 10.0, gap: float = 3.0) -> DataFrame:
    """keys, figure, place: figures of a mark's size that stand in a table or at the head of a line, and so are no pictures.

    figures: figure and box, already of that size; a line's head is level with the figure and begins up to `gap` sizes behind it.
    """
    c = F.col
    own = figures.withColumns({"_cx": G.centre_x(), "_cy": G.centre_y()})
    box = lambda df: df.select(*keys, *[c(x).alias(f"_{x}") for x in ("x0", "y0", "x1", "y1")])
    inside = c("_cx").between(c("_x0"), c("_x1")) & c("_cy").between(c("_y0"), c("_y1"))
    held = own.join(box(tables), keys).filter(inside).select(*keys, "figure", F.lit("in a table").alias("place"), F.lit(0).alias("_r"))
    level = (c("_y1") >= c("y0")) & (c("_y0") <= c("y1")) & (F.abs((c("_y0") + c("_y1")) / 2 - c("_cy")) <= 0.7 * F.greatest(c("_y1") - c("_y0"), c("y1") - c("y0")))
    heads = own.join(box(lines), keys).filter(level & ((c("_x0") - c("x1")).between(-1.0, gap * size) | inside)).select(*keys, "figure", F.lit("at the head of a line").alias("place"), F.lit(1).alias("_r"))
    return held.union(heads).groupBy(*keys, "figure").agg(F.min_by("place", "_r").alias("place"))


def touching(fills: DataFrame, keys: list[str], edge: float = 1.0) -> DataFrame:
    """keys, a, b: fills (fill and box) that share half of the shorter side's edge, side by side or stacked; a < b."""
    c = F.col
    side = lambda p: fills.select(*keys, c("fill").alias(p), *[c(x).alias(f"{p}_{x}") for x in ("x0", "y0", "x1", "y1")])
    met = side("a").join(side("b"), keys).filter(c("a") < c("b"))
    tall = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0") >= 0.5 * F.least(c("a_y1") - c("a_y0"), c("b_y1") - c("b_y0"))
    wide = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0") >= 0.5 * F.least(c("a_x1") - c("a_x0"), c("b_x1") - c("b_x0"))
    beside = (F.abs(c("a_x1") - c("b_x0")) <= edge) | (F.abs(c("b_x1") - c("a_x0")) <= edge)
    stacked = (F.abs(c("a_y1") - c("b_y0")) <= edge) | (F.abs(c("b_y1") - c("a_y0")) <= edge)
    return met.filter((beside & tall) | (stacked & wide)).select(*keys, "a", "b")


def fill_groups(fills: DataFrame, keys: list[str], edge: float = 1.0) -> DataFrame:
    """keys, fill, grp: the smallest fill that each reaches over touching ones. A page's links, which its drawing bounds, are walked in one array."""
    from .pagewise import pagewise

    links = touching(fills, keys, edge)
    rows = fills.select(*keys, F.col("fill").alias("a"), F.col("fill").alias("b")).union(links)

    def walk(rows: list[dict]) -> list[dict]:
        near: dict[int, list[int]] = {}
        for r in rows:
            near.setdefault(r["a"], []).append(r["b"])
            near.setdefault(r["b"], []).append(r["a"])
        out, seen = [], set()
        for start in sorted(near):
            if start in seen:
                continue
            waiting = [start]
            seen.add(start)
            while waiting:
                at = waiting.pop()
                out.append({"fill": at, "grp": start})
                fresh = [n for n in near[at] if n not in seen]
                seen.update(fresh)
                waiting += fresh
        return out

    return pagewise(rows, keys, walk, "fill long, grp long", keep=False)


def fragment_hosts(fragments: DataFrame, blocks: DataFrame, gutters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fragment, block: the block whose last line a loose end (fragment, size, family, baseline, x0, x1) carries on.

    blocks: block, n_lines, right (the block's edge), and of the last line text, size, family, baseline and end. It carries on what is on its baseline, in its face
    and size, does not end as a sentence does, and ends within one and a half sizes, or six where the fragment stays within the block's width; no gutter (g0, g1) lies between. The first block counts.
    """
    c = F.col
    last = blocks.select(*keys, "block", "n_lines", "right", c("text").alias("_t"), c("size").alias("_s"), c("family").alias("_f"), c("baseline").alias("_b"), c("end").alias("_e"))
    gap = c("x0") - c("_e")
    inside = (c("n_lines") >= 2) & (c("x1") <= c("right") + c("size"))
    met = fragments.join(last, keys).filter(
        (F.abs(c("_b") - c("baseline")) <= 0.3 * c("size")) & (gap.between(0.0, 1.5 * c("size")) | (inside & gap.between(0.0, 6.0 * c("size"))))
        & F.rtrim("_t").rlike(r"[\p{L}\p{N},;]$") & (F.abs(F.when(c("_s") > 0, c("_s")).otherwise(c("size")) - c("size")) <= 0.15 * c("size")) & (c("_f") == c("family"))
    )
    cut = met.join(gutters.select(*keys, "g0", "g1"), keys).filter((c("g0") < c("x0")) & (c("g1") > c("_e"))).select(*keys, "fragment", "block").distinct()
    return met.join(cut, [*keys, "fragment", "block"], "left_anti").groupBy(*keys, "fragment").agg(F.min("block").alias("block"))
