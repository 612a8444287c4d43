"""Typed checks of a page's output: present, absent, order, format, table, baseline, footnote, list item and equation.

Checks meet outputs on (pdf, page). A check without allowed edits is answered by JVM expressions where
they can say it; the rest goes through one Arrow function, which reads a check and its page in one row.
"""

from __future__ import annotations

import re
from collections import defaultdict, namedtuple
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.functions import fuzzy
from inkwright.functions import text as T

from .tables import parse_tables

SCHEMA = (
    "pdf string, page int, id string, type string, max_diffs int, checked string, url string, text string, case_sensitive boolean, first_n int, last_n int, "
    "before string, after string, format string, cell string, up string, down string, left string, right string, top_heading string, left_heading string, "
    "ignore_markdown_tables boolean, max_length int, max_length_skips_image_alt_tags boolean, max_repeats int, check_disallowed_characters boolean, math string, "
    "ignore_dollar_delimited boolean, marker string, appears_before_marker string, appears_after_marker string, item string"
)
TYPES = ("present", "absent", "order", "format", "table", "baseline", "footnote", "list_item", "math")
DISALLOWED = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]"
HEADINGS = (r"(?m)^#{1,6}[ \t]+([^\n]+?)[ \t]*$", r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>")
BOLD = (r"(?s)\*\*(.*?)\*\*", r"(?s)__(.*?)__", r"(?is)<b(?:\s[^>]*)?>(.*?)</b>", r"(?is)<strong[^>]*>(.*?)</strong>")
ITALIC = (r"(?s)(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)", r"(?s)(?<!_)_(?!_)(.*?)(?<!_)_(?!_)", r"(?is)<i(?:\s[^>]*)?>(.*?)</i>", r"(?is)<em[^>]*>(.*?)</em>")
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def duplicate_ids(checks: DataFrame) -> DataFrame:
    """id, n of every id that more than one check has."""
    return checks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def malformed(checks: DataFrame) -> DataFrame:
    """id, why of the checks that cannot be run."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    long = lambda c: F.col("max_diffs") > F.floor(F.length(c) / 2)
    why = (
        F.when(blank("pdf"), "no file").when(blank("id"), "no id").when(F.coalesce(F.col("max_diffs"), F.lit(0)) < 0, "negative edits")
        .when(~F.col("type").isin(*TYPES), "unknown type")
        .when(F.col("type").isin("present", "absent", "format") & blank("text"), "no text")
        .when((F.col("type") == "format") & ~F.coalesce(F.col("format"), F.lit("")).isin("heading", "bold", "italic"), "unknown format")
        .when((F.col("type") == "order") & (blank("before") | blank("after")), "no text")
        .when((F.col("type") == "order") & (long("before") | long("after")), "too many edits")
        .when((F.col("type") == "table") & blank("cell"), "no cell").when((F.col("type") == "footnote") & (blank("marker") | F.contains(F.col("marker"), F.lit(" "))), "bad marker")
    )
    return checks.withColumn("why", why).filter("why IS NOT NULL").select("id", "why")


def window(text: Column, first_n: Column, last_n: Column) -> Column:
    """The first and last characters of a text that a check looks at; all of it without either."""
    head, tail = F.substring(text, F.lit(1), first_n), F.when(F.length(text) > last_n, F.substring(text, F.length(text) - last_n + 1, last_n)).otherwise(text)
    return F.when((first_n > 0) & (last_n > 0), F.concat(head, tail)).when(first_n > 0, head).when(last_n > 0, tail).otherwise(text)


def holds(text: Column, query: Column) -> Column:
    """Whether the shorter of the two stands in the longer: what a partial ratio of 1 means."""
    return F.when(F.length(query) <= F.length(text), F.contains(text, query)).otherwise((text != "") & F.contains(query, text))


def in_order(text: Column, before: Column, after: Column) -> Column:
    """Whether some `before` starts in front of some `after`: the first of the one in front of the last of the other."""
    first = F.position(before, text)
    last = F.length(text) - F.position(F.reverse(after), F.reverse(text)) - F.length(after) + 2
    return F.contains(text, before) & F.contains(text, after) & (first < last)


def formatted(text: Column, form: str) -> Column:
    """The texts that stand as headings, in bold or in italics."""
    patterns = {"heading": HEADINGS, "bold": BOLD, "italic": ITALIC}[form]
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])


def baseline(text: Column, max_length: Column, skip_alt: Column, check_chars: Column) -> Column:
    """Not blank and of no disallowed characters; with a length, no longer than it and nothing else."""
    counted = F.when(skip_alt, F.regexp_replace(text, r"!\[.*?\]\(.*?\)", "")).otherwise(text)
    n = T.count_of(counted, r"\p{L}\p{N}")
    return F.when(max_length.isNotNull(), n <= max_length).otherwise((T.count_of(text, r"\p{L}\p{N}") > 0) & ~(check_chars & text.rlike(DISALLOWED)))


def ending_repeats(text: str, most: int = 5) -> list[int]:
    """How often the last n letters repeat at a text's end, for n = 1 to `most`."""
    out = []
    for n in range(1, most + 1):
        unit, count = text[-n:], 0
        while unit and text.endswith(unit * (count + 1)):
            count += 1
        out.append(count)
    return out


def exact(rows: DataFrame) -> DataFrame:
    """rows of checks joined to outputs (md) with `passed` for the types that JVM expressions answer exactly, null for the rest."""
    c = F.col
    plainly = lambda x, *types: F.when(c("type").isin(*types), T.normalize(F.coalesce(c(x), F.lit(""))))
    made = rows.withColumns({  # as columns, or each place that names them makes them anew
        "_norm": plainly("md", "present", "absent", "order"), "_text": plainly("text", "present", "absent", "format"), "_before": plainly("before", "order"), "_after": plainly("after", "order"),
    })
    norm, given = c("_norm"), lambda x: c(f"_{x}")
    lower = lambda x, on: F.when(on, x).otherwise(F.lower(x))
    cased = F.coalesce(c("case_sensitive"), F.lit(True))
    seen = holds(window(lower(norm, cased), F.coalesce(c("first_n"), F.lit(0)), F.coalesce(c("last_n"), F.lit(0))), lower(given("text"), cased))

    def formed(form):
        return F.exists(formatted(F.coalesce(c("md"), F.lit("")), form), lambda x: holds(lower(T.normalize(x), cased), lower(given("text"), cased)))

    none = F.coalesce(c("max_diffs"), F.lit(0)) == 0
    passed = (
        F.when((c("type") == "present") & (none | seen), seen)
        .when((c("type") == "absent") & (none | seen), ~seen)
        .when((c("type") == "order") & none, in_order(norm, given("before"), given("after")))
        .when((c("type") == "format") & none & (c("format") == "heading"), formed("heading"))
        .when((c("type") == "format") & none & (c("format") == "bold"), formed("bold"))
        .when((c("type") == "format") & none & (c("format") == "italic"), formed("italic"))
        .when((c("type") == "baseline") & ~baseline(F.coalesce(c("md"), F.lit("")), c("max_length"), F.coalesce(c("max_length_skips_image_alt_tags"), F.lit(False)), F.coalesce(c("check_disallowed_characters"), F.lit(True))), False)
        .when((c("type") == "baseline") & c("max_length").isNotNull(), True)
        .when((c("type") == "math") & F.contains(F.regexp_replace(c("md"), r"\s+", ""), F.regexp_replace(c("math"), r"\s+", "")), True)
    )
    return made.withColumn("passed", passed).drop("_norm", "_text", "_before", "_after")


_FANCY = str.maketrans(T.FANCY, T.PLAIN)
_UNPLAIN = re.compile(r"[<*_\t-\r\x1c-\x1f]|  ")  # what of ASCII is not plain


def plain(text: str | None) -> str:
    """The Python twin of normalize, with composed characters."""
    import unicodedata

    out = text or ""
    if out.isascii() and not _UNPLAIN.search(out):
        return out
    tagged, marked = "<" in out, "*" in out or "_" in out
    if tagged:
        out = re.sub(r"<br/?>", " ", out)
    for pattern in (r"\*\*([^\n]*?)\*\*", r"__([^\n]*?)__") if marked else ():
        out = re.sub(pattern, r"\1", out)
    if tagged or "<" in out:
        out = re.sub(r"</?[bi]>", "", out)
    for pattern in (r"\*([^\n]*?)\*", r"_([^\n]*?)_") if marked else ():
        out = re.sub(pattern, r"\1", out)
    return unicodedata.normalize("NFC", re.sub(r"\s+", " ", out)).translate(_FANCY)


def _least(diffs: int, query: str) -> float:
    return 1 - diffs / max(1, len(query))


def near(a: str, b: str, least: float) -> bool:
    """Whether the ratio of two texts reaches `least`; what equality or their lengths decide is not compared."""
    if a == b or least >= 1:
        return a == b
    return 2 * min(len(a), len(b)) >= least * (len(a) + len(b)) - 1e-9 and fuzzy.ratio(a, b) >= least


@lru_cache(maxsize=8)
def _grids(md: str, pipes: bool) -> list[tuple]:
    """The tables of a page with their plain cells, kept while the checks of the page go by."""
    return [(table, {at: plain(text) for at, text in table.cells.items()}) for table in parse_tables(md, pipes)]


def run_table(c, md: str) -> bool:
    """Whether some table has the cell with all the neighbours asked for."""
    cell, diffs = plain(c.cell), int(c.max_diffs or 0)
    asks = {k: plain(getattr(c, k)) for k in ("up", "down", "left", "right", "top_heading", "left_heading") if getattr(c, k)}
    for table, grid in _grids(md, not c.ignore_markdown_tables):
        for (r, k), text in grid.items():
            if not near(cell, text, max(0.5, _least(diffs, cell))):
                continue
            beside = {
                "up": [(r - 1, k)], "down": [(r + 1, k)], "left": [(r, k - 1)], "right": [(r, k + 1)],
                "top_heading": [(i, k) for i in range(r) if (i, k) in table.headers] or [(0, k)] * (r > 0),
                "left_heading": [(r, i) for i in range(k) if (r, i) in table.headers] or [(r, 0)] * (k > 0),
            }
            if all(any(at in grid and near(want, grid[at], max(0.5, _least(diffs, want))) for at in beside[side]) for side, want in asks.items()):
                return True
    return False


@lru_cache(maxsize=8)
def _entries(md: str) -> dict[str, list[tuple]]:
    """The places (table, row, column) of each plain entry of a list in a table's cell, kept while the checks of the page go by."""
    places = defaultdict(list)
    for table in parse_tables(md, False):
        for (r, k), entries in table.items.items():
            for entry in dict.fromkeys(entries):
                places[plain(entry).strip()].append((table, r, k))
    return dict(places)


def _has_entry(md: str, item: str | None, top_heading: str | None) -> bool:
    want, heading = plain(item).strip(), plain(top_heading).strip()
    return any(not heading or any((i, k) in t.headers and plain(t.cells[i, k]).strip() == heading for i in range(r)) for t, r, k in _entries(md).get(want, ()))


_has_entry_kept = lru_cache(maxsize=32_768)(_has_entry)  # of short texts: some 16 million characters at most


def run_list_item(c, md: str) -> bool:
    """Whether a list in a table's cell has the entry, under the heading if one is named. What was asked of a short page is not worked out again where page and check are equal."""
    asked = md, c.item, c.top_heading
    return (_has_entry_kept if sum(len(t or "") for t in asked) <= 500 else _has_entry)(*asked)


def run_footnote(c, md: str) -> bool:
    """Whether the marker stands as a note's sign, with the texts asked for within 200 characters of it."""
    mark = re.escape(c.marker)
    spots = [m.span() for m in re.finditer(rf"\[\^{mark}\](?!:)", md)] + [m.span() for m in re.finditer(rf"<sup[^>]*>{mark}</sup>", md, re.I)]
    if re.fullmatch("[0-9]+", c.marker):
        spots += [m.span() for m in re.finditer("".join(SUPERSCRIPTS[int(d)] for d in c.marker), md)]
    letters = lambda t: "".join(ch for ch in plain(t) if ch.isalnum()).lower()

    def beside(want: str | None, after: bool) -> bool:
        if not want:
            return True
        key = letters(want)
        for a, b in spots:
            near = letters(md[b : b + 200] if after else md[max(0, a - 200) : a])
            size = min(len(near), 2 * len(key))
            part = near[:size] if after else near[len(near) - size :]
            if part and fuzzy.partial_ratio(key, part) >= _least(int(c.max_diffs or 0), plain(want)):
                return True
        return False

    return bool(spots) and beside(c.appears_before_marker, False) and beside(c.appears_after_marker, True)


def run_one(c, md: str) -> bool:
    """Any check by its whole definition, allowed edits included."""
    diffs, kind = int(c.max_diffs or 0), c.type
    if kind in ("present", "absent", "format"):
        query = plain(c.text)
        cased = c.case_sensitive is None or bool(c.case_sensitive)
        if kind == "format":
            texts = [plain(t) for p in {"heading": HEADINGS, "bold": BOLD, "italic": ITALIC}[c.format] for t in re.findall(p, md)]
        else:
            text, n, m = plain(md), int(c.first_n or 0), int(c.last_n or 0)
            texts = [text[:n] * bool(n) + text[-m:] * bool(m) if n or m else text]
        query = query if cased else query.lower()
        seen = any(fuzzy.partial_ratio(query, t if cased else t.lower()) >= _least(diffs, query) for t in texts)
        return seen != (kind == "absent")
    if kind == "order":
        text, before, after = plain(md), plain(c.before), plain(c.after)
        first = min((j - len(before) for j in fuzzy.near(before, text, diffs)), default=None)
        last = max((j - len(after) for j in fuzzy.near(after, text, diffs)), default=None)
        return first is not None and last is not None and first < last
    if kind == "baseline":
        return max(ending_repeats(md)) <= int(c.max_repeats or 30)
    if kind == "math":
        return re.sub(r"\s+", "", c.math) in re.sub(r"\s+", "", md)
    return {"table": run_table, "list_item": run_list_item, "footnote": run_footnote}[kind](c, md)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows by name. Columns of nulls alone are not turned into values, and a page that many checks share is one string."""

    def values(column: pa.Array):
        if column.null_count == len(column):
            return repeat(None, len(column))
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            coded = column.dictionary_encode(null_encoding="encode")
            return coded.dictionary.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()].tolist()
        return column.to_pylist()

    return map(namedtuple("Check", batch.schema.names, rename=True)._make, zip(*map(values, batch.columns)))


def run(checks: DataFrame, outputs: DataFrame) -> DataFrame:
    """id, pdf, page, type, repeat, passed: every check on every repeat of its page's output (pdf, page, repeat, md).

    A check of a page without output fails. What the exact expressions leave open goes through one Arrow
    map, which reads a check and its page in the same row; of what is answered the page stays behind. Malformed checks fail too.
    """
    bad = malformed(checks).select("id", F.lit(True).alias("_bad")).distinct()
    # outputs come last and by a merge: they are moved once, the checks of a page follow each other, and tables that fit a broadcast are still dealt over many tasks
    joined = checks.join(bad, "id", "left").join(outputs.select("pdf", "page", "repeat", "md").hint("merge"), ["pdf", "page"], "left")
    first = exact(joined).withColumn("passed", F.when(F.col("md").isNull() | F.col("_bad"), False).otherwise(F.col("passed"))).drop("_bad")
    first = first.withColumn("md", F.when(F.col("passed").isNull(), F.col("md")))

    kept = ("id", "pdf", "page", "type", "repeat")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = batch.column("passed")
            answers = [run_one(c, c.md) for c in _rows(batch.filter(pc.is_null(passed)))]
            done = pc.replace_with_mask(passed, pc.is_null(passed), pa.array(answers, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), done], [*kept, "passed"])

    columns = {f.name: f.dataType.simpleString() for f in first.schema}
    return first.mapInArrow(rest, ", ".join(f"{c} {columns[c]}" for c in kept) + ", passed boolean")


def majority(results: DataFrame) -> DataFrame:
    """id, pdf, type, passed: a check passes if more than half of its repeats do."""
    return results.groupBy("id", "pdf", "type").agg((F.avg(F.col("passed").cast("int")) > 0.5).alias("passed"))


def with_baselines(checks: DataFrame, files: DataFrame) -> DataFrame:
    """The checks and, for each file (pdf) that has none, a baseline check of its first page."""
    have = checks.filter("type = 'baseline'").select("pdf").distinct()
    new = files.select("pdf").distinct().join(have, "pdf", "left_anti").select("pdf", F.lit(1).alias("page"), F.concat("pdf", F.lit("_baseline")).alias("id"), F.lit("baseline").alias("type"))
    return checks.unionByName(new, allowMissingColumns=True)
