"""Running lines, page prints and the pairing of two issues, page by page."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.functions import text as T
from inkwright.functions.arrow import arrow

from .cuts import cut

PAIR = 0.5  # likeness from which two pages can be one
BUCKETS = 1 << 18  # of word pairs by hash, whose loads tell rare pairs from frequent ones: 2 MB to every task, whatever the input
GRAMS = 1 << 20  # ranked at a time in a worker
REACH = 2  # pages by which a page of the new issue may have moved


def beside(rows: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """keys and page of every row with `repeated`: whether a page at most `reach` away has the same keys.

    Every page announces its keys to its neighbours, and one aggregation on keys and page together
    meets both sides: a line that all pages print is spread over as many groups as pages, and
    no self-join is needed.
    """
    own = rows.select(*keys, "page").distinct()
    announced = own.select(*keys, F.explode(F.array(*[F.struct((F.col("page") + d).alias("page"), F.lit(d == 0).alias("own")) for d in range(-reach, reach + 1)])).alias("n"))
    met = announced.groupBy(*keys, F.col("n.page").alias("page")).agg(F.bool_or("n.own").alias("own"), F.bool_or(~F.col("n.own")).alias("repeated"))
    return met.filter("own").select(*keys, "page", "repeated")


def edge_lines(banded: DataFrame) -> DataFrame:
    """The head and foot lines with their folded text."""
    return banded.filter("band <> 'body'").withColumn("fold", T.fold(F.col("line")))


def running(banded: DataFrame, reach: int = 1) -> DataFrame:
    """Edge lines with `repeated`: a neighbouring page prints the same fold in the same band."""
    edges = edge_lines(banded)
    known = beside(edges, ["file", "band", "fold"], reach)
    return edges.join(known, ["file", "band", "fold", "page"])


def decided(banded: DataFrame) -> DataFrame:
    """Edge lines with the decision on them and why: running, imprint, or unchecked in a file of one page."""
    edges = running(banded, REACH)
    size = banded.groupBy("file").agg(F.max("page").alias("pages"))
    kept = F.when(F.col("pages") == 1, F.lit(None)).when(F.col("repeated"), "running").otherwise("imprint")
    why = F.when(F.col("pages") == 1, "no page beside it to ask").when(F.col("repeated"), "a page beside it prints the same line").otherwise("no page beside it prints the line")
    return edges.join(size, "file").withColumn("kept_in", kept).withColumn("because", why).withColumn("checked", F.col("pages") > 1)


def prints(banded: DataFrame) -> DataFrame:
    """file, page, body, running: the words of a page without its running lines, and the folds of those."""
    known = running(banded).filter("repeated").select("file", "page", "doc_id", "line_no", "fold")
    # lines and folds meet, and lines are gathered, where their page is, so a text is moved once
    keys, none = ["file", "page", "doc_id", "line_no"], F.lit(None).cast("string")
    both = banded.select(*keys, "line", none.alias("fold")).union(known.select(*keys, none, "fold")).repartition("file", "page")
    marked = both.groupBy(*keys).agg(F.first("line", ignorenulls=True).alias("line"), F.first("fold", ignorenulls=True).alias("fold"))
    by_line = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["text"])
    return marked.groupBy("file", "page").agg(
        F.array_join(by_line(F.when(F.col("fold").isNull(), F.struct("line_no", F.col("line").alias("text")))), " ").alias("body"),
        by_line(F.when(F.col("fold").isNotNull(), F.struct("line_no", F.col("fold").alias("text")))).alias("running"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def classes(paged: DataFrame) -> DataFrame:
    """paged with g and cls, see named, written once, as all that compares issues reads it."""
    return cut(named(paged))


def named(paged: DataFrame) -> DataFrame:
    """paged (file, page, text) with g, its set of word pairs as 64-bit hashes, and cls, 128 bits that name the set: pages of equal sets are one class."""
    out = paged.withColumn("_w", T.words(F.coalesce("text", F.lit("")))).withColumn("_g", T.bigrams(F.col("_w")))  # words as a column, or each place that names them reads the text anew
    joined = F.array_join("_g", "\n")
    hashed = F.transform("_g", lambda pair: F.xxhash64(pair))
    return out.select(*paged.columns, hashed.alias("g"), F.struct(F.xxhash64(joined).alias("a"), F.xxhash64(F.lit(1), joined).alias("b")).alias("cls"))


def _stretches(column: pa.ListArray):
    """(first row, lengths, values) of runs of rows that hold at most GRAMS values, or one row that holds more."""
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GRAMS, "right")))
        yield start, sizes[start:stop], column.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False)
        start = stop


def _loads(both: DataFrame) -> np.ndarray:
    """How many word pairs of all classes fall into each bucket."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, grams in _stretches(batch.column(0)):
                total += np.bincount(grams & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = both.select("g").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counted.bucket] = counted.n
    return out


def _prefixes(side: DataFrame, loads, least: float) -> DataFrame:
    """key, id, n: the n - ceil(least * n) + 1 rarest word pairs of each class of n, as a hash of file and pair; a class without pairs has one key."""

    def run(batches):
        table = loads.value
        for batch in batches:
            files, ids = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            for start, sizes, grams in _stretches(batch.column(2)):
                full, first = np.maximum(sizes, 1), np.zeros(len(sizes), np.int64)
                first[1:] = np.cumsum(full)[:-1]
                own = np.zeros(full.sum(), np.int64)
                own[np.repeat(sizes > 0, full)] = grams
                row = np.repeat(np.arange(len(sizes)), full)
                own = own[np.lexsort((own, table[own & (BUCKETS - 1)], row))]
                at = np.arange(len(own)) - first[row]
                kept = at < (sizes - np.ceil(sizes * least).astype(np.int64) + 1)[row]
                row = row[kept]
                key = (own[kept].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + files[start + row].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[start + row]), pa.array(sizes[row].astype(np.int32))], ["key", "id", "n"])

    return side.select(F.xxhash64("file"), "id", "g").mapInArrow(run, "key long, id long, n int")


def likeness(old: DataFrame, new: DataFrame, least: float = PAIR) -> DataFrame:
    """file, old_cls, new_cls, old_page, new_page, likeness: the classes of two issues (see classes) that are alike to `least`, each with its first page.

    Two sets that alike share one of the n - ceil(least * n) + 1 first pairs of each, in any order that both
    keep, so only those are joined, on a hash of file and pair, rare ones first as far as the loads of hashed buckets tell.
    What two sets share behind their prefixes is no more than what stands behind one of the two, so a meeting must share enough
    within them; sizes too far apart rule it out as well. Only what is left, and is not equal, is verified by its whole sets. Copies are one class and never multiply; a page without words is alike to another such page.
    """
    side = lambda df, new_side: df.groupBy("file", "cls").agg(F.first("g").alias("g"), F.min("page").alias("page")).withColumn("new", F.lit(new_side))
    both = cut(side(old, False).union(side(new, True)).withColumn("id", F.monotonically_increasing_id()))
    loads = both.sparkSession.sparkContext.broadcast(_loads(both))
    a, b = (_prefixes(both.filter(F.col("new") == flag), loads, least).toDF("key", f"{p}_id", f"{p}_n") for flag, p in ((False, "old"), (True, "new")))
    c, ids = F.col, ["old_id", "new_id"]
    near = F.least("old_n", "new_n") + 1e-6 >= least * F.greatest("old_n", "new_n")
    shared = a.join(b, "key").filter(near).groupBy(*ids, "old_n", "new_n").agg(F.count("*").alias("n"))
    behind = F.ceil(F.greatest("old_n", "new_n") * least - 1e-6) - 1  # pairs behind a prefix, of the longer set at most
    met = shared.filter(c("n") + behind + 1e-6 >= least / (1 + least) * (c("old_n") + c("new_n"))).select(*ids)
    own = lambda flag, p: both.filter(F.col("new") == flag).select("file", "cls", F.col("id").alias(f"{p}_id"), F.col("page").alias(f"{p}_page"))
    grams = lambda flag, p: both.filter(F.col("new") == flag).select(F.col("id").alias(f"{p}_id"), F.col("file").alias(f"{p}_file"), F.col("cls").alias(f"{p}_cls"), F.col("g").alias(f"{p}_g"), F.col("page").alias(f"{p}_page"))
    same = own(False, "old").join(own(True, "new"), ["file", "cls"])
    full = met.join(same.select(*ids), ids, "left_anti").join(grams(False, "old"), "old_id").join(grams(True, "new"), "new_id").filter("old_file = new_file")
    out = full.withColumn("likeness", jaccard(F.col("old_g"), F.col("new_g"))).filter(F.col("likeness") >= least)
    equal = same.select("file", F.col("cls").alias("old_cls"), F.col("cls").alias("new_cls"), "old_page", "new_page", F.lit(1.0).alias("likeness"))
    return equal.union(out.select(F.col("old_file").alias("file"), "old_cls", "new_cls", "old_page", "new_page", "likeness"))


def align(a: list, b: list, like: dict) -> list[tuple[int, int, float]]:
    """(place in a, place in b, likeness): the pairing of two sequences of classes that keeps their order and has the greatest total likeness.

    Equal heads and tails pair at once, as nothing is worth more. Between them each place meets only the
    places of classes that it is alike to, over a Fenwick tree of the best sums: the pairs times their logarithm.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    places: dict = {}
    for j in range(low, len(b) - high):
        places.setdefault(b[j], []).append(j)
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(b) + 2)
    found: list[tuple[int, int, float, int]] = []
    for i in range(low, len(a) - high):
        row = sorted(((j, s) for c, s in like.get(a[i], {}).items() for j in places.get(c, ())), reverse=True)
        for j, s in row:  # from the last on, so that a row never builds on itself
            k, best = j, (0.0, -1)
            while k:
                best = max(best, tree[k], key=lambda t: t[0])
                k -= k & -k
            found.append((i, j, s, best[1]))
            now, k = (best[0] + s, len(found) - 1), j + 1
            while k < len(tree):
                if now[0] > tree[k][0]:
                    tree[k] = now
                k += k & -k
    k, best = len(b) + 1, (0.0, -1)
    while k:
        best = max(best, tree[k], key=lambda t: t[0])
        k -= k & -k
    middle, at = [], best[1]
    while at >= 0:
        i, j, s, at = found[at]
        middle.append((i, j, s))
    return [(i, i, 1.0) for i in range(low)] + middle[::-1] + [(len(a) - high + k, len(b) - high + k, 1.0) for k in range(high)]


MATCHES = "file string, old_page long, new_page long, likeness double"


def matched(old: DataFrame, new: DataFrame, least: float = PAIR) -> DataFrame:
    """file, old_page, new_page, likeness: every page of both issues once, paired in order; null where it is dropped or new.

    A file's alignment is one sequence and so one group, of two numbers a page and a row for each pair of
    like classes; its texts stay out of it.
    """
    alike = likeness(old, new, least)
    key = lambda c: F.concat_ws(":", F.col(f"{c}.a"), F.col(f"{c}.b"))
    pages = old.select("file", "page", F.lit(False).alias("new"), key("cls").alias("c")).union(new.select("file", "page", F.lit(True).alias("new"), key("cls").alias("c")))
    likes = alike.select("file", key("old_cls").alias("o"), key("new_cls").alias("n"), "likeness")

    def walk(key, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("page")
        a, b = own[~own.new], own[own.new]
        like: dict = {}
        for r in near.itertuples(index=False):
            like.setdefault(r.o, {})[r.n] = r.likeness
        pa, pb = a.page.tolist(), b.page.tolist()
        pairs = align(a.c.tolist(), b.c.tolist(), like)
        mine, its = {i for i, _, _ in pairs}, {j for _, j, _ in pairs}
        rows = [(key[0], pa[i], pb[j], s) for i, j, s in pairs] + [(key[0], pa[i], None, None) for i in range(len(pa)) if i not in mine] + [(key[0], None, pb[j], None) for j in range(len(pb)) if j not in its]
        out = pd.DataFrame(rows, columns=["file", "old_page", "new_page", "likeness"])
        return out.astype({"old_page": "Int64", "new_page": "Int64"})

    new_ids = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from the same tables
    return new_ids(pages).groupBy("file").cogroup(new_ids(likes).groupBy("file")).applyInPandas(walk, MATCHES)


def classed(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """matches with kind: same, restamped (only numbers and months differ in what runs), changed, new or dropped. old, new: file, page, body, running."""
    o = old.select("file", F.col("page").alias("old_page"), F.col("body").alias("_ob"), F.col("running").alias("_or"))
    n = new.select("file", F.col("page").alias("new_page"), F.col("body").alias("_nb"), F.col("running").alias("_nr"))
    out = matches.join(o, ["file", "old_page"], "left").join(n, ["file", "new_page"], "left")
    kind = (
        F.when(F.col("old_page").isNull(), "new").when(F.col("new_page").isNull(), "dropped")
        .when((F.col("_ob") == F.col("_nb")) & (F.col("_or") == F.col("_nr")), "same")
        .when((F.col("_ob") == F.col("_nb")) & (F.transform("_or", T.fold) == F.transform("_nr", T.fold)), "restamped").otherwise("changed")
    )
    return out.select("file", "old_page", "new_page", "likeness", kind.alias("kind"))


@arrow("struct<figures:array<string>,wording:array<string>>")
def changes(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """The stretches of words that differ between two texts, as old -> new; figures where either has a digit, wording else."""
    import difflib

    rows = []
    for a, b in zip(old, new):
        a, b = (a or "").split(), (b or "").split()
        sides: dict[bool, list[str]] = {True: [], False: []}
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag != "equal":
                x, y = " ".join(a[i:j]), " ".join(b[k:m])
                sides[any(ch.isdigit() for ch in x + y)].append(f"{x} -> {y}")
        rows.append((sides[True], sides[False]))
    return pd.DataFrame(rows, columns=["figures", "wording"])
