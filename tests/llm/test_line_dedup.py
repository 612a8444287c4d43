import compare

from inkwright.llm import line_dedup
from inkwright.llm.registry import ORACLES


def brute(rows):
    """(doc_id, text) to (kept text, removed), with ids that are whole numbers and no equal rows."""
    first, gone = {}, {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not "".join(w).strip(" "):
                continue
            at = first.setdefault(w, (doc_id, i))
            if at != (doc_id, i):
                low = max(i, at[1] + 3) if at[0] == doc_id else i
                gone.setdefault(doc_id, set()).update(range(low, i + 3))
    return {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())), len(gone.get(d, ()))) for d, t in rows}


def test_brute_force(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "b\nc\nd"), (4, "q\nq\nq\nq\nq\nq\nq"), (5, "a\nb\nc\nb\nc\nd\na\nb\nc"), (6, " \n\n \n \n"), (7, "one\ntwo"), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(df).collect()} == brute(rows)


def test_twin(spark, sf_dir, docs):
    assert compare.differences(line_dedup.dedup_lines(docs), ORACLES["op10_line_dedup"], compare.connection(sf_dir)) == []


def test_odd_rows_and_native_plan(odd, none):
    out = line_dedup.dedup_lines(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns == [*odd.columns, "removed_lines"]
    by = {r.doc_id: r for r in rows}
    assert by[2].text is None and by[3].text == "" and by[1].removed_lines == 0
    assert all(r.removed_lines == 3 and r.text == "" for r in rows if r.doc_id == 4)
    assert by[7].removed_lines == 0 or by[7].text.count("\n") < 4
    assert line_dedup.dedup_lines(none).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_long_text_and_a_column_of_the_same_name(spark):
    lines = [f"line {i}" for i in range(3_000)]
    text = "\n".join(lines + ["between"] + lines)
    rows = [(1, text, "mine", "other"), (2, None, "x", None), (3, "\n".join(lines[5:9]) + "\nnew", None, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, removed_lines string, Removed_Lines_2 string"))
    assert out.columns == ["doc_id", "text", "removed_lines", "Removed_Lines_2", "removed_lines_3"]
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text == "\n".join(lines + ["between"]) and by[1].removed_lines_3 == 3_000 and by[1].removed_lines == "mine"
    assert by[2].text is None and (by[3].text, by[3].removed_lines_3) == ("new", 4)
