import datetime
import json

import pytest
from pyspark.sql import functions as F

from inkwright.sources import providers, readings
from inkwright.streaming import completion, neighbours


def test_saved_outputs(spark, tmp_path):
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "doc_pg3_repeat2.md").write_text("text of three")
    (tmp_path / "plain.md").write_text("---\ncut_off: true\nlang: en\n---\nbody here")
    rows = {r.pdf: r for r in readings.outputs(spark, str(tmp_path)).collect()}
    assert (rows["doc.pdf"].page, rows["doc.pdf"].repeat, rows["doc.pdf"].category) == (3, 2, "tables") and rows["plain.pdf"].page == 1
    saved = {r.stem: r for r in readings.saved(spark, str(tmp_path)).collect()}
    assert saved["plain"].text == "body here" and saved["plain"].cut_off and not saved["doc"].cut_off
    pages = spark.createDataFrame([("doc", 3), ("none", 1)], "stem string, page int")
    assert {r.stem: r.text for r in readings.page_readings(pages, readings.saved(spark, str(tmp_path))).collect()} == {"doc": "text of three", "none": None}


def test_checks_come_back(spark, tmp_path):
    rows = [{"pdf": "a.pdf", "page": 1, "id": "x", "type": "present", "text": "é"}, {"pdf": "a.pdf", "page": 2, "id": "y", "type": "order", "before": "b", "after": "c", "max_diffs": 1}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    df = readings.check_rows(spark, str(tmp_path / "c.jsonl"))
    readings.save_checks(df, str(tmp_path / "out"))
    back = readings.check_rows(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, back.collect()), key=repr) and df.count() == 2
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows + rows[:1])))
    with pytest.raises(ValueError, match="twice"):
        readings.check_rows(spark, str(tmp_path / "c.jsonl"))


def test_placed_and_sample(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps({"text": "page text ", "metadata": {"Source-File": "/x/y/doc.one.pdf"}}) + "\n" + json.dumps({"text": " ", "metadata": {"Source-File": "z.pdf"}}))
    assert sorted(map(tuple, readings.placed(spark, str(tmp_path / "r.jsonl")).collect())) == [("doc.one", "page text\n"), ("z", "")]
    files = spark.createDataFrame([(f"f{i}", i + 1) for i in range(30)], "path string, pages int")
    sealed = files.filter("pages > 20").select("path")
    a, b = (sorted(map(tuple, readings.library_sample(files, 5, 7, sealed).collect())) for _ in range(2))
    assert a == b and len(a) == 5 and all(1 <= page <= int(path[1:]) + 1 <= 20 for path, page in a)


def test_regions(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    regions = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 2, 50.0, 50.0, 60.0, 60.0)], f"stem string, region long, {box}")
    crops = spark.createDataFrame([("d", "a", "near", 0.0, 0.0, 10.0, 9.0), ("d", "b", "half", 0.0, 0.0, 10.0, 6.0)], f"stem string, crop string, text string, {box}")
    assert {r.region: r.text for r in readings.region_readings(regions, crops).collect()} == {1: "near", 2: None}


def test_providers(spark):
    pages = spark.createDataFrame([("f", p, bytearray(b"x")) for p in (1, 2)], "file string, page long, content binary")

    def make():  # made in the worker, so that it ships without this module
        class Echo:
            name = "echo"

            def read_page(self, content, page):
                if page == 2:
                    raise TimeoutError("slow")
                return f"{content.decode()} {page}"

            def read_region(self, content, page, box, kind):
                return kind

            def detect(self, image, scale):
                return [("text", 0.0, 0.0, 1.0, 1.0, 0.9)]

        return Echo()

    out = {r.page: (r.text, r.error) for r in providers.read_pages(pages, make).collect()}
    assert out == {1: ("x 1", None), 2: (None, "TimeoutError: slow")}
    regions = pages.filter("page = 1").selectExpr("file", "page", "content", "explode(sequence(1L, 15L)) AS region", "'icon' AS kind", "0.5D AS score", "0D AS x0", "0D AS y0", "1D AS x1", "1D AS y1")
    assert [r.text for r in providers.read_regions(regions, make).collect()] == ["icon"] * 12
    assert providers.detect_layout(pages.select("file", "page", F.col("content").alias("image")), make).count() == 2
    kinds = {"http://h/v1": "http", "file:/a+/b": "saved", "name/bands=2": "named"}
    assert {a: providers.parse_address(a, "m")["kind"] for a in kinds} == kinds and providers.parse_address("name/bands=2", "m")["bands"] == 2
    for bad in ("", "x/bands=", "x/bands=0"):
        with pytest.raises(ValueError):
            providers.parse_address(bad, "m")


def test_missing_reader_is_said(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 not really")
    r = providers.pdf_chars(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].error and (providers.pdf_available() or "stage-unavailable" in r[0].error)
    assert providers.pdf_files(spark, str(tmp_path)).first().length == 19


def test_streams(spark, tmp_path):
    schema = "file string, band string, fold string, page long, ts timestamp"
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    for h, part in ((1, [("f", "head", "title", p) for p in (1, 2, 9)]), (8, [("g", "head", "other", 1)])):
        spark.createDataFrame([(*r, at(h)) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "edges"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "edges"))
    query = neighbours.running_stream(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(r.file, r.page, r.repeated) for r in spark.table("told").collect()} == {("f", 1, True), ("f", 2, True), ("f", 9, False)}
    issues = spark.createDataFrame([("a", "2024-01-01 00:10:00", "note"), ("a", "2024-01-01 00:20:00", "incomplete"), ("a", "2024-01-01 09:00:00", "note")], "file string, ts string, severity string").withColumn("ts", F.col("ts").cast("timestamp"))
    issues.write.parquet(str(tmp_path / "issues"))
    stream = spark.readStream.schema(issues.schema).parquet(str(tmp_path / "issues"))
    query = completion.completion_stream(stream, "1 hour", "2 hours", "file").writeStream.format("memory").outputMode("complete").queryName("ended").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.completion for r in spark.table("ended").collect()) == ["complete", "incomplete"]
