"""Streams of pages, and tables that are replaced as a whole."""

import json

import pytest
from pyspark.sql import functions as F

from panelspark.sources import files, paged
from panelspark.sources.versions import Conflict, VersionedTable

HOUR = 3_600


def candles(n, first=0):
    return [[(first + i) * HOUR, 1, 2, 3, 1, 1, 1] for i in range(n)]


def test_stream_goes_back_in_time_and_resumes(spark, tmp_path):
    for item, n in (("5", 100), ("6", 7)):
        (tmp_path / f"{item}.json").write_text(json.dumps(candles(n, 100 - n)))
    spark.dataSource.register(paged.PagedCandles)

    def run():
        stream = (
            spark.readStream.format("paged_candles").option("items", "5,6,none").option("folder", str(tmp_path)).option("limit", "8")
            .option("until", str(100 * HOUR)).option("span", str(30 * HOUR)).option("journal", f"file://{tmp_path}/journal").load()
        )
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.schema("item_id string, data array<array<string>>").parquet(str(tmp_path / "out"))
        times = rows.select("item_id", F.explode("data").alias("r")).select("item_id", F.col("r")[0].cast("long").alias("t"))
        return {k: sorted(r.t // HOUR for r in times.where(F.col("item_id") == k).collect()) for k in ("5", "6", "none")}

    for done in (30, 60, 90, 100, 100):  # each run is a new query on the same checkpoint
        got = run()
        assert got == {"5": list(range(100 - done, 100)), "6": list(range(93, 100)), "none": []}


def test_reader_never_goes_forward():
    reader = paged._StreamReader({"items": "a,b", "until": "1000", "span": "100", "floor": "750"})
    assert reader.initialOffset() == {"a": 1000, "b": 1000}
    steps = [reader.latestOffset()["a"] for _ in range(4)]
    assert steps == [900, 800, 750, 750]
    again = paged._StreamReader({"items": "a,b,c", "until": "1000", "span": "100"})
    made = again.partitions({"a": 800, "b": 800}, {"a": 700, "b": 800, "c": 900})
    assert [(s.item, s.low, s.high) for s in made] == [("a", 700, 800), ("c", 900, 1000)]
    assert again.latestOffset() == {"a": 600, "b": 700, "c": 800}


def test_faults_are_tried_again_with_doubled_waits():
    waits, left = [], [3]

    def fetch(item, until, limit):
        if left[0]:
            left[0] -= 1
            raise ConnectionError
        return {"success": True, "data": [r for r in candles(20) if r[0] <= until][-limit:]}

    got = list(paged.rows_between(paged.retried(fetch, 5, 0.5, waits.append), "x", 4 * HOUR, 15 * HOUR, 4))
    assert waits == [0.5, 1.0, 2.0] and sorted(r[0] // HOUR for page in got for r in page) == list(range(4, 15))
    left[0] = 9
    with pytest.raises(ConnectionError):
        paged.retried(fetch, 3, 1, waits.append)("x", 0, 1)
    codes = iter([107, 108, 106, None])
    seen = []
    limited = lambda item, until, limit: {"success": False, "errorCode": c} if (c := next(codes)) else {"success": True, "data": []}
    assert list(paged.rows_between(limited, "x", 0, 10, 5, seen.append)) == [] and seen == [60, 120, 0]
    with pytest.raises(paged.Unreachable):
        list(paged.rows_between(lambda *a: {"success": False, "errorCode": 500}, "x", 0, 10))


def test_http_transport(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = json.dumps({"success": True, "data": candles(2)}).encode()
            self.send_response(503 if len(asked) == 1 else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    fetch = paged.retried(paged.from_address(f"http://127.0.0.1:{server.server_port}/k?id={{item}}&n={{limit}}&max={{max_time}}"), first=0.01)
    assert fetch("a b", 99, 5)["data"] == candles(2)
    server.shutdown()
    assert asked == ["/k?id=a%20b&n=5&max=99"] * 2


def test_replaced_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    table = VersionedTable(spark, path)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert files.dataset_sink(spark.range(5).withColumn("k", F.col("id") % 2), path, ["k"]).number == 1
    assert table.read().count() == 5 and "k" in table.read().columns

    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken)
    assert table.latest().number == 1 and table.read().count() == 5  # it failed midway

    real, table._create = table._create, lambda version: (_ for _ in ()).throw(RuntimeError("gone"))
    with pytest.raises(RuntimeError, match="gone"):
        table.replace(spark.range(9))
    table._create = real
    assert table.latest().number == 1 and table.read().count() == 5  # it failed before its manifest

    (tmp_path / "table/_versions/000000000002.json").write_text('{"number": 2, "da')  # it failed in its manifest
    assert table.latest().number == 1
    assert table.replace(spark.range(9)).number == 3 and table.read().count() == 9 and table.read(1).count() == 5


def test_the_second_of_two_writers_reads_again(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/table")
    table.replace(spark.range(3))
    other = VersionedTable(spark, table.path)
    turns = []

    def change(df):
        if not turns:
            other.replace(spark.range(10, 12))  # comes in between
        turns.append(df.count())
        return df.select((F.col("id") + 100).alias("id"))

    assert table.update(change).number == 3 and turns == [3, 2]
    assert sorted(r.id for r in table.read().collect()) == [110, 111]
    with pytest.raises(Conflict):
        table.replace(spark.range(1), after=2)
    with pytest.raises(Conflict):  # both begin at 3: the manifest is there already
        table._create(table.latest())
    assert table.vacuum(1) == 2 and [v.number for v in table.versions()] == [3] and table.read().count() == 2


def test_report_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "best_params": {"max_depth": 4},\n "grid_results": [{"spearman": 0.1}, {"spearman": 0.3}]\n}')
    (tmp_path / "b.json").write_text('[{"grid_results": []}]')
    got = {r.report: r for r in files.json_reports(spark, str(tmp_path)).collect()}
    assert got["a.json"].best_params.max_depth == 4 and [x.spearman for x in got["a.json"].grid_results] == [0.1, 0.3] and got["b.json"].grid_results == []
