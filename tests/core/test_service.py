import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from veilspark.plans.gate import Gate
from veilspark.service import make_server
from veilspark.streaming import live


@pytest.fixture
def server(spark, tmp_path):
    (tmp_path / "dict/synthetic_samples/a").mkdir(parents=True)
    (tmp_path / "dict/dictionary.json").write_text("{}")
    (tmp_path / "dict/synthetic_samples/a/x.csv").write_text("h\n1\n")
    spark.range(100).select((F.col("id") % 3).alias("g")).createOrReplaceTempView("facts")
    gate = Gate(spark, str(tmp_path), f"{tmp_path}/results", f"{tmp_path}/queue", f"{tmp_path}/audit.jsonl", dict_path=f"{tmp_path}/dict/dictionary.json")
    s = make_server(gate, "secret")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def ask(url, token="secret", body=None):
    request = urllib.request.Request(url, data=body, headers={"X-Gate-Token": token})
    try:
        with urllib.request.urlopen(request) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def test_token(server):
    assert ask(f"{server}/health", "")[0] == 200
    assert ask(f"{server}/dictionary.json", "wrong")[0] == 401 and ask(f"{server}/dictionary.json")[0] == 200


def test_samples_and_traversal(server):
    assert json.loads(ask(f"{server}/synthetic")[1]) == ["a/x.csv"]
    assert ask(f"{server}/synthetic/a/x.csv") == (200, "h\n1\n")
    assert ask(f"{server}/synthetic/..%2Fdictionary.json")[0] == 404 and ask(f"{server}/nothing")[0] == 404


def test_submit(server):
    code, body = ask(f"{server}/submit", body=b"SELECT g, count(*) AS n FROM facts GROUP BY g")
    assert code == 200 and json.loads(body)["status"] == "released" and "g,n" in json.loads(body)["outputs"][0]["content"]
    assert json.loads(ask(f"{server}/submit", body=b"SELECT nothing")[1])["status"] == "error"
    assert json.loads(ask(f"{server}/submit", body=b"DROP VIEW facts")[1])["status"] == "error"
    assert ask(f"{server}/submit", body=b"")[0] == 400
    assert [e["verdict"] for e in json.loads(ask(f"{server}/audit")[1])["entries"]] == ["allow", "run", "error", "error"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(400).selectExpr("timestamp_seconds(1700000000 + id * 600) AS ts", "id % 9 AS sid").coalesce(1).write.parquet(source)
    events = spark.readStream.schema("ts timestamp, sid long").parquet(source)
    for name, df, mode in (("blocks", live.diurnal_stream(events, "ts", "sid"), "append"), ("runs", live.session_stream(events, "ts", "sid", "2 hours"), "complete")):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("blocks").agg(F.sum("count")).first()[0] > 300 and spark.table("runs").agg(F.sum("n")).first()[0] == 400
