"""Whole jobs over files, with planted secrets that must not come out."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.operators import synthesis
from veilspark.plans import assessment, audit, dictionary, gate
from veilspark.sources import files

DAY0 = datetime(2024, 3, 1)
SECRETS = ["SECRETNOTE", "1961-", "lone_format", "zz_outlier"]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    lines = ["# source: ring", "# hr: heart rate", "subject_id,timestamp,hr,note,flag"]
    for i in range(12):
        for d in range(6):
            for h in (8, 9, 10, 14):
                t = DAY0 + timedelta(days=d, hours=h, minutes=i)
                text = t.strftime("%Y-%m-%dT%H:%M:%SZ") if i < 7 else t.strftime("%Y-%m-%d %H:%M:%S")
                lines.append(f"u{i},{text},{60 + h + i % 3},SECRETNOTE{i}x{d}x{h},{'common' if i or d or h > 9 else 'lone_format'}")
    lines += [f"zz_outlier,{(DAY0 + timedelta(days=d, hours=3)).strftime('%Y-%m-%dT%H:%M:%S.250Z')},61,SECRETNOTEo{d},common" for d in range(3)]
    write(f"{root}/ring/processed/hr.csv", "\n".join(lines) + "\n")
    write(f"{root}/ring/.ipynb_checkpoints/hr.csv", "a,b\n1,2\n")
    write(f"{root}/survey/raw/people.tsv", "#client: who\n\nclient\t#OTUs\tcount\tdate_of_birth\n" + "".join(f"c{i % 4}\t{i}\t{i % 3}\t1961-0{i % 9 + 1}-01\n" for i in range(30)) + "#odd\t1\t2\t1961-01-01\n")
    write(f"{root}/survey/raw/questions.csv", "field,question\nq1,How are you?\nq2,How old?\n")
    write(f"{root}/survey/raw/response_options_people.csv", "subject_id,email,free_text\n" + "".join(f"p{i},p{i}@x.org,SECRETNOTE{i}\n" for i in range(8)))
    return root


@pytest.fixture(scope="module")
def built(spark, tree, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    return out, dictionary.build(spark, tree, out)


def test_discovery(spark, tree):
    found = files.discover(spark, tree)
    assert [f.relpath for f in found] == ["ring/processed/hr.csv", "survey/raw/people.tsv", "survey/raw/questions.csv", "survey/raw/response_options_people.csv"]
    assert [(f.source, f.stage, f.role) for f in found] == [("ring", "processed", "data"), ("survey", "raw", "data"), ("survey", "raw", "codebook"), ("survey", "raw", "codebook")]
    assert files.catalog(spark, tree).count() == 4


def test_annotated_scan(spark, tree):
    header = files.read_header(spark, f"{tree}/survey/raw/people.tsv")
    assert header.delimiter == "\t" and header.names == ["client", "#OTUs", "count", "date_of_birth"] and header.descriptions == {"client": "who"} and header.skip == 3
    rows = files.scan(spark, f"{tree}/survey/raw/people.tsv", header).collect()
    assert len(rows) == 31 and rows[-1]["client"] == "#odd"
    assert files.parse_header(["# x", "", "# y: z"], False).names == [] and files.parse_header(["a\tb,c\td"], False).delimiter == "\t"


def test_cells_with_line_breaks(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/notes.csv"
    rows = [f'{i},"first {i}\n\nthird ""{i}"", and a comma",x{i}\n' if i % 3 == 0 else f"{i},plain {i},y\n" for i in range(200)]
    write(path, "# a: b\nid,note,end\n" + "".join(rows))
    got = {r.id: r for r in files.scan(spark, path).collect()}
    assert len(got) == 200 and got["3"].note == 'first 3\n\nthird "3", and a comma' and got["3"].end == "x3" and got["4"].note == "plain 4"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:  # records run over the borders of splits
        again = sorted((r.id, r.note, r.end) for r in files.scan(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == sorted((r.id, r.note, r.end) for r in got.values())
    write(f"{tmp_path}/odd.csv", 'id,note\n1,5" pipe\n2,x\n')
    assert files.scan(spark, f"{tmp_path}/odd.csv").count() == 2


def test_long_headers(spark, tmp_path):
    write(f"{tmp_path}/long.csv", "".join(f"# line {i}\n" for i in range(5000)) + "# a: what\na,b\n1,2\n")
    header = files.read_header(spark, f"{tmp_path}/long.csv")
    assert header.names == ["a", "b"] and header.skip == 5002 and header.descriptions == {"a": "what"}
    assert files.scan(spark, f"{tmp_path}/long.csv").count() == 1


def test_hashes_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    text = "some text\n" * 300_000
    write(f"{tmp_path}/a.csv", text)
    write(f"{tmp_path}/b.csv", "x")
    want = {f"{tmp_path}/{n}": hashlib.sha256(t.encode()).hexdigest() for n, t in (("a.csv", text), ("b.csv", "x"))}
    for limit in (files.ONE_CELL, 100):
        monkeypatch.setattr(files, "ONE_CELL", limit)
        assert {r.path: r.sha256 for r in files.file_hashes(spark, list(want)).collect()} == want


def test_types(spark):
    df = spark.createDataFrame([("1", "1", "1.5", "true", "x", "1"), ("2", None, "nan", "False", "y", "2x")], "a string, b string, c string, d string, e string, f string")
    assert files.infer_types(df)[1] == {"a": "int64", "b": "float64", "c": "float64", "d": "bool", "e": "object", "f": "object"}


def test_dictionary(built):
    _, d = built
    prof = d["files"]["ring/processed/hr.csv"]
    assert prof["subject_key"] == "subject_id" and prof["cohort_n"] == 13 and prof["row_count"] == 291 and prof["columns"]["hr"]["description"] == "heart rate"
    ts = prof["columns"]["timestamp"]
    assert ts["temporal_coverage"]["min_month"] == "2024-03" and ts["format"]["template"] == "%Y-%m-%dT%H:%M:%SZ"
    assert [m["template"] for m in ts["format"]["minority"]] == ["%Y-%m-%d %H:%M:%S"] and ts["temporal_distribution"]["n_contributors"] == 13
    assert "temporal_coverage" not in d["files"]["survey/raw/people.tsv"]["columns"]["date_of_birth"]
    assert d["files"]["survey/raw/questions.csv"]["role"] == "codebook" and d["files"]["survey/raw/response_options_people.csv"]["role"] == "data"


def test_the_cadence_is_that_of_all_rows(spark):
    """Of 100 subjects with a stamp a second in the first 200,000 rows, and 300 with one an hour after them."""
    fast = spark.range(200_000).select((F.col("id") % 100).alias("subject_id"), F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 100)).alias("timestamp"), F.col("id").alias(files.ORDINAL))
    slow = spark.range(1200).select((100 + F.col("id") % 300).alias("subject_id"), F.timestamp_seconds(1_700_000_000 + 3600 * F.floor(F.col("id") / 300)).alias("timestamp"), (200_000 + F.col("id")).alias(files.ORDINAL))
    rows = fast.unionByName(slow)
    for asked, cadence in ((None, "~1/hour"), (200_000, "~1/min or finer")):
        columns = {n: {"dtype": "datetime64[us]" if n == "timestamp" else "int64"} for n in ("subject_id", "timestamp")}
        dictionary.attach_facets(rows, rows, columns, "subject_id", sample_rows=asked)
        assert columns["timestamp"]["temporal_coverage"] == {"min_month": "2023-11", "max_month": "2023-11", "n_timestamps": 201_200, "cadence": cadence}


def test_nothing_leaks(built):
    out, _ = built
    for folder, _, names in os.walk(out):
        for n in names:
            with open(os.path.join(folder, n)) as f:
                text = f.read()
            assert not [s for s in SECRETS if s in text], n


def test_rendering_and_manifest(built):
    out, d = built
    with open(f"{out}/dictionary.md") as f:
        text = f.read()
    assert "**question:** How are you?; How old?" in text and "struct: peak 08-12h" in text and "(mixed)" in text
    with open(f"{out}/run_manifest.json") as f:
        manifest = json.load(f)
    assert manifest["thresholds"]["k"] == 5 and all(len(m["sha256"]) == 64 and m["bytes"] > 0 for m in manifest["files"].values())
    assert sorted(os.listdir(f"{out}/synthetic_samples")) == ["ring", "survey"]


def test_samples_are_joinable_and_repeat(spark, built, tmp_path):
    out, d = built
    assert dictionary.synthesize_dictionary(spark, f"{out}/dictionary.json", str(tmp_path), n_rows=90) == 3
    made = spark.read.csv(f"{tmp_path}/synthetic_samples/ring/processed/hr.csv", header=True)
    assert made.count() == 90 and made.columns == ["subject_id", "timestamp", "hr", "note", "flag"]
    assert {r.subject_id for r in made.select("subject_id").distinct().collect()} <= set(synthesis.id_pool())
    cols = d["files"]["ring/processed/hr.csv"]["columns"]
    a, b = (synthesis.synthesize(spark, cols, 200, 1, ("subject_id",), synthesis.id_pool()).collect() for _ in range(2))
    assert a == b and len(a) == 200
    texts = {r.subject_id: [] for r in a}
    for r in a:
        texts[r.subject_id].append(r.timestamp)
    assert all(t == sorted(t) for t in texts.values()) and any(" " in t[0] for t in texts.values())
    assert all(t.startswith("2024-03") for ts in texts.values() for t in ts)


def test_assessment_passes(spark, tree, built, tmp_path):
    report = assessment.assess(spark, tree, built[0], str(tmp_path / "report.json"))
    assert report["reid_pass"] and report["files"]["ring/processed/hr.csv"]["columns"]["timestamp"]["fidelity"]["diurnal_l1"] < 1.5


def test_assessment_finds_leaks(spark, tree, built, tmp_path):
    out = str(tmp_path)
    d = json.loads(json.dumps(built[1]))
    shape = d["files"]["ring/processed/hr.csv"]["columns"]["timestamp"]
    shape["temporal_distribution"]["diurnal_blocks"]["00-04"] = 0.1
    shape["format"]["minority"].append({"template": "%Y-%m-%dT%H:%M:%S.%fZ"})
    write(f"{out}/dictionary.json", json.dumps(d))
    report = assessment.assess(spark, tree, out)
    assert not report["reid_pass"] and report["sole_contributor_subjects"] == 1
    assert {x["element"] for x in report["reid_leaks"]} >= {"diurnal:00-04", "minority_format:%Y-%m-%dT%H:%M:%S.%fZ"}


@pytest.fixture
def gated(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("g"), "id").createOrReplaceTempView("facts")
    return gate.Gate(spark, str(tmp_path), f"{tmp_path}/results", f"{tmp_path}/queue", f"{tmp_path}/audit.jsonl", f"{tmp_path}/derived")


def test_release_mask_and_quarantine(spark, gated):
    def job(ctx):
        t = ctx.table("facts")
        return {"ok.csv": t.groupBy("g").count(), "small.csv": t.filter("g = 0 OR id < 3").groupBy("g").count(), "rows.csv": t, "person.csv": t.selectExpr("id AS user_id").limit(3), "note.txt": "mail me@x.org"}

    result = gated.submit(job)
    assert result.status == "queued" and len(result.outputs) == 2 and len(gated.pending()) == 3
    verdicts = {e.get("artifact"): e["verdict"] for e in gated.audit.entries()}
    assert verdicts == {"ok.csv": "allow", "small.csv": "suppress", "rows.csv": "block", "person.csv": "block", "note.txt": "unclassifiable", None: "run"}
    note = next(n for n in gated.pending() if n.endswith("note.txt"))
    assert os.path.exists(gated.approve(f"../{note}"))
    gated.reject(next(n for n in gated.pending() if n.endswith("rows.csv")))
    assert len(gated.pending()) == 1 and [e["verdict"] for e in gated.audit.entries()][-2:] == ["review:approve", "review:reject"]


def test_sql_job_and_errors(gated):
    assert gated.submit("SELECT g, count(*) AS n FROM facts GROUP BY g").status == "released"
    failed = gated.submit(lambda ctx: 1 / 0 if ctx else {"x": "secret 'abc' 123"})
    assert failed.status == "error" and failed.message.startswith("ZeroDivisionError")

    def bad(ctx):
        raise ValueError("value 'Ann Lee' of 12345 at job.py:12")

    assert gated.submit(bad).message == "ValueError: value '<redacted>' of <redacted> at job.py:12"
    assert gated.submit(lambda ctx: {}).status == "released"
    gated.sandbox_required = True
    assert gated.submit("SELECT 1").status == "error"


def test_what_was_checked_is_what_is_released(spark, gated, tmp_path):
    """A source that grows each time it is read: the check's rows are the released ones, and it is read once."""
    seen = str(tmp_path / "reads")
    os.makedirs(seen)

    def rows(batches):
        import pandas as pd

        for _ in batches:
            n = len(os.listdir(seen))
            write(f"{seen}/{n}", "")
            yield pd.DataFrame({"v": range(5 if n == 0 else 100)})

    def job(ctx):
        return {"out.csv": ctx.spark.range(1).coalesce(1).mapInPandas(rows, "v long")}

    result = gated.submit(job)
    assert result.status == "released" and len(os.listdir(seen)) == 1
    with open(result.outputs[0]) as f:
        assert f.read() == "v\n0\n1\n2\n3\n4\n"
    assert gated.pending() == [] and [n for n in os.listdir(gated.queue_dir) if not n.endswith(".crc")] == []


REFUSED = [
    "INSERT OVERWRITE DIRECTORY '/tmp/never-written' USING csv SELECT * FROM facts",
    "CREATE TABLE t AS SELECT * FROM facts", "CREATE VIEW v AS SELECT 1", "DROP VIEW facts", "CACHE TABLE facts", "SET spark.sql.ansi.enabled=false", "SHOW TABLES", "DESCRIBE facts",
    "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM default.facts", "SELECT * FROM unknown_view",
    "SELECT g FROM facts WHERE id IN (SELECT value FROM text.`/etc/hostname`)", "SELECT (SELECT max(value) FROM text.`/etc/hostname`) AS x",
    "WITH c AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM c", "SELECT * FROM facts WHERE EXISTS (SELECT 1 FROM other)",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x", "SELECT max(java_method('java.lang.System', 'lineSeparator')) AS x FROM facts",
    "SELECT TRANSFORM (g) USING 'cat' AS (h) FROM facts", "EXPLAIN SELECT * FROM facts", "SELECT 1; SELECT 2", "FROM facts INSERT INTO other SELECT g",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_sql_is_one_query_over_views(gated, sql):
    result = gated.submit(sql)
    assert result.status == "error" and result.outputs == [] and gated.audit.entries()[-1]["verdict"] == "error"
    assert not os.path.exists("/tmp/never-written") and gated.spark.table("facts").count() == 100


@pytest.mark.parametrize("sql", [
    "WITH c AS (SELECT g, count(*) AS n FROM facts GROUP BY g), d AS (SELECT * FROM c WHERE n > 5) SELECT * FROM d ORDER BY g LIMIT 3",
    "SELECT f.g, sum(f.id) AS s, count(*) AS n FROM facts f JOIN (SELECT DISTINCT g FROM facts) x ON f.g = x.g GROUP BY f.g HAVING count(*) > 1",
    "SELECT g, count(*) AS n FROM facts WHERE id > (SELECT avg(id) FROM facts) AND g IN (SELECT g FROM facts) GROUP BY g UNION ALL SELECT 9, 50",
    "SELECT DISTINCT g, max(id) OVER (PARTITION BY g) AS top FROM facts", "SELECT * FROM VALUES (1, 2), (3, 4) AS t(a, b)",
])
def test_queries_that_are_run(gated, sql):
    result = gated.submit(sql)
    assert result.status == "released", result.message


def test_tables_and_layers_by_name(spark, gated, tree):
    gated.data_dir = tree
    job = lambda ctx: {"n.csv": ctx.table("ring/processed/hr.csv").groupBy("flag").count(), "x.csv": ctx.table("facts").groupBy("g").count()}
    assert gated.submit(job).status == "released"
    assert gated.submit(lambda ctx: {"n.csv": ctx.table("../secret.csv")}).status == "error"
    write(f"{gated.derived_dir}/scores/data.tsv", "public_client_id\tscore\na\t1.5\nb\t2.5\n")
    assert gate.Context(spark, tree, gated.derived_dir).derived("scores").agg({"score": "sum"}).first()[0] == 4.0


def test_timeouts(spark, gated):
    import time

    assert [gate.clamp_timeout(x) for x in (None, 0, -4, 99999, 7)] == [120, 120, 1, 3600, 7]

    def slow(ctx):
        time.sleep(2)
        return {"x": ctx.spark.range(10**12).selectExpr("sum(id) AS n")}

    assert gated.submit(slow, timeout=1).message == "timeout"


def test_layers(spark, gated, tmp_path):
    out = str(tmp_path / "dict")
    os.makedirs(out)
    write(f"{out}/dictionary.json", json.dumps({"files": {}, "sources": {}}))
    gated.dict_path = f"{out}/dictionary.json"

    def job(ctx):
        ctx.write_layer(ctx.spark.range(40).selectExpr("concat('c', id) AS public_client_id", "id * 1.5D AS score"), {"w": [1]})
        return {}

    assert gated.submit(job, layer_name="scores").status == "released" and not os.path.exists(gated.results_dir)
    with open(f"{gated.derived_dir}/scores/MANIFEST.json") as f:
        manifest = json.load(f)
    assert manifest["n_persons"] == manifest["n_rows"] == 40 and len(manifest["data_hash"]) == 16
    gated.submit(job, layer_name="scores")
    with open(f"{gated.derived_dir}/scores/PROVENANCE.jsonl") as f:
        assert len(f.readlines()) == 2
    d = dictionary.load(gated.dict_path)
    assert d["files"]["scores"]["derived"] and "scores" in d["sources"][""] and d["files"]["scores"]["columns"]["public_client_id"]["values_suppressed"]
    assert spark.table("derived_scores").count() == 40


@pytest.mark.parametrize(("name", "sql"), [("../x", "SELECT 'a' AS public_client_id"), ("-x", "SELECT 'a' AS public_client_id"), ("ok", "SELECT 1 AS other"), ("ok", "SELECT 'a' AS public_client_id WHERE false"), ("ok", None)])
def test_layers_that_are_refused(spark, gated, name, sql):
    def job(ctx):
        if sql:
            ctx.write_layer(ctx.spark.sql(sql))
        return {}

    assert gated.submit(job, layer_name=name).status == "released"
    assert gated.audit.entries()[-1]["verdict"] == "derivation_rejected"


def test_no_store_no_layer(gated):
    gated.derived_dir = None
    gated.submit(lambda ctx: {}, layer_name="x")
    assert gated.audit.entries()[-1] == gated.audit.entries()[-1] | {"verdict": "derivation_rejected", "reason": "there is no place for layers"}


def test_audit_ids(spark, tmp_path):
    log = audit.AuditLog(str(tmp_path / "a.jsonl"))
    assert log.entries() == [] and log.record({"b": 1, "a": 2}) == log.record({"a": 2, "b": 1}) and len(log.entries()) == 2
    write(f"{tmp_path}/old.jsonl", '{"id": "x"}\n\n{"id": "y"}\n')
    assert [e["id"] for e in audit.AuditLog(f"{tmp_path}/old.jsonl").entries()] == ["x", "y"]
