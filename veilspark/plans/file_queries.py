"""Queries of files, the dictionary, the gate, layers and made data, with the SQL that says the same. What they read is
written from the driver's tables first, as a user's files would be."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions import timestamps as TS
from veilspark.operators import formats, groups, imputation, profile, synthesis, temporal
from veilspark.plans import assessment, dictionary, gate, layers
from veilspark.plans.audit import AuditLog
from veilspark.plans.scripts import Script
from veilspark.plans.queries import _EV, _LABEL, _STAMPS_SQL, _STEPS, _events, _stamps, query
from veilspark.service import Routes
from veilspark.session import table
from veilspark.sources import files as S
from veilspark.sources.scratch import new_folder
from veilspark.sources.store import Store, join


def _write_lines(lines: DataFrame, path: str) -> str:
    """lines: o, line. One text file, in the order of o."""
    store, parts = Store(lines.sparkSession), f"{path}.parts"
    lines.repartition(1).sortWithinPartitions("o").select("line").write.text(parts)
    store.move(join(parts, next(n for n in store.names(parts) if n.startswith("part-"))), path)
    store.delete(parts)
    return path


def _with_head(rows: DataFrame, *head: str) -> DataFrame:
    """rows: o (from 0), line; with the lines of a head above them."""
    return rows.sparkSession.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "o long, line string").unionByName(rows.select(F.col("o").cast("long"), "line"))


# ---- discovery, headers, scans


@query("""WITH f AS (SELECT r_name AS source, r_name || '/raw/questions.csv' AS relpath, 'raw' AS stage, 'codebook' AS role FROM region
UNION ALL SELECT r_name, r_name || '/processed/data.TSV', 'processed', 'data' FROM region UNION ALL SELECT '', 'top.csv', '', 'data')
SELECT row_number() OVER (ORDER BY relpath) AS place, relpath, source, stage, role, 2 AS size FROM f""")
def files_discovered(spark, sf):
    root, store = new_folder(spark), Store(spark)
    for r in table(spark, sf, "region").collect():
        for name in ("raw/questions.csv", "processed/data.TSV", ".ipynb_checkpoints/data.csv", "notes.txt"):
            store.write(join(root, r.r_name, name), "a\n")
    store.write(join(root, "top.csv"), "a\n")
    found = S.discover(spark, root)
    places = spark.createDataFrame([(i, f.relpath) for i, f in enumerate(found, 1)], "place long, relpath string")
    return places.join(S.catalog(spark, root).drop("path"), "relpath")


def _supplier_file(spark, sf, path: str) -> str:
    cell = F.concat(F.lit('"'), F.col("s_name"), F.lit('\n""x"", y"'))
    line = F.concat_ws(",", "s_suppkey", cell, "s_nationkey", "s_acctbal")
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("o"), line.alias("line"))
    return _write_lines(_with_head(rows, "# made of suppliers", "# s_name: who it is", "# other: nothing", "", "s_suppkey,s_name,s_nationkey,s_acctbal"), path)


_SUPPLIERS = "SELECT s_suppkey, s_name || chr(10) || '\"x\", y' AS s_name, s_nationkey, s_acctbal FROM supplier"


@query(_SUPPLIERS)
def annotated_table(spark, sf):
    return S.infer_types(S.scan(spark, _supplier_file(spark, sf, join(new_folder(spark), "supplier.csv"))))[0].drop(S.ORDINAL)


@query(f"{_SUPPLIERS} ORDER BY s_suppkey LIMIT 10")
def annotated_head(spark, sf):
    rows = S.infer_types(S.scan(spark, _supplier_file(spark, sf, join(new_folder(spark), "supplier.csv"))))[0]
    return rows.orderBy(S.ORDINAL).limit(10).drop(S.ORDINAL)


_PLAIN_SQL = "NOT regexp_matches(text, '[,\\n\\r]') AND NOT starts_with(text, chr(34))"


@query(f"""SELECT doc_id, source, lang, md5(coalesce(text, '') || CASE WHEN {_PLAIN_SQL} THEN ' 5" x' WHEN doc_id % 3 = 1 THEN 'tail" ' ELSE '' END) AS text_md5
FROM documents""")
def quoted_documents(spark, sf):
    """All documents as the rows of many annotated files and back: cells with line breaks and doubled quotes, text after
    a closing quote, and stray quotes in cells without any."""
    text = F.coalesce("text", F.lit(""))
    plain = ~text.rlike("[,\n\r]") & ~text.startswith('"')
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'), F.when(F.col("doc_id") % 3 == 1, 'tail" ').otherwise(""))
    line = F.concat_ws(",", "doc_id", "source", F.when(plain, F.concat(text, F.lit(' 5" x'))).otherwise(quoted), "lang")
    rows = table(spark, sf, "documents").select(F.lit(2).alias("o"), F.pmod("doc_id", F.lit(16)).cast("int").alias("part"), line.alias("line"))
    heads = spark.range(16).select(F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.col("id").cast("int").alias("part"), F.lit(x).alias("line")) for i, x in enumerate(("# documents", "doc_id,source,text,lang"))))).alias("r")).select("r.*")
    path = join(new_folder(spark), "documents")
    rows.unionByName(heads).repartition(16, "part").sortWithinPartitions("part", "o").drop("o").write.partitionBy("part").text(path)
    got = S.scan(spark, path)
    return got.select(F.col("doc_id").cast("long"), "source", "lang", F.md5("text").alias("text_md5"))


@query("SELECT 'c' || n_nationkey AS name, n_name AS description, chr(9) AS delimiter, (SELECT count(*) + 2 FROM nation) AS skip FROM nation WHERE n_nationkey % 2 = 0")
def header_descriptions(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("o"), F.concat(F.lit("# c"), "n_nationkey", F.lit(": "), "n_name").alias("line"))
    names = "\t".join(f"c{r.n_nationkey}" for r in table(spark, sf, "nation").filter("n_nationkey % 2 = 0").orderBy("n_nationkey").collect())
    end = spark.createDataFrame([(10**9, ""), (10**9 + 1, names), (10**9 + 2, "x\ty")], "o long, line string")
    header = S.read_header(spark, _write_lines(rows.select(F.col("o").cast("long"), "line").unionByName(end), join(new_folder(spark), "head.txt.csv")))
    return spark.createDataFrame([(n, header.descriptions[n], header.delimiter, header.skip) for n in header.names], "name string, description string, delimiter string, skip long")


_TYPED = {"customer": ("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "orders": ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"), "part": ("p_size", "p_retailprice", "p_brand")}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN bool_and(regexp_matches(v, '^[+-]?[0-9]{{1,18}}$')) THEN 'int64' WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'float64' ELSE 'object' END AS kind
FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t})""" for t, cs in _TYPED.items() for c in cs))
def inferred_types(spark, sf):
    kinds = {}
    for t, cs in _TYPED.items():
        kinds |= S.infer_types(table(spark, sf, t).select(*(F.col(c).cast("string") for c in cs)))[1]
    return spark.createDataFrame(list(kinds.items()), "column string, kind string")


@query("""WITH c AS (SELECT DISTINCT c_name AS v FROM customer), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM c)
SELECT place, v AS value FROM r WHERE place < 1000 UNION ALL SELECT 1000, '…(' || (count(*) - 1000) || ' more)' FROM c HAVING count(*) > 1000""")
def codebook_capped(spark, sf):
    return S.codebook_text(table(spark, sf, "customer").select("c_name")).select(F.posexplode("values").alias("place", "value"))


@query("SELECT 'nations.csv' AS name, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) AS sha256, sum(strlen(n_name) + 1) AS bytes FROM nation")
def file_digests(spark, sf):
    path = _write_lines(table(spark, sf, "nation").select(F.col("n_nationkey").alias("o"), F.col("n_name").alias("line")), join(new_folder(spark), "nations.csv"))
    return S.file_hashes(spark, [path]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256", "bytes")


@query("""SELECT table_name AS "table", column_name AS "column", data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'BOOLEAN') AS "numeric"
FROM information_schema.columns WHERE table_name IN ('events', 'orders', 'lineitem', 'documents', 'embeddings', 'labels')""")
def numeric_columns(spark, sf):
    rows = [(t, f.name, profile.is_numeric(f)) for t in ("events", "orders", "lineitem", "documents", "embeddings", "labels") for f in table(spark, sf, t).schema]
    return spark.createDataFrame(rows, "table string, column string, numeric boolean")


# ---- dictionary and assessment

_SAID = """SELECT 'column' AS part, file || '/' || col AS name, kind || ' ' || n || ' ' || d || ' ' || CASE WHEN hidden THEN 'sensitive' ELSE 'open' END AS said FROM c"""


@query(f"""WITH c AS (
SELECT 'supplier.csv' AS file, 's_suppkey' AS col, 'int64' AS kind, count(*) AS n, count(DISTINCT s_suppkey) AS d, false AS hidden FROM supplier
UNION ALL SELECT 'supplier.csv', 's_name', 'object', count(*), count(DISTINCT s_name), true FROM supplier
UNION ALL SELECT 'supplier.csv', 's_nationkey', 'int64', count(*), count(DISTINCT s_nationkey), false FROM supplier
UNION ALL SELECT 'supplier.csv', 's_acctbal', 'float64', count(*), count(DISTINCT s_acctbal), false FROM supplier
UNION ALL SELECT 'balances', 'public_client_id', 'int64', count(*), count(DISTINCT c_custkey), true FROM customer
UNION ALL SELECT 'balances', 'score', 'float64', count(*), count(DISTINCT c_acctbal), false FROM customer
UNION ALL SELECT 'raw/questions.csv', 'field', 'object', count(*), count(*), true FROM nation
UNION ALL SELECT 'raw/questions.csv', 'question', 'object', count(*), count(*), true FROM nation)
{_SAID}
UNION ALL SELECT 'file', 'supplier.csv', 'data ' || count(*) FROM supplier UNION ALL SELECT 'file', 'raw/questions.csv', 'codebook ' || count(*) FROM nation
UNION ALL SELECT 'codebook', 'question', sha256(string_agg('What is ' || n_name || '?', '; ' ORDER BY 'What is ' || n_name || '?')) FROM nation
UNION ALL SELECT 'markdown', col, '| ' || col || ' | ' || kind || ' | 0.0 | ' || d || ' | ' || CASE WHEN hidden THEN 'True' ELSE 'False' END || ' | ' || CASE WHEN col = 's_name' THEN 'who it is' ELSE '' END || ' |' FROM c WHERE file = 'supplier.csv'
UNION ALL SELECT 'manifest', 'raw/questions.csv', sha256('field,question' || chr(10) || string_agg('q' || n_nationkey || ',What is ' || n_name || '?', chr(10) ORDER BY n_nationkey) || chr(10)) FROM nation
UNION ALL SELECT 'sample', 'supplier.csv', '100' UNION ALL SELECT 'sample', 'balances.csv', '100'""")
def dictionary_build(spark, sf):
    """A directory of a table and a codebook becomes a dictionary, to which a layer is added."""
    root, out, store = new_folder(spark), new_folder(spark), Store(spark)
    _supplier_file(spark, sf, join(root, "supplier.csv"))
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("o"), F.concat(F.lit("q"), "n_nationkey", F.lit(",What is "), "n_name", F.lit("?")).alias("line"))
    _write_lines(_with_head(asked, "field,question"), join(root, "raw/questions.csv"))
    dictionary.build(spark, root, out)
    layer = table(spark, sf, "customer").select(F.col("c_custkey").alias("public_client_id"), F.col("c_acctbal").alias("score"))
    dictionary.add_layer(spark, join(out, "dictionary.json"), out, "balances", layer)
    made = dictionary.load(join(out, "dictionary.json"), spark)["files"]
    rows = [("column", f"{f}/{c}", f"{x['dtype']} {x['n']} {x['cardinality']} {'sensitive' if x['sensitive'] else 'open'}") for f, p in made.items() for c, x in p["columns"].items()]
    rows += [("file", f, f"{p['role']} {p['row_count']}") for f, p in made.items() if "role" in p]
    text = "; ".join(made["raw/questions.csv"]["codebook_text"]["question"])
    markdown = store.read(join(out, "dictionary.md")).splitlines()
    rows += [("markdown", x.split(" ")[1], x) for x in markdown if x.startswith("| s_")]
    rows += [("manifest", "raw/questions.csv", json.loads(store.read(join(out, "run_manifest.json")))["files"]["raw/questions.csv"]["sha256"])]
    rows += [("sample", n, str(spark.read.csv(join(out, "synthetic_samples", n), header=True).count())) for n in store.names(join(out, "synthetic_samples"))]
    said = spark.createDataFrame(rows, "part string, name string, said string")
    return said.unionByName(spark.createDataFrame([("codebook", "question", text)], said.schema).withColumn("said", F.sha2("said", 256)))


@query(f"""WITH {_EV} SELECT 'contributors' AS fact, CAST(count(DISTINCT sid) AS VARCHAR) AS said FROM e UNION ALL SELECT 'reid_pass', 'true' UNION ALL SELECT 'leaks', '0'
UNION ALL SELECT 'blocks', '6' UNION ALL SELECT 'in range', 'true'""")
def assessment_of_events(spark, sf):
    root, out = new_folder(spark), new_folder(spark)
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("o"), F.concat_ws(",", "user_id", when, "event_type").alias("line"))
    _write_lines(_with_head(rows, "user_id,event_time,kind"), join(root, "ring/events.csv"))
    dictionary.build(spark, root, out)
    report = assessment.assess(spark, root, out, join(out, "report.json"))
    own = json.loads(Store(spark).read(join(out, "report.json")))["files"]["ring/events.csv"]["columns"]["event_time"]
    facts = {"contributors": str(own["real_contributors"]), "reid_pass": str(report["reid_pass"]).lower(), "leaks": str(len(report["reid_leaks"])), "blocks": str(len(own["diurnal"])), "in range": str(own["fidelity"]["syn_in_real_range"]).lower()}
    return spark.createDataFrame(list(facts.items()), "fact string, said string")


@query(f"WITH {_EV} SELECT lpad(CAST(b * 4 AS VARCHAR), 2, '0') || '-' || lpad(CAST((b + 1) * 4 AS VARCHAR), 2, '0') AS block, count(DISTINCT sid) AS real_subjects FROM (SELECT sid, ((us // 3600000000) % 24) // 4 AS b FROM e WHERE sid IS NOT NULL) GROUP BY b")
def block_subjects(spark, sf):
    return assessment.block_subjects(_events(spark, sf))


@query(f"""WITH e AS (SELECT user_id AS sid, epoch_us(date_trunc('second', ts)) AS us FROM events WHERE event_id % 10 <> 0), {_STEPS},
m AS (SELECT quantile_cont(delta, 0.5) AS med FROM d WHERE delta IS NOT NULL GROUP BY sid), x AS (SELECT quantile_cont(med, 0.5) AS s FROM m),
r AS (SELECT strftime(make_timestamp(min(us)), '%Y-%m') AS min_month, strftime(make_timestamp(max(us)), '%Y-%m') AS max_month, count(*) AS n_timestamps FROM e)
SELECT 'event_time' AS "column", min_month, max_month, n_timestamps, {_LABEL} AS cadence, true AS distribution FROM r, x""")
def temporal_facets(spark, sf):
    """Of columns named alike, only the one whose cells are times has facets; a birth date has none."""
    when = F.when(F.col("event_id") % 10 != 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    raw = table(spark, sf, "events").select("user_id", when.alias("event_time"), F.col("value").alias("resting_time"), F.lit("1961-02-03").alias("date_of_birth"), F.col("event_id").alias(S.ORDINAL))
    columns = {n: {"dtype": d} for n, d in (("event_time", "object"), ("resting_time", "float64"), ("date_of_birth", "object"), ("user_id", "int64"))}
    dictionary.attach_facets(raw, raw, columns, "user_id")
    rows = [(n, *(c["temporal_coverage"][k] for k in ("min_month", "max_month", "n_timestamps", "cadence")), "temporal_distribution" in c) for n, c in columns.items() if "temporal_coverage" in c]
    return spark.createDataFrame(rows, "column string, min_month string, max_month string, n_timestamps long, cadence string, distribution boolean")


# ---- gate, log and layers


def _gate(spark, folder: str, data_dir: str | None = None) -> gate.Gate:
    return gate.Gate(spark, data_dir or folder, join(folder, "results"), join(folder, "queue"), join(folder, "audit"), join(folder, "derived"))


def _job(sf: str):
    def job(ctx):
        read = lambda t: table(ctx.spark, sf, t)
        return {
            "a.csv": read("customer").groupBy(F.col("c_mktsegment").alias("segment")).count(),
            "b.csv": read("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).unionByName(ctx.spark.createDataFrame([("few", 3)], "status string, n long")),
            "c.csv": read("customer").select("c_acctbal"),
            "d.csv": read("region").select(F.col("r_name").alias("email")),
            "e.txt": "a note",
            "f/g.csv": read("nation").select(F.expr("CAST(raise_error('secret') AS STRING)").alias("x")),
        }

    return job


@query("""SELECT * FROM (VALUES ('a.csv', 'allow', true), ('b.csv', 'suppress', true), ('c.csv', 'block', false), ('d.csv', 'block', false), ('e.txt', 'unclassifiable', false),
('f/g.csv', 'unclassifiable', false), (NULL, 'run', NULL)) AS t(artifact, verdict, delivered)""")
def gate_verdicts(spark, sf):
    """One run of a job with outputs of all kinds, by its log."""
    gated = _gate(spark, new_folder(spark))
    gated.submit(_job(sf))
    rows = [(e.get("artifact"), e["verdict"], ("delivered_to" in e) if "artifact" in e else None) for e in gated.audit.entries()]
    return spark.createDataFrame(rows, "artifact string, verdict string, delivered boolean")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5")
def gate_release(spark, sf):
    """What of b.csv is delivered: the masked cells."""
    gated = _gate(spark, new_folder(spark))
    result = gated.submit(lambda ctx: {"b.csv": _job(sf)(ctx)["b.csv"]})
    return spark.read.csv(result.outputs[0], header=True, schema="status string, n long")


_SCRIPT = """
import os
from pyspark.sql import SparkSession
spark = SparkSession.builder.getOrCreate()
orders = spark.read.parquet(os.environ["DATA_DIR"] + "/orders.parquet")
counts = orders.groupBy("o_orderpriority", "o_orderstatus").count()
counts.coalesce(1).write.csv(os.environ["OUTPUT_DIR"] + "/counts.csv", header=True)
with open(os.path.join(os.environ["OUTPUT_DIR"].removeprefix("file:"), "notes.txt"), "w") as f:
    f.write("not a table")
"""


@query("""SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, 1 AS queued FROM orders GROUP BY 1, 2 HAVING count(*) >= 5""")
def gate_script(spark, sf):
    """What a script's process counts with a Spark application of its own, as the gate releases it; its notes wait."""
    gated = _gate(spark, new_folder(spark), sf)
    result = gated.submit(Script(_SCRIPT))
    return spark.read.csv(result.outputs[0], header=True, schema="priority string, status string, n long").withColumn("queued", F.lit(len(gated.pending())))


@query("SELECT n_regionkey AS region, count(*) AS nations FROM nation GROUP BY 1")
def gate_sql(spark, sf):
    """A submitted SQL query over a registered view."""
    view = f"nations_{uuid.uuid4().hex}"
    table(spark, sf, "nation").createOrReplaceTempView(view)
    try:
        result = _gate(spark, new_folder(spark)).submit(f"SELECT n_regionkey AS region, count(*) AS nations FROM {view} GROUP BY n_regionkey")
    finally:
        spark.catalog.dropTempView(view)
    return spark.read.csv(result.outputs[0], header=True, schema="region long, nations long")


@query("SELECT * FROM (VALUES ('pending', '4'), ('approved', 'true'), ('left', '2'), ('last', 'review:reject'), ('released', '2'), ('queued', '4')) AS t(fact, said)")
def gate_review(spark, sf):
    """Outputs kept back: one is approved, one rejected."""
    gated, store = _gate(spark, new_folder(spark)), Store(spark)
    gated.submit(_job(sf))
    waiting, run = gated.pending(), gated.audit.entries()[-1]
    to = gated.approve(next(n for n in waiting if n.endswith("e.txt")))
    gated.reject(next(n for n in waiting if n.endswith("c.csv")))
    facts = {"pending": len(waiting), "approved": str(store.exists(to)).lower(), "left": len(gated.pending()), "last": gated.audit.entries()[-1]["verdict"], "released": run["released"], "queued": run["queued"]}
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "fact string, said string")


@query("""SELECT * FROM (VALUES ('command', 'error', 'only a single query is run'), ('file', 'error', 'only registered views are read'), ('failure', 'error', 'ValueError: no ''<redacted>'' of <redacted>'),
('sandbox', 'error', 'a sandbox is required and there is none'), ('nothing', 'released', '0 released, 0 queued'), ('timeouts', '120', '1 3600 7')) AS t("case", status, said)""")
def gate_errors(spark, sf):
    gated, rows = _gate(spark, new_folder(spark)), []

    def fails(ctx):
        raise ValueError("no 'Ann Lee' of 12345")

    for name, job in (("command", "CREATE TABLE t AS SELECT 1"), ("file", f"SELECT * FROM parquet.`{sf}/nation.parquet`"), ("failure", fails), ("nothing", lambda ctx: {})):
        result = gated.submit(job)
        rows.append((name, result.status, result.message))
    gated.sandbox_required = True
    result = gated.submit("SELECT 1")
    rows += [("sandbox", result.status, result.message), ("timeouts", str(gate.clamp_timeout(None)), " ".join(str(gate.clamp_timeout(x)) for x in (-4, 10**6, 7)))]
    return spark.createDataFrame(rows, "case string, status string, said string")


@query("""SELECT substr(sha256('{"a": ' || n_nationkey || ', "b": "' || n_name || '"}'), 1, 16) AS id, n_nationkey AS a FROM nation""")
def audit_ids(spark, sf):
    log = AuditLog(join(new_folder(spark), "audit"), spark)
    for r in table(spark, sf, "nation").collect():  # 25 rows
        log.record({"b": r.n_name, "a": int(r.n_nationkey)})
    return spark.createDataFrame([(e["id"], e["a"]) for e in log.entries()], "id string, a long")


@query("""WITH l AS (SELECT o_custkey AS public_client_id, avg(o_totalprice) AS score FROM orders GROUP BY 1)
SELECT c_mktsegment AS segment, count(*) AS n, round(avg(score), 4) AS mean, 2 AS provenance, (SELECT count(*) FROM l) AS n_persons FROM l JOIN customer ON public_client_id = c_custkey GROUP BY 1""")
def layer_kept(spark, sf):
    """A job's per-person table is kept as a layer, twice, and joined by a later job; its manifest counts persons."""
    folder = new_folder(spark)
    gated = _gate(spark, folder)

    def job(ctx):
        ctx.write_layer(table(ctx.spark, sf, "orders").groupBy(F.col("o_custkey").alias("public_client_id")).agg(F.avg("o_totalprice").alias("score")))
        return {}

    for _ in range(2):
        gated.submit(job, layer_name="scores")
    home = join(folder, "derived", "scores")
    manifest, provenance = json.loads(Store(spark).read(join(home, layers.MANIFEST))), Store(spark).read(join(home, layers.PROVENANCE)).splitlines()
    rows = gate.Context(spark, sf, join(folder, "derived")).derived("scores").join(table(spark, sf, "customer"), F.col("public_client_id") == F.col("c_custkey"))
    out = rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean"))
    return out.withColumns({"provenance": F.lit(len(provenance)), "n_persons": F.lit(manifest["n_persons"])})


@query("SELECT * FROM (VALUES ('../x', 'derivation_rejected'), ('no_key', 'derivation_rejected'), ('no_rows', 'derivation_rejected'), ('nothing', 'derivation_rejected'), ('good', 'derivation')) AS t(layer, verdict)")
def layer_refusals(spark, sf):
    gated, rows = _gate(spark, new_folder(spark)), []
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("public_client_id"))
    for name, df in (("../x", people), ("no_key", people.withColumnRenamed("public_client_id", "other")), ("no_rows", people.filter("false")), ("nothing", None), ("good", people)):
        gated.submit(lambda ctx, df=df: ctx.write_layer(df) or {} if df is not None else {}, layer_name=name)
        rows.append((name, gated.audit.entries()[-1]["verdict"]))
    return spark.createDataFrame(rows, "layer string, verdict string")


@query("SELECT s_nationkey, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1")
def tables_by_name(spark, sf):
    """A job reads a file of the data directory by its relative name."""
    root = new_folder(spark)
    _supplier_file(spark, sf, join(root, "shop/supplier.csv"))
    rows = gate.Context(spark, root).table("shop/supplier.csv")
    return rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT * FROM (VALUES ('/dictionary.json', 200, 'application/json'), ('/dictionary.md', 200, 'text/markdown'), ('/synthetic', 200, 'application/json'), ('/synthetic/a%2Fx.csv', 200, 'text/csv'),
('/synthetic/..%2Fdictionary.json', 404, 'application/json'), ('/audit', 200, 'application/json'), ('/nothing', 404, 'application/json'), ('submit', 200, 'released'), ('submit nothing', 400, 'application/json')) AS t(path, status, kind)""")
def http_routes(spark, sf):
    folder, store = new_folder(spark), Store(spark)
    for name, text in (("dictionary.json", "{}"), ("dictionary.md", "# x"), ("synthetic_samples/a/x.csv", "h\n1\n")):
        store.write(join(folder, "dict", name), text)
    gated = _gate(spark, folder)
    gated.dict_path = join(folder, "dict/dictionary.json")
    routes = Routes(gated)
    asked = ("/dictionary.json", "/dictionary.md", "/synthetic", "/synthetic/a%2Fx.csv", "/synthetic/..%2Fdictionary.json", "/audit", "/nothing")
    rows = [(path, *routes.asked(path)[:2]) for path in asked]
    status, _, body = routes.submitted(b"SELECT 1 AS x")
    rows += [("submit", status, json.loads(body)["status"]), ("submit nothing", *routes.submitted(b"")[:2])]
    return spark.createDataFrame(rows, "path string, status int, kind string")


# ---- formats, epochs, imputation

_SHAPES = {
    0: ("epoch_ms", "CAST(epoch_ms(ts) AS VARCHAR)"), 1: ("epoch_s", "1"), 2: ("epoch_s_float", "1.5"), 3: ("%Y-%m-%d", ""), 4: ("%Y-%m-%dT%H:%M:%SZ", ""), 5: ("%Y-%m-%d %H:%M:%S", ""),
    6: ("%Y-%m-%dT%H:%M:%S%z", ""), 7: ("%Y-%m-%dT%H:%M:%S.%fZ", ""), 8: ("other", ""),
}


def _shaped(spark, sf) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    texts = [F.unix_millis(t).cast("string"), F.unix_seconds(t).cast("string"), F.concat(F.unix_seconds(t).cast("string"), F.lit(".25")), F.date_format(t, "yyyy-MM-dd"), F.concat(iso, F.lit("Z")), F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.concat(iso, F.lit("+02:00")), F.concat(iso, F.lit(".125Z")), F.date_format(t, "M/d/yy")]
    text = F.when(F.col("event_id") % 10 == 9, F.lit(" NaN "))
    for i, x in enumerate(texts):
        text = text.when(F.col("event_id") % 10 == i, x)
    return table(spark, sf, "events").select("user_id", text.alias("stamp"))


@query(f"""WITH k(i, template) AS (VALUES {", ".join(f"({i}, '{t}')" for i, (t, _) in _SHAPES.items())})
SELECT template, count(*) AS "count", count(DISTINCT user_id) AS n_subjects FROM events JOIN k ON event_id % 10 = i GROUP BY 1""")
def format_shapes(spark, sf):
    """All eight shapes and what is no time; cells that mean nothing have no format."""
    return formats.format_counts(_shaped(spark, sf), "stamp", "user_id").select("format.template", "count", "n_subjects")


@query(f"WITH {_STAMPS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY n DESC, template) AS r FROM c) SELECT (SELECT template FROM o WHERE r = 1) AS template, (SELECT count(*) FROM o WHERE r > 1 AND s >= 5) > 0 AS mixed, (SELECT count(*) FROM o WHERE r > 1 AND s >= 5) AS minority, true AS digit_free")
def format_descriptor(spark, sf):
    found = formats.descriptor(formats.disclosed_formats(formats.format_counts(_stamps(spark, sf), "stamp", "user_id")).collect())  # one row a shape
    minority = found.get("minority", [])
    shown = [found["template"], *(m["template"] for m in minority)]
    return spark.createDataFrame([(found["template"], bool(found.get("mixed")), len(minority), not any(c.isdigit() for t in shown for c in t))], "template string, mixed boolean, minority long, digit_free boolean")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(epoch_ms(s) AS VARCHAR) WHEN 1 THEN CAST(epoch_ms(s) // 1000 AS VARCHAR) WHEN 2 THEN (epoch_ms(s) // 1000) || '.000' WHEN 3 THEN strftime(s, '%Y-%m-%d')
WHEN 4 THEN strftime(s, '%Y-%m-%dT%H:%M:%S') || 'Z' ELSE strftime(s, '%Y-%m-%d %H:%M:%S') END AS said FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)""")
def format_rendering(spark, sf):
    kinds = [{"representation": "epoch_ms"}, {"representation": "epoch_s", "template": "epoch_s"}, {"representation": "epoch_s", "template": "epoch_s_float"}, {"representation": "iso8601", "granularity": "date"}, {"representation": "iso8601", "separator": "T", "timezone": "utc"}, {"representation": "iso8601", "separator": " ", "timezone": "naive"}]
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 6 == 0, TS.render(t, kinds[0]))
    for i, kind in enumerate(kinds[1:], 1):
        text = text.when(F.col("event_id") % 6 == i, TS.render(t, kind))
    return table(spark, sf, "events").select("event_id", text.alias("said"))


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS from_s, epoch_us(ts) // 1000 * 1000 AS from_ms FROM events")
def epoch_parse(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.unix_micros(TS.from_epoch(F.floor(ms / 1000), "s")).alias("from_s"), F.unix_micros(TS.from_epoch(ms, "ms")).alias("from_ms"))


_GAPPY = {"l_quantity": 45, "l_discount": 0.05, "l_tax": 0.07, "l_extendedprice": 60000}


def _gappy(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(F.when(F.col(c) <= m, F.col(c)).alias(c) for c, m in _GAPPY.items()))


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER ({c} > {m}) AS gaps FROM lineitem" for c, m in _GAPPY.items()) + ") SELECT row_number() OVER (ORDER BY gaps, c) AS place, c AS \"column\" FROM m ORDER BY gaps, c LIMIT 3")
def best_detected_columns(spark, sf):
    return spark.createDataFrame(list(enumerate(groups.best_detected(_gappy(spark, sf), list(_GAPPY), 3), 1)), "place long, column string")


@query(f"SELECT count(*) AS n, 0 AS gaps, {', '.join(f'round(sum({c}) FILTER ({c} <= {m}), 2) AS {c}' for c, m in _GAPPY.items())} FROM lineitem")
def imputed_matrix(spark, sf):
    """No gap is left, and cells that were known are as they were."""
    names = list(_GAPPY)
    both = imputation.impute(_gappy(spark, sf).withColumns({f"k_{c}": F.col(c).isNotNull() for c in names}), names)
    gaps = sum((F.count_if(F.col(c).isNull() | F.isnan(c)) for c in names), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("n"), gaps.alias("gaps"), *(F.round(F.sum(F.when(F.col(f"k_{c}"), F.col(c))), 2).alias(c) for c in names))


# ---- made data, by what holds of it whatever the draws

_FORMAT = {"representation": "iso8601", "granularity": "datetime", "separator": "T", "timezone": "utc", "template": "%Y-%m-%dT%H:%M:%SZ", "mixed": True, "minority": [{"representation": "iso8601", "granularity": "datetime", "separator": " ", "timezone": "naive", "template": "%Y-%m-%d %H:%M:%S"}]}


def _made(spark, sf, n: int = 317) -> DataFrame:
    events = _events(spark, sf)
    columns = {
        "user_id": {"dtype": "int64"},
        "ts": {"dtype": "object", "temporal_coverage": temporal.month_bounds(events).first().asDict(), "format": _FORMAT, "temporal_distribution": dictionary.temporal_distribution(events)},
        "event_type": {"dtype": "object", "categories": sorted(r.value for r in profile.value_counts(table(spark, sf, "events"), ["event_type"]).filter("count >= 5").collect())},
    }
    return synthesis.synthesize(spark, columns, n, 0, ("user_id",), synthesis.id_pool())


@query("SELECT 'SYNTH_' || lpad(CAST(range AS VARCHAR), 4, '0') AS user_id, CASE WHEN range < 7 THEN 32 ELSE 31 END AS n, CASE WHEN range = 1 THEN '%Y-%m-%d %H:%M:%S' ELSE '%Y-%m-%dT%H:%M:%SZ' END AS template, true AS in_order FROM range(10)")
def synthetic_allocation(spark, sf):
    """317 rows go to ten subjects evenly; the second subject writes times in the minority format; stamps rise."""
    rows = _made(spark, sf).withColumns({"o": F.monotonically_increasing_id(), "us": F.unix_micros(TS.parse_mixed(F.col("ts")))})
    step = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("o"))
    rows = rows.withColumns({"rises": F.coalesce(step >= 0, F.lit(True)), "template": TS.format_of(F.col("ts"))["template"]})
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("template").alias("template"), F.min("rises").alias("in_order"))


@query("""SELECT 317 AS n, true AS in_range, (SELECT count(*) FROM (SELECT event_type FROM events WHERE event_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)) AS kinds, true AS repeats""")
def synthetic_range(spark, sf):
    """Stamps lie in the disclosed months, categories are the disclosed ones, and a second run gives the same rows."""
    made, again = _made(spark, sf), _made(spark, sf)
    months = temporal.month_bounds(_events(spark, sf)).select("min_month", "max_month")
    month = F.date_format(TS.parse_mixed(F.col("ts")), "yyyy-MM")
    facts = made.join(F.broadcast(months)).agg(F.count(F.lit(1)).alias("n"), F.min(month.between(F.col("min_month"), F.col("max_month"))).alias("in_range"), F.countDistinct("event_type").alias("kinds"))
    other = made.exceptAll(again).agg((F.count(F.lit(1)) == 0).alias("repeats"))
    return facts.join(F.broadcast(other))


@query("""SELECT * FROM (VALUES ('histogram', true), ('categories', true), ('whole', true), ('number', true), ('seen_at', true), ('note', true), ('key', true)) AS t("column", "right")""")
def synthetic_values(spark, sf):
    """Each kind of column by what it may hold: bins by weight, categories, numbers, default times, fake tokens, ids."""
    bins = [{"lo": 0, "hi": 10, "count": 900}, {"lo": 10, "hi": 20, "count": 100}]
    columns = {"histogram": {"dtype": "int64", "histogram": bins}, "categories": {"dtype": "object", "categories": ["a", "b", "c"]}, "whole": {"dtype": "int64"}, "number": {"dtype": "float64"}, "seen_at": {"dtype": "object"}, "note": {"dtype": "object"}, "key": {"dtype": "object"}}
    made = synthesis.synthesize(spark, columns, 5000, 3, ("key",), synthesis.id_pool(20))
    share = F.avg((F.col("histogram") <= 10).cast("double"))
    right = {
        "histogram": (F.min("histogram") >= 0) & (F.max("histogram") <= 20) & share.between(0.87, 0.95), "categories": (F.countDistinct("categories") == 3) & (F.min("categories") == "a"),
        "whole": F.min("whole") >= 0, "number": F.max("number") <= 100, "seen_at": F.min(F.col("seen_at").rlike(r"^20(15|16|17|18|19|20)-\d\d-\d\dT\d\d:\d\d:\d\dZ$")),
        "note": F.min(F.col("note").rlike(r"^FAKE_note_\d{4}$")), "key": (F.countDistinct("key") == 20) & F.min(F.col("key").rlike(r"^SYNTH_00[01]\d$")),
    }
    one = made.agg(*(x.alias(c) for c, x in right.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("right")) for c in right))).alias("x")).select("x.*")


@query("SELECT * FROM (VALUES ('files', 2), ('rows', 120), ('joins', 1)) AS t(fact, n)")
def synthetic_joinable(spark, sf):
    """From a dictionary alone: data files get samples whose ids are of one pool, so they join; codebooks get none."""
    folder, store = new_folder(spark), Store(spark)
    columns = {"subject_id": {"dtype": "object"}, "v": {"dtype": "int64"}}
    files = {"a/x.csv": {"columns": columns}, "b/y.tsv": {"columns": columns}, "q.csv": {"columns": columns, "role": "codebook"}}
    store.write(join(folder, "dictionary.json"), json.dumps({"files": files, "sources": {}}))
    written = dictionary.synthesize_dictionary(spark, join(folder, "dictionary.json"), folder, n_rows=60)
    a, b = (spark.read.csv(join(folder, "synthetic_samples", n), header=True) for n in ("a/x.csv", "b/y.tsv"))
    facts = [("files", written), ("rows", a.count() + b.count()), ("joins", int(a.join(b, "subject_id").count() > 0))]
    return spark.createDataFrame(facts, "fact string, n long")
