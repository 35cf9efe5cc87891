"""Quality rules with host verdicts: rules are tried on every document, their failures are added up by host, the hosts'
rates are shrunk towards an empirical beta prior, and hosts that fail too often take their documents with them.
DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import common as C

#: A document of fewer words fails, as does one with a greater share (in per cent) of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules that only count against the host: symbols a hundred words, repeated lines in per cent, code points a word on average.
MOST_SYMBOLS, MOST_DUP_LINES, LONGEST_MEAN_WORD = 10, 30, 40
#: A host is rejected if its shrunk rate of failure by any rule exceeds this.
HOST_LIMIT = 0.75
#: What the prior weighs at least and at most, in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1000.0
#: Words of a window.
WINDOW = 3


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with words, windows and lines of the text counted: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words. Windows are compared by 64-bit hashes within one text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, f"{C.SPACE_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.rtrim(x, F.lit(C.SPACE_CHARS)) != "")
    # each array is a column of its own that later steps read more than once, so Spark computes it once a row
    out = docs.withColumn("_words", words).withColumn("_lines", lines)
    after = lambda i: F.get("_words", i)
    windows = F.transform(F.col("_words"), lambda w, i: F.struct(F.xxhash64(w, after(i + 1), after(i + 2)).alias("h"), i.alias("at")))
    n = F.size("_words")
    out = out.withColumn("_windows", F.sort_array(F.slice(windows, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))))
    # neighbours in the order of hashes that are alike are windows found again; both count
    pairs = F.zip_with(
        F.col("_windows"),
        F.slice("_windows", 2, F.greatest(F.size("_windows") - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.sort_array(F.flatten(F.slice(pairs, 1, F.greatest(F.size("_windows") - 1, F.lit(0)))))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, at: F.struct(at.alias("last"), (a["n"] + F.least(F.lit(WINDOW), at - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        n.cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


#: When a document fails, by rule, in SQL. The first two reject the document itself; all count against its host.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": f"100 * n_symbols > {MOST_SYMBOLS} * n_words",
    "dup_lines": f"100 * n_dup_lines > {MOST_DUP_LINES} * n_lines",
    "long_words": f"word_chars > {LONGEST_MEAN_WORD} * n_words",
}
BASE = ("few_words", "repeated_words")


def host_verdicts(rows: DataFrame, names: list[str], limit: float = HOST_LIMIT) -> DataFrame:
    """rows: host and a boolean for each rule. One row a host: host, n, the shrunk rate of failure by each rule, and
    host_failed.

    The prior of a rule is a beta distribution fitted to all hosts by moments: its mean is the share of all documents
    that fail; its weight comes from how much more the hosts' rates vary than chance would have them. Where that can't
    be told (one host, or rates that vary no more than by chance) the prior weighs the most."""
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(r)).alias(f"f_{r}") for r in names))
    n = F.col("n").cast("double")
    sums = [F.count(F.lit(1)).cast("double").alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares")]
    for r in names:
        sums += [F.sum(F.col(f"f_{r}").cast("double")).alias(f"s_{r}"), F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / n).alias(f"q_{r}")]
    priors = []
    for r in names:
        mean = F.col(f"s_{r}") / F.col("docs")
        chance = mean * (1 - mean)
        spread = F.col(f"q_{r}") - F.col(f"s_{r}") * mean
        room = chance * (F.col("docs") - F.col("squares") / F.col("docs") - (F.col("hosts") - 1))
        alike = F.when(room > 0, (spread - chance * (F.col("hosts") - 1)) / room)
        weight = F.when(alike > 0, F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(MOST_PRIOR), 1 / alike - 1))).otherwise(F.lit(MOST_PRIOR))
        priors += [mean.alias(f"m_{r}"), weight.alias(f"w_{r}")]
    prior = counts.agg(*sums).select(*priors).first()  # one row, whatever the number of hosts
    shrunk = []
    for r in names:
        mean, weight = (F.lit(prior[f"{x}_{r}"]).cast("double") for x in "mw")
        shrunk.append(((F.col(f"f_{r}") + mean * weight) / (n + weight)).alias(f"rate_{r}"))
    hosts = counts.select("host", "n", *shrunk)
    return hosts.withColumn("host_failed", reduce(lambda a, b: a | b, (F.col(f"rate_{r}") > limit for r in names)))


def apply_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    base_failed, host_failed, kept.

    A document fails by itself with too few words or too many in repeated windows; kept are those that don't, and
    whose host doesn't fail either.

    Null or empty text: no words, so it fails. Null host: a host of its own. Null doc_id and repeated rows: rows like
    any other, each counted for its host. Very long texts are measured whole, in one task each. An empty table gives
    no rows; other columns, whatever their names, are left out. Ties don't occur: a rate equal to the limit passes.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "quality-rules")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.when(F.col(host).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(host).cast("string"))).alias("host"),
    )
    tried = measured(rows).drop("text")
    tried, n = scratch.put_counted(tried.select("*", *(F.expr(c).alias(f"fails_{r}") for r, c in RULES.items())), "measured")
    verdicts = host_verdicts(tried.select("host", *(F.col(f"fails_{r}").alias(r) for r in RULES)), list(RULES), limit)
    verdicts = scratch.put(verdicts, "hosts")
    base = reduce(lambda a, b: a | b, (F.col(f"fails_{r}") for r in BASE))
    out = C.join_hot(tried, verdicts.select("host", "host_failed", F.col("n").alias("of_host")), "host", F.col("of_host") >= C.HOT_SHARE * n, "inner")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "host_failed", (~base & ~F.col("host_failed")).alias("kept"),
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(C.table(spark, sf_dir, "documents"))


def _sql() -> str:
    names, space = list(RULES), r"[\x20\x09-\x0D]"
    alike = lambda r: f"(q_{r} - s_{r} * s_{r} / docs - s_{r} / docs * (1 - s_{r} / docs) * (hosts - 1)) / nullif(s_{r} / docs * (1 - s_{r} / docs) * (docs - squares / docs - (hosts - 1)), 0)"
    room = lambda r: f"s_{r} / docs * (1 - s_{r} / docs) * (docs - squares / docs - (hosts - 1))"
    weight = lambda r: f"CASE WHEN {room(r)} > 0 AND {alike(r)} > 0 THEN greatest({LEAST_PRIOR}, least({MOST_PRIOR}, 1 / {alike(r)} - 1)) ELSE {MOST_PRIOR} END"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT row, list_filter(regexp_split_to_array(text, '{space}+'), lambda w: w <> '') AS ws FROM t)),
windows AS (SELECT row, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS three FROM words WINDOW p AS (PARTITION BY row ORDER BY i)),
found AS (SELECT row, i, three IS NOT NULL AND count(*) OVER (PARTITION BY row, three) > 1 AS again FROM windows),
covered AS (SELECT row, i, bool_or(again) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again FROM found),
by_word AS (SELECT row, count(*) AS n_words, count_if(again) AS n_repeat_words FROM covered GROUP BY row),
chars AS (SELECT row, sum(length(w)) AS word_chars FROM words GROUP BY row),
lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (SELECT row, doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN by_word USING (row) LEFT JOIN chars USING (row) LEFT JOIN lines USING (row)),
f AS (SELECT *, {", ".join(f"{c} AS {r}" for r, c in RULES.items())} FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"count_if({r})::DOUBLE AS f_{r}" for r in names)} FROM f GROUP BY source),
sums AS (SELECT count(*)::DOUBLE AS hosts, sum(n) AS docs, sum(n * n) AS squares, {", ".join(f"sum(f_{r}) AS s_{r}, sum(f_{r} * f_{r} / n) AS q_{r}" for r in names)} FROM hosts),
prior AS (SELECT {", ".join(f"s_{r} / docs AS m_{r}, {weight(r)} AS w_{r}" for r in names)} FROM sums),
verdicts AS (SELECT source, {" OR ".join(f"(f_{r} + m_{r} * w_{r}) / (n + w_{r}) > {HOST_LIMIT}" for r in names)} AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, few_words OR repeated_words AS base_failed, host_failed,
  NOT (few_words OR repeated_words) AND NOT host_failed AS kept
FROM f JOIN verdicts ON f.source IS NOT DISTINCT FROM verdicts.source
"""


OP11_SQL = _sql()
