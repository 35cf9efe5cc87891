"""MinHash near-dedup on fast similarity sketches: rounds of hashed bin placement fill every coordinate of a sketch
(first each element picks a bin, in the last rounds all elements go to one given bin), which keeps MinHash's unbiased
estimate with strong concentration at O(size + bins log bins) a document. Sketches are banded, and links are
confirmed on the full sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import common as C
from veilspark.llm.components import components

#: A pair at the threshold shares no band with a probability of at most MISS; at most so many bands are used.
MISS, MOST_BANDS = 1e-6, 48
#: Characters of text that are sketched together.
TOGETHER = 1_500_000

_U = np.uint64
np.seterr(over="ignore")
_MIX1, _MIX2, _ODD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows of a band: the most rows for which MOST_BANDS bands keep to MISS at the threshold."""
    s = percent / 100
    if s >= 1:
        return 1, 8
    best = (MOST_BANDS, 1)
    if math.log(MISS) / math.log(1 - s) > MOST_BANDS:
        raise ValueError(f"{MOST_BANDS} bands can't keep to MISS at {percent} per cent")
    for rows in range(1, 33):
        n = math.ceil(math.log(MISS) / math.log(1 - s**rows))
        if n > MOST_BANDS:
            break
        best = (n, rows)
    return best


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words (A-Z lower-cased, split at ASCII white space);
    of fewer words, one hash of all; of none, nothing."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = np.empty(sum(map(len, words)), object)
    at = 0
    for w in words:
        flat[at : at + len(w)] = w
        at += len(w)
    hashes = pd.util.hash_array(flat, categorize=False) if at else np.empty(0, _U)
    out, at = [], 0
    for w in words:
        h = hashes[at : at + len(w)]
        at += len(w)
        if len(h) < k:
            x = np.array([len(h)], _U)
            for y in h:
                x = _mix(x * _ODD + y)
            out.append(x if len(h) else np.empty(0, _U))
        else:
            n = len(h) - k + 1
            x = np.full(n, k, _U)
            for i in range(k):
                x = _mix(x * _ODD + h[i : i + n])
            out.append(np.unique(x))
    return out


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` coordinates for each set (none of them empty). A coordinate holds its round and the least
    hash that fell there in it; as later rounds only give greater values, a filled bin never changes."""
    n = len(sets)
    out = np.full(n * bins, _NONE)
    x, doc = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * bins):
        v = _mix(x + _U(i + 1) * _ODD)
        at = doc * bins + (((v >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64) if i < bins else doc * bins + (i - bins)
        np.minimum.at(out, at, (_U(i) << _U(48)) | (_mix(v) >> _U(16)))
        if i % 4 == 3 or i > bins:
            open_ = (out.reshape(n, bins) == _NONE).any(1)
            if not open_.any():
                break
            stay = open_[doc]
            if not stay.all():
                x, doc = x[stay], doc[stay]
    return out.reshape(n, bins)


def band_keys(rows: np.ndarray, bands: int, per: int) -> np.ndarray:
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(rows), bands))
    cut = rows[:, : bands * per].reshape(len(rows), bands, per)
    for i in range(per):
        x = _mix(x * _ODD + cut[:, :, i])
    return x.view(np.int64)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield start, i
            start, size = i, 0
        size += len(t) + 200
    if texts:
        yield start, len(texts)


def sketch_documents(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, digest (of the set; null if it is empty), keys (of its bands)."""
    bands, per = bands_for(percent)

    def run(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"n": [], "digest": [], "keys": []}
        for a, b in _groups(texts):
            sets = shingle_sets(texts[a:b], words)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(sketches(full, bands * per), bands, per) if full else [])
            for s in sets:
                out["n"].append(len(s))
                out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["keys"].append(next(keys) if len(s) else None)
        return out

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return C.map_text(docs, "text", fields, lambda: run, ["doc_id"], rows_at_once=1000)


def verify(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """pairs: a, b. texts: rep, text. Adds near, the similarity of the full sets as (both, all)."""
    a, b = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept: dict[str, np.ndarray] = {}
            both, every = [], []
            for x, y in zip(pdf["text_a"], pdf["text_b"], strict=True):
                if x not in kept:
                    if len(kept) > 200:
                        kept.clear()
                    kept[x] = shingle_sets([x], words)[0]
                sx, sy = kept[x], shingle_sets([y], words)[0]
                common = len(np.intersect1d(sx, sy, assume_unique=True))
                both.append(common)
                every.append(len(sx) + len(sy) - common)
            yield pd.DataFrame({"a": pdf["a"].array, "b": pdf["b"].array, "both": both, "every": every})

    return rows.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, both long, every long")


class _Linker:
    """Finds the links between sets and keeps the components they give so far."""

    def __init__(self, scratch: C.Scratch, words: int, percent: int) -> None:
        self.scratch, self.words, self.percent, self.made = scratch, words, percent, 0
        self.edges: list[DataFrame] = []
        self.of: DataFrame | None = None

    def put(self, df: DataFrame, what: str) -> tuple[DataFrame, int]:
        """The written table and its rows."""
        self.made += 1
        return self.scratch.put_counted(df, f"{what}-{self.made}")

    def test(self, pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame | None, int]:
        """Verifies pairs (a < b, one row each): their similarity (None if there are no pairs), and how many link."""
        pairs, n = self.put(pairs, "pairs")
        if not n:
            return None, 0
        self.made += 1
        seen, near = Observation(), F.col("both") * 100 >= F.col("every") * self.percent
        done = self.scratch.put(verify(pairs, texts, self.words).withColumn("near", near).observe(seen, F.count_if("near").alias("n")), f"tested-{self.made}")
        self.edges.append(done.filter("near").select("a", "b"))
        return done, seen.get["n"]

    def connect(self) -> None:
        """Components of all links found so far."""
        if self.edges:
            self.made += 1
            self.of = components(self.scratch, C.union_all(self.edges), f"components-{self.made}")

    def labelled(self, rows: DataFrame, rep: str = "rep", name: str = "component") -> DataFrame:
        """rows with the component of ``rep`` so far."""
        if self.of is None:
            return rows.withColumn(name, F.col(rep))
        own = self.of.select(F.col("node").alias(rep), F.col("component").alias(name)).hint("merge")
        return rows.join(own, rep, "left").withColumn(name, F.coalesce(name, rep))

    def mixed(self, rows: DataFrame) -> DataFrame:
        """Those of the buckets that hold several components."""
        keys = rows.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h").select("key")
        return rows.join(keys.hint("merge"), "key", "left_semi")

    def link(self, members: DataFrame, texts: DataFrame, n_members: int) -> None:
        """members: key (of a bucket), rep, n; n_members rows. texts: rep, text. A bucket of a thousandth of all members
        or more meets its centre and its pivot in the tasks its members are in; partitions of other joins that grow
        far beyond the others, as one text in very many pairs can make them, are split by Spark (adaptive skew joins).

        First each bucket's smallest member meets all others, which settles most groups of copies of any size with
        one pair a member and bucket. Buckets with members that aren't linked with it go on. Of each member x, u
        counts the shingles that no other member of these buckets has. The member p with the least u, which edits
        changed least, is the bucket's pivot and meets all others, which gives d(x), the size of the symmetric
        difference of x and p. As x's own shingles aren't in y, at most d(x) - u(x) elements of x's difference are in
        y's; and what both lost of p is at most what either lost, what both gained at most what either gained but for
        its own. This bounds the part s that the differences share, and x and y differ in d(x) + d(y) - 2 s elements
        or more; but a link allows only (100 - percent) / (100 + percent) of the sum of their sizes. So no link is
        lost if only those pairs between components are verified that the bound allows. The greatest d - 2 u of a
        bucket tells beforehand which members can be in one."""
        centres = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count(F.lit(1)).alias("m")).filter("m > 1")
        centres, _ = self.put(centres.select("key", F.col("c.rep").alias("a"), F.col("c.n").alias("na"), "m"), "centres")
        met = C.join_hot(members, centres, "key", F.col("m") >= C.HOT_SHARE * n_members, "inner").drop("m")
        met, n = self.put(met, "met")
        if not n:
            return
        texts, _ = self.put(texts.join(met.select("rep").distinct().hint("merge"), "rep", "left_semi"), "texts")
        close = F.least("n", "na") * 100 >= F.greatest("n", "na") * self.percent
        done, _ = self.test(met.filter((F.col("rep") != F.col("a")) & close).select("a", F.col("rep").alias("b")).distinct(), texts)
        left = met.withColumn("near", F.col("rep") == F.col("a"))
        if done is not None:
            direct = done.filter("near").select("a", F.col("b").alias("rep"), F.lit(True).alias("linked"))
            left = met.join(direct.hint("merge"), ["a", "rep"], "left").withColumn("near", F.col("linked") | (F.col("rep") == F.col("a")))
        apart = left.groupBy("key").agg(F.count_if(F.coalesce("near", F.lit(False))).alias("k"), F.count(F.lit(1)).alias("m")).filter("k < m").select("key")
        left, n = self.put(left.join(apart.hint("merge"), "key", "left_semi").select("key", "rep", "n"), "apart")
        if not n:
            return self.connect()
        own = own_shingles(texts.join(left.select("rep").distinct().hint("merge"), "rep", "left_semi"), self.words)
        left = left.join(own.hint("merge"), "rep", "left").withColumn("u", F.coalesce("u", F.lit(0)))
        left, _ = self.put(left, "own")
        pivots = left.groupBy("key").agg(F.min(F.struct("u", "rep", "n")).alias("p"), F.count(F.lit(1)).alias("m"))
        pivots, _ = self.put(pivots.select("key", F.col("p.rep").alias("p"), F.col("p.n").alias("np"), "m"), "pivot")
        left, _ = self.put(C.join_hot(left, pivots, "key", F.col("m") >= C.HOT_SHARE * n, "inner").drop("m").withColumns({"a": F.least("p", "rep"), "b": F.greatest("p", "rep")}), "pivots")
        done, _ = self.test(left.filter("a <> b").select("a", "b").distinct(), texts)
        self.connect()
        left = self.mixed(self.labelled(left)).join(done.hint("merge"), ["a", "b"])
        lost, gained = F.col("np") - F.col("both"), F.col("n") - F.col("both") - F.col("u")
        left = left.select("key", "rep", "n", "u", (F.col("every") - F.col("both")).alias("d"), lost.alias("lost"), gained.alias("gained"), "p", "component")
        left, n = self.put(self.labelled(left, "p", "centre"), "far")
        if not n:
            return
        less, more = 100 - self.percent, 100 + self.percent
        most = left.groupBy("key").agg(F.max(F.col("d") - 2 * F.col("u")).alias("most"))
        hope = (F.col("component") != F.col("centre")) & ((F.col("d") - F.col("most")) * more * self.percent <= less * more * F.col("n"))
        keys = left.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # a set is in one bucket a band
        left, _ = self.put(left.join(keys.hint("merge"), "rep"), "left")
        few = left.join(most.hint("merge"), "key").filter(hope)
        few, n = self.put(few.select("key", *(F.col(c).alias(f"{c}_y") for c in ("rep", "n", "u", "d", "lost", "gained", "component", "keys"))), "few")
        if not n:
            return
        d, dy = F.col("d"), F.col("d_y")
        shared = F.least(F.least("lost", "lost_y") + F.least("gained", "gained_y"), d - F.col("u"), dy - F.col("u_y"))
        allowed = (F.col("component_y") != F.col("component")) & (F.greatest(d + dy - 2 * shared, F.col("u") + F.col("u_y")) * more <= less * (F.col("n") + F.col("n_y")))
        # a pair is in several buckets; the first that both have stands for all
        once = F.array_min(F.array_intersect("keys", "keys_y")) == left["key"]
        pairs = left.join(few.hint("merge"), (left["key"] == few["key"]) & allowed & once).select(F.least("rep", "rep_y").alias("a"), F.greatest("rep", "rep_y").alias("b"))
        if self.test(pairs.distinct(), texts)[1]:
            self.connect()


def own_shingles(texts: DataFrame, words: int) -> DataFrame:
    """rep, u: how many shingles of a set no other of these sets has (absent: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                sets = shingle_sets(part.column("text").to_pylist(), words)
                reps = np.repeat(part.column("rep").to_numpy(), [len(s) for s in sets])
                if len(reps):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(reps)], ["s", "rep"])

    once = texts.select("rep", "text").mapInArrow(run, "s long, rep long").groupBy("s").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).filter("rep = other")
    return once.groupBy("rep").agg(F.count(F.lit(1)).alias("u"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct runs of ``words`` words, or all its words if they are fewer; documents are
    linked if 100 * common >= percent * all. component_id is the smallest doc_id reached by links; kept says whether
    it is the document's own. A set is held as 64-bit hashes of its shingles.

    Null, empty or white-space text: an empty set, linked with nothing, kept. Null doc_id: never linked; component_id
    is null and kept true. Rows that repeat an id are one document, linked with whatever any of them is. Repeated
    rows: the same answer for each. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "near-dedup")
    rows, n = scratch.put_counted(sketch_documents(docs, words, percent), "sketches")
    whole = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    sets = scratch.put(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")), "sets")
    # the rows that stand for the sets, with their band keys
    reps = rows.select(F.col("doc_id").alias("rep"), "digest", "n", "keys").join(sets.select("rep", "digest").hint("merge"), ["rep", "digest"], "left_semi").dropDuplicates(["rep", "digest"])
    reps, n_reps = scratch.put_counted(reps.select("rep", "n", "keys"), "reps")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text")).filter("rep IS NOT NULL")
    linker = _Linker(scratch, words, percent)
    linker.link(reps.select(F.explode("keys").alias("key"), "rep", "n"), texts, n_reps * bands_for(percent)[0])
    labelled = scratch.put(linker.labelled(sets.select("digest", "rep", "copies")), "labelled").select("digest", "component", "copies")
    scratch.keep("sketches", "labelled")
    slim = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    found = C.join_hot(slim.filter("digest IS NOT NULL"), labelled, "digest", F.col("copies") >= C.HOT_SHARE * n, "inner").select("doc_id", "n", "component")
    out = found.unionByName(slim.filter("digest IS NULL").select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that near_duplicates() does not keep; columns may have any name.

    Null, empty and white-space texts, null ids: kept. Rows that repeat an id are one document, all kept or none. An
    empty table gives no rows.
    """
    gone = near_duplicates(docs, words, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), words=3, percent=85)
