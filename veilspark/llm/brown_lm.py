"""LM scoring by a Brown class-based bigram model: exchange clustering puts words into classes; a text's probability
is that of its class transitions and of each word in its class, both smoothed."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import common as C

#: The end of a text, counted as a token; no word, as it holds white space.
END = b" "
#: Least number of words that are exchanged one by one to begin with, buckets by ending (twice so many: with and without
#: punctuation) that stand for all other words meanwhile and later for unseen ones, least number of classes, and sweeps;
#: sweeps over every training word, in which tasks exchange their words at once. The first words and the classes grow
#: with the cube root of the distinct words beyond DISTINCT.
CLUSTERED, ENDINGS, CLASSES, SWEEPS, SWEEPS_OF_ALL = 2048, 256, 64, 4, 1
#: Counts up to which gains are looked up.
TABLED = 48
DISTINCT = 262_144
#: Most frequent words whose counts every task holds; the others' are joined.
HELD = 131_072
#: Added to counts of words, and weight of the class's own frequency in a transition.
ADDED, TRANSITION_PRIOR = 0.1, 20.0
#: Distinct words that a task counts, or remembers, at a time, bytes of words, and pairs of a word and a class beside it.
AT_ONCE, BYTES_AT_ONCE, PAIRS_AT_ONCE = 300_000, 1 << 28, 4_000_000

_PUNCTUATION = b".,;:!?"


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def bucket(word: bytes) -> int:
    """The bucket of a word's last three bytes, apart if punctuation follows them."""
    bare = word.rstrip(_PUNCTUATION)
    return zlib.crc32(bare[-3:]) % ENDINGS + (ENDINGS if len(bare) < len(word) else 0)


@dataclass
class Classes:
    """A model without the words that aren't held. Units are held words, then buckets, then the end of a text."""

    words: list[bytes]
    counts: np.ndarray
    #: Natural numbers of all training tokens, of distinct ones, and for each class.
    total: int
    distinct: int
    of_unit: np.ndarray
    #: log10 of P(class | class before), and of a class's denominator.
    transitions: np.ndarray
    below: np.ndarray
    #: What the classes make of a training token's log likelihood before each sweep over all words, and after the last.
    likelihoods: list[float] = field(default_factory=list)

    @property
    def base_below(self) -> float:
        return math.log10(self.total + ADDED * (self.distinct + 1))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts in a row, and how many each has; null counts as empty."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    lists = pc.ascii_split_whitespace(bare)
    words, n, some = lists.flatten(), np.diff(lists.offsets.to_numpy()), pc.binary_length(bare).to_numpy() > 0
    return (words if some.all() else words.filter(pc.greater(pc.binary_length(words), 0))).view(pa.binary()), np.where(some, n, 0)


#: The step of crc32 by a byte.
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


def buckets_of(words: pa.Array) -> np.ndarray:
    """The bucket of each word."""
    bare = pc.ascii_rtrim(words.view(pa.string()), _PUNCTUATION.decode())
    length, data = pc.binary_length(bare).to_numpy(), np.frombuffer(bare.buffers()[2] or b"", np.uint8)
    end, crc = np.frombuffer(bare.buffers()[1], np.int32)[bare.offset + 1 : bare.offset + 1 + len(bare)], np.full(len(bare), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        at = np.flatnonzero(length >= back)
        crc[at] = _CRC[(crc[at] ^ data[end[at] - back]) & 0xFF] ^ (crc[at] >> 8)
    return ((~crc) % ENDINGS + np.where(length < pc.binary_length(words).to_numpy(), ENDINGS, 0)).astype(np.int32)


def count_words(train: DataFrame) -> DataFrame:
    """word, c over all texts; tasks sum what they can hold before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[pa.RecordBatch]) -> pa.Table:
            return pa.Table.from_batches(parts).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks()

        parts, rows, texts = [], 0, 0
        for batch in batches:
            texts += batch.num_rows
            for i in range(0, batch.num_rows, 1000):
                found = cut(batch.column(0).slice(i, 1000))[0].value_counts()
                parts.append(pa.RecordBatch.from_arrays(found.flatten(), ["word", "c"]))
                rows += len(found)
                if rows > 2 * AT_ONCE or sum(x.nbytes for x in parts) > BYTES_AT_ONCE:
                    parts = summed(parts).to_batches()
                    rows = sum(map(len, parts))
                    if rows > AT_ONCE or sum(x.nbytes for x in parts) > BYTES_AT_ONCE // 2:
                        yield from parts
                        parts, rows = [], 0
        if parts:
            yield from summed(parts).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], ["word", "c"])

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def grown(least: int, distinct: int) -> int:
    return round(least * max(1.0, distinct / DISTINCT) ** (1 / 3))


def _sum(at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct natural keys in order, and the sums of their natural numbers."""
    if not len(at):
        return at, k
    bits = int(k.max()).bit_length()
    if int(at.max()).bit_length() + bits < 64:
        both = np.sort(at.astype(np.int64) << bits | k)  # plain numbers are sorted many times faster than by an index
        keys, k = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(at)
        keys, k = at[order], k[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(k, first)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A row's numbers as 32-bit ones in a binary: Spark moves it as one cell, not number by number."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows in a row, and where rows begin and the last one ends. No row is null."""
    column = column.cast(pa.binary())  # sessions may have larger offsets
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    return np.frombuffer(data or b"", np.int32, ends[-1])[ends[0] :], ends - ends[0]


_ENCODED = "doc_id long, scored boolean, trained boolean, rid long, n_tokens long, n_held long, logs double, path binary, rare binary, times binary, bucket binary"


def encode(rows: DataFrame, words: list[bytes], counts: np.ndarray) -> DataFrame:
    """Each row's tokens as places among ``words`` (the held ones, the end last), or -1 - i for its i-th other word;
    those words, with a space between them, with their counts and buckets; and what the held words' own counts give.
    Texts are cut into words here for the last time: all that follows reads numbers."""
    shared = rows.sparkSession.sparkContext.broadcast((words, np.log10(counts + ADDED), counts > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs, seen = shared.value
        end, held = len(words) - 1, pa.array(words, pa.binary())
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                own, n = cut(part.column("text"))
                at = pc.index_in(own, value_set=held).fill_null(-1).to_numpy().copy()
                of_text, texts = np.repeat(np.arange(len(n)), n), len(n)
                known = at >= 0
                n_held = np.bincount(of_text, known & seen[at], texts) + seen[end]
                own_logs = np.bincount(of_text, np.where(known, logs[at], 0.0), texts) + logs[end]
                where = np.flatnonzero(~known)
                others = own.take(pa.array(where)).dictionary_encode()
                kinds = max(len(others.dictionary), 1)
                key, nth, times = np.unique(of_text[where] * kinds + others.indices.to_numpy(), return_inverse=True, return_counts=True)
                first = np.searchsorted(key, np.arange(texts + 1) * kinds)
                at[where] = first[of_text[where]] - 1 - nth
                path = np.full(len(at) + texts, end, np.int32)
                path[np.arange(len(at)) + of_text] = at
                rare = pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), others.dictionary.take(pa.array(key % kinds))), b" ")
                lists = (_packed(path, np.append(0, np.cumsum(n + 1))), pc.if_else(pa.array(np.diff(first) > 0), rare, None), _packed(times, first), _packed(buckets_of(others.dictionary)[key % kinds], first))
                numbers = (pa.array(np.arange(row, row + texts) + (task << 40)), pa.array(n + 1, pa.int64()), pa.array(n_held.astype(np.int64)), pa.array(own_logs))
                row += texts
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("doc_id", "scored", "trained")), *numbers, *lists], ["doc_id", "scored", "trained", "rid", "n_tokens", "n_held", "logs", "path", "rare", "times", "bucket"])

    return rows.select("doc_id", "text", "scored", "trained").mapInArrow(run, _ENCODED)


def _rare(batch: pa.RecordBatch) -> pa.Array:
    """All texts' words that aren't held in a row."""
    return pc.split_pattern(batch.column("rare").cast(pa.binary()).view(pa.string()), " ").flatten().view(pa.binary())


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all texts in a row, each text's ending with the end; which of the other words a token under 0 is; and
    those words' buckets."""
    (flat, ends), (buckets, begin) = _unpacked(batch.column("path")), _unpacked(batch.column("bucket"))
    return flat, np.where(flat < 0, np.repeat(begin[:-1], np.diff(ends)) - 1 - flat, 0), buckets


def count_pairs(encoded: DataFrame, of_word: np.ndarray, of_bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often a unit follows another, for those that do; before a text's first token stands an end. There are n units:
    of_word has the held words' and, as the last one, the end's; of_bucket has those of the other words by bucket."""
    shared = encoded.sparkSession.sparkContext.broadcast((of_word, of_bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of_word, of_bucket), pairs, times, size = shared.value, [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                flat, which, buckets = _flat(batch.slice(i, 1000))
                own = of_word[np.maximum(flat, 0)]
                if len(buckets):
                    own = np.where(flat < 0, of_bucket[buckets][which], own)
                at, k = np.unique(np.append(n - 1, own[:-1]) * n + own, return_counts=True)
                pairs.append(at)
                times.append(k)
                size += len(at)
                if size > 3_000_000:
                    at, k = _sum(np.concatenate(pairs), np.concatenate(times))
                    pairs, times, size = [at], [k], len(at)
                    if size > 1_500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(k, pa.int64())], ["pair", "n"])
                        pairs, times, size = [], [], 0
        if pairs:
            at, k = _sum(np.concatenate(pairs), np.concatenate(times))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(k, pa.int64())], ["pair", "n"])

    got = encoded.select("path", "bucket").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, k = got.column("pair").to_numpy(), got.column("n").to_numpy().astype(float)
    return (pair // n).astype(np.int32), (pair % n).astype(np.int32), k


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(grid: np.ndarray) -> float:
    """What the classes make of the log likelihood of a token, by their bigrams; the rest is the same for any classes."""
    return float((_f(grid).sum() - _f(grid.sum(0)).sum() - _f(grid.sum(1)).sum()) / max(grid.sum(), 1))


def sweep(encoded: DataFrame, words: list[bytes], class_of: np.ndarray, bucket_class: np.ndarray, classes: int, scratch: C.Scratch, name: str, grid: np.ndarray | None = None) -> tuple[DataFrame, float]:
    """word, c, class of every training word, written under name: one exchange of all words, each given the classes of
    all others before the sweep; and the likelihood by those classes. class_of holds the classes of ``words``,
    bucket_class those that the other words count as, grid (counted, if not given) how often a class follows another. A
    word's counts of the classes after and before it are summed up by word; it is taken out of its own class and put
    where it raises the likelihood of the class bigrams most. The last class is the end's alone."""
    if grid is None:
        a, b, k = count_pairs(encoded, class_of, bucket_class, classes)
        grid = np.bincount(a * classes + b, k, classes * classes).reshape(classes, classes)
    shared = encoded.sparkSession.sparkContext.broadcast((words, class_of, bucket_class))
    end, held_words = classes - 1, len(words)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, class_of, bucket_class = shared.value
        class_of, bucket_class = class_of.astype(np.int32), bucket_class.astype(np.int32)
        words, none = pa.array(words, pa.binary()), np.zeros(0, np.int64)
        # words met beyond the held ones, what they and the held ones have met, and what is yet to be added to that
        met, keys, times = words.slice(0, 0), none, none
        raw, rares, size, others, bytes_ = [], [], 0, 0, 0

        def add() -> None:
            nonlocal met, keys, times, raw, rares, size, others, bytes_
            all_met = pa.concat_arrays([met, *rares]).dictionary_encode()
            met = all_met.dictionary
            number = np.append(np.arange(held_words), held_words + all_met.indices.to_numpy())
            new = [number[ids] * (2 * classes) + code for ids, after, before in raw for code in (after, before)]
            keys, times = _sum(np.concatenate([keys, *new]), np.append(times, np.ones(sum(map(len, new)), np.int64)))
            raw, rares, size, others, bytes_ = [], [], 0, 0, 0

        def rows() -> pa.RecordBatch:
            own, code = np.divmod(keys, 2 * classes)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            own, ends = own[first], 2 * np.append(first, len(own))
            kinds = np.append(class_of, bucket_class[buckets_of(met)])[own]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([words, met]).take(pa.array(own)), pa.array(kinds, pa.int32()), _packed(np.stack([code, times], 1), ends)], ["word", "own", "cells"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                flat, which, buckets = _flat(part)
                kinds, ids = class_of[np.maximum(flat, 0)], flat
                if len(buckets):
                    rares.append(_rare(part))
                    other = flat < 0
                    kinds = np.where(other, bucket_class[buckets][which], kinds)
                    ids = np.where(other, (held_words + len(met) + others + which).astype(np.int32), ids)
                    others += len(buckets)
                    bytes_ += rares[-1].nbytes
                where = np.flatnonzero(flat != held_words - 1)
                raw.append((ids[where], kinds[where + 1], classes + np.append(np.int32(end), kinds[:-1])[where]))
                size += 2 * len(where)
                if size > PAIRS_AT_ONCE or bytes_ > BYTES_AT_ONCE:
                    add()
                    if len(keys) > PAIRS_AT_ONCE // 2 or len(met) > AT_ONCE or met.nbytes > BYTES_AT_ONCE:
                        yield rows()
                        met, keys, times = words.slice(0, 0), none, none
        if raw:
            add()
        if len(keys):
            yield rows()

    held = encoded.sparkSession.sparkContext.broadcast(grid)

    f = _f

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = held.value
        both, after, before = np.concatenate([grid.T, grid]), grid.sum(1), grid.sum(0)
        # what n more in a cell gain, and what the last n of it gained
        steps = np.arange(TABLED + 1)[:, None, None]
        gained, lost = f(both + steps) - f(both), f(both) - f(np.maximum(both - steps, 0.0))
        steps = steps[:, :, 0]
        totals = [(x, f(x + steps) - f(x), f(x) - f(np.maximum(x - steps, 0.0))) for x in (after, before)]

        def done(t: pa.RecordBatch) -> pa.RecordBatch:
            word = t.column("word")
            new = np.ones(len(word), bool)
            new[1:] = pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)
            of_row = np.cumsum(new) - 1
            cells, ends = _unpacked(t.column("cells"))
            key, n = _sum(np.repeat(of_row, np.diff(ends) // 2) * (2 * classes) + cells[::2], cells[1::2].astype(np.int64))
            own, code = key // (2 * classes), key % (2 * classes)
            first = np.searchsorted(own, np.arange(of_row[-1] + 2))
            start = t.column("own").to_numpy()[np.flatnonzero(new)].astype(np.int64)
            best, c = np.zeros(len(first) - 1, np.int32), np.bincount(own, n * (code >= classes), len(first) - 1)
            for i in range(0, len(best), 500):
                j = min(i + 500, len(best))
                part = slice(first[i], first[j])
                times, at, home = n[part], code[part], start[own[part]]
                few = np.minimum(times, TABLED)
                one, rows = gained[few, at], np.arange(len(at))
                one[rows, home] = lost[few, at, home]  # the word's own class without it
                if len(many := np.flatnonzero(times > TABLED)):
                    rest = both[at[many]]
                    rest[np.arange(len(many)), home[many]] -= times[many]
                    rest = np.maximum(rest, 0.0)
                    one[many] = f(rest + times[many, None]) - f(rest)
                gain = np.add.reduceat(one, first[i:j] - first[i])
                some, own_class, rows = c[i:j].astype(np.int64), start[i:j], np.arange(j - i)
                few, many = np.minimum(some, TABLED), np.flatnonzero(some > TABLED)
                for total, more, less in totals:
                    one = more[few]
                    one[rows, own_class] = less[few, own_class]
                    if len(many):
                        rest = np.repeat(total[None], len(many), 0)
                        rest[np.arange(len(many)), own_class[many]] -= some[many]
                        one[many] = f(rest + some[many, None]) - f(rest)
                    gain -= one
                best[i:j] = np.argmax(gain[:, :-1], 1)
            at = np.flatnonzero(new)
            return pa.RecordBatch.from_arrays([word.take(pa.array(at)), pa.array(c.astype(np.int64)), pa.array(best)], ["word", "c", "class"])

        left: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch if left is None else pa.concat_batches([left, batch])
            word, n = t.column("word"), t.num_rows
            k = n - 1
            while k and word[k - 1] == word[n - 1]:
                k -= 1
            left = t.slice(k)
            if k:
                yield done(t.slice(0, k))
        if left is not None:
            yield done(left)

    found = encoded.select("path", "rare", "bucket").mapInArrow(meet, "word binary, own int, cells binary")
    return scratch.put(found.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word binary, c long, class int"), name), likelihood(grid)


def exchange(a: np.ndarray, b: np.ndarray, k: np.ndarray, units: int, classes: int, sweeps: int) -> np.ndarray:
    """Classes of the units by exchange: unit after unit moves to the class that raises the likelihood of the class
    bigrams most, given all others, until a sweep moves hardly any. The last unit keeps a class of its own."""
    weight = np.bincount(a, k, units) + np.bincount(b, k, units)
    of = np.full(units, classes - 1)
    of[np.argsort(-weight, kind="stable")] = np.arange(units) % (classes - 1)
    of[-1] = classes - 1
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    from_a, from_b = np.searchsorted(a[order_a], np.arange(units + 1)), np.searchsorted(b[order_b], np.arange(units + 1))
    after, after_k, before, before_k = b[order_a], k[order_a], a[order_b], k[order_b]
    del order_a, order_b
    grid = np.bincount(of[a] * classes + of[b], k, classes * classes).reshape(classes, classes)

    f = _f
    for _ in range(sweeps):
        moved = 0
        for u in np.argsort(-weight[:-1], kind="stable"):
            if not weight[u]:
                break
            ra, rb = slice(from_a[u], from_a[u + 1]), slice(from_b[u], from_b[u + 1])
            own = of[u]
            right = np.bincount(of[after[ra]], after_k[ra], classes)
            left = np.bincount(of[before[rb]], before_k[rb], classes)
            grid[own] -= right
            grid[:, own] -= left
            rows, cols = grid.sum(1), grid.sum(0)
            gain = (f(grid + right) - f(grid)).sum(1) + (f(grid.T + left) - f(grid.T)).sum(1) - (f(rows + right.sum()) - f(rows)) - (f(cols + left.sum()) - f(cols))
            best = int(np.argmax(gain[:-1]))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            of[u] = best
            moved += best != own
            grid[best] += right
            grid[:, best] += left
        if moved < units / 500:
            break
    return of


def _learn(rows: DataFrame, scratch: C.Scratch, classes: int | None = None, sweeps: int = SWEEPS) -> tuple[Classes, DataFrame, DataFrame]:
    """rows: doc_id, text, scored, trained. The model, the counts and classes of all training words (word, c, class),
    and all rows as sequences of classes."""
    vocabulary = scratch.put(count_words(rows.filter("trained")), "vocabulary")
    row = vocabulary.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = int(row.total or 0), int(row.distinct or 0)
    classes = classes or grown(CLASSES, distinct)
    ends = vocabulary.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    held = vocabulary.filter(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(HELD - 1).select("word", "c").toArrow()
    words, counts = [*held.column("word").to_pylist(), END], np.append(held.column("c").to_numpy().astype(float), ends)
    scratch.drop("vocabulary")
    encoded = scratch.put(encode(rows, words, counts), "encoded")
    train = encoded.filter("trained")
    core = min(grown(CLUSTERED, distinct), len(words) - 1)
    units = core + 2 * ENDINGS + 1
    # first words stand for themselves, the others for their buckets, which come after the first words
    unit_of = np.array([*range(core), *(core + buckets_of(pa.array(words[core:-1], pa.binary()))), units - 1])
    a, b, k = count_pairs(train, unit_of, np.arange(core, units - 1), units)
    of = exchange(a, b, k, units, classes, sweeps)
    bucket_class, class_of = of[core:-1], of[unit_of]
    grid = np.bincount(of[a] * classes + of[b], k, classes * classes).reshape(classes, classes)
    del a, b, k
    likelihoods = []
    for i in range(SWEEPS_OF_ALL):
        every, now = sweep(train, words, class_of, bucket_class, classes, scratch, f"every-{i}", grid)
        grid = None
        likelihoods.append(now)
        frequent = every.orderBy(F.desc("c"), "word").limit(HELD - 1).select("word", "class").toArrow()
        found = dict(zip(frequent.column("word").to_pylist(), frequent.column("class").to_pylist(), strict=True))
        class_of = np.array([*(found[w] for w in words[:-1]), classes - 1])
        scratch.drop(f"every-{i - 1}")
    in_class, kinds = np.zeros(classes), np.zeros(classes)
    for r in every.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        in_class[r["class"]], kinds[r["class"]] = r.c, r.n
    in_class[-1] += ends
    kinds[-1] += ends > 0
    of_unit = np.array([*class_of[:-1], *bucket_class, classes - 1])
    model = Classes(words, counts, total, distinct, of_unit, np.zeros((classes, classes)), np.log10(in_class + ADDED * (kinds + 1)))
    sequences = scratch.put(_sequences(encoded, model, every), "sequences")
    scratch.drop("encoded")
    grid = _transitions(sequences.filter("trained"), classes - 1, classes)
    model.likelihoods = [*likelihoods, likelihood(grid)]
    own = (in_class + 1) / (in_class + 1).sum()
    model.transitions = np.log10((grid + TRANSITION_PRIOR * own) / (grid.sum(1, keepdims=True) + TRANSITION_PRIOR))
    return model, every, sequences


def train_classes(train: DataFrame, scratch: C.Scratch, classes: int | None = None, sweeps: int = SWEEPS) -> tuple[Classes, DataFrame]:
    """The model, and the counts and classes of all training words (word, c, class) as a table."""
    rows = train.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("scored"), F.lit(True).alias("trained"))
    return _learn(rows, scratch, classes, sweeps)[:2]


def _sequences(encoded: DataFrame, model: Classes, others: DataFrame) -> DataFrame:
    """Each row's classes and what its words' own counts give. A text's words that aren't held meet theirs in a join,
    once for each text and word, and are gathered by text."""
    held = len(model.words)
    shared = encoded.sparkSession.sparkContext.broadcast((np.append(model.of_unit[: held - 1], model.of_unit[-1]), model.of_unit[held - 1 : -1]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 1000):
                part = batch.slice(j, 1000)
                n = np.diff(_unpacked(part.column("times"))[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("rid").to_numpy(), n)), pa.array(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), pa.int32()), _rare(part)], ["rid", "i", "word"])

    rare = encoded.filter("rare IS NOT NULL").select("rid", "rare", "times").mapInArrow(spread, "rid long, i int, word binary")
    if held >= HELD:
        others = others.filter(F.col("c") <= int(model.counts[-2]))
    met = rare.join(others.hint("merge"), "word", "left").select("rid", "i", F.coalesce("class", F.lit(-1)).alias("class"), F.coalesce("c", F.lit(0)).alias("c"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.RecordBatch) -> pa.RecordBatch:
            rid, i, kind, c = (t.column(x).to_numpy() for x in ("rid", "i", "class", "c"))
            first = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
            ends = np.append(first, len(rid))
            place = np.repeat(first, np.diff(ends)) + i
            own, counts = np.empty(len(rid), np.int32), np.empty(len(rid), np.int64)
            own[place], counts[place] = kind, c
            return pa.RecordBatch.from_arrays([pa.array(rid[first]), _packed(own, ends), _packed(counts.view(np.int32), 2 * ends)], ["rid", "classes", "counts"])

        left: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                rid = batch.column("rid").to_numpy()
                k = int(np.searchsorted(rid, rid[-1]))
                if k or (left and left[-1].column("rid")[0].as_py() != rid[0]):
                    yield done(pa.concat_batches([*left, batch.slice(0, k)]))
                    left = []
                left.append(batch.slice(k))
        if left:
            yield done(pa.concat_batches(left))

    gathered = met.repartition("rid").sortWithinPartitions("rid").mapInArrow(gather, "rid long, classes binary, counts binary")
    full = encoded.drop("rare").join(gathered.hint("merge"), "rid", "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, instead = shared.value
        for batch in batches:
            for j in range(0, batch.num_rows, 1000):
                part = batch.slice(j, 1000)
                flat, which, buckets = _flat(part)
                ends, (times, begin) = _unpacked(part.column("path"))[1], _unpacked(part.column("times"))
                at, n_known, logs = class_of[np.maximum(flat, 0)], part.column("n_held").to_numpy(), part.column("logs").to_numpy()
                if len(times):
                    own, c = (_unpacked(part.column(x).fill_null(b""))[0] for x in ("classes", "counts"))
                    c = c.view(np.int64)
                    own = np.where(own < 0, instead[buckets], own)  # of words that training lacks
                    at = np.where(flat < 0, own[which], at)
                    of_text = np.repeat(np.arange(len(part)), np.diff(begin))
                    n_known = n_known + np.bincount(of_text, np.where(c > 0, times, 0), len(part)).astype(np.int64)
                    logs = logs + np.bincount(of_text, times * np.log10(c + ADDED), len(part))
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("doc_id", "scored", "trained", "n_tokens")), pa.array(n_known), pa.array(logs), _packed(at, ends)], ["doc_id", "scored", "trained", "n_tokens", "n_known", "logs", "path"])

    return full.mapInArrow(fill, "doc_id long, scored boolean, trained boolean, n_tokens long, n_known long, logs double, path binary")


def _steps(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, those before them (an end before each text's first), and where texts begin."""
    now, ends = _unpacked(column)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[ends[:-1]] = end
    return now, before, ends[:-1]


def _transitions(sequences: DataFrame, end: int, classes: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            if batch.num_rows:
                now, before, _ = _steps(batch.column(0), end)
                total += np.bincount(before.astype(np.int64) * classes + now, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["pair", "n"])

    got = sequences.select("path").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return np.bincount(got.column("pair").to_numpy(), got.column("n").to_numpy(), classes * classes).reshape(classes, classes)


def _score(rows: DataFrame) -> DataFrame:
    scratch = C.Scratch(rows.sparkSession, "brown-lm")
    with C.shuffles_dropped(rows.sparkSession):
        model, _, sequences = _learn(rows, scratch)
    scratch.keep("sequences")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                now, before, first = _steps(batch.column("path"), m.of_unit[-1])
                path = np.add.reduceat(m.transitions[before, now] - m.below[now], first)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "n_tokens", "n_known", "logs")), pa.array(path)], ["doc_id", "n_tokens", "n_known", "logs", "path"])

    out = sequences.filter("scored").select("doc_id", "n_tokens", "n_known", "logs", "path").mapInArrow(run, "doc_id long, n_tokens long, n_known long, logs double, path double")
    return out.select(
        "doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(model.base_below)).alias("base_score"), (F.col("logs") + F.col("path")).alias("score"),
    )


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score (of a unigram model with ADDED) and
    score, both log10 probabilities of the text and its end. train: text.

    Null, empty or white-space text: one token, the end. Null doc_id: scored like any row. Repeated rows: each its
    score. Without training rows every word is unknown and each probability 1 in base_score. An empty table gives no
    rows; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(True).alias("scored"), F.lit(False).alias("trained"))
    return _score(rows.unionByName(train.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("scored"), F.lit(True).alias("trained"))))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = C.id_remainder(F.col("doc_id"), 10) == 0
    out = _score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(True).alias("scored"), (~held_out).alias("trained")))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
