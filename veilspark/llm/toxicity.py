"""Toxicity by noisy-channel deobfuscation: leetspeak, spacing and repetition span a lattice of characters, which a
Viterbi search decodes under a character language model; the restored text is then scored by a lexicon and a
logistic model learned from labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import common as C

THRESHOLD = 0.7
#: Labelled rows that the lexicon and the logistic model are fitted on, about, picked by a hash of the id.
LABELLED_ROWS = 30_000
#: The least toxic labelled documents that a word, or a beginning of words, of the lexicon must be in.
LEAST_DOCS, LEAST_DOCS_PREFIX = 4, 8
#: How much likelier an entry must be in toxic documents, as a logarithm.
LEAST_WEIGHT = 2.0
#: Lengths of the beginnings of words that are entries too, for inflected and compound forms.
PREFIXES = (4, 5, 6)
#: Distinct words whose weights a task remembers.
REMEMBERED = 300_000

#: Characters that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "§": "s"}
_DROPPED, _WILD = ".-_*·~'^", "*#%"
_VOWELS = "aeiou"
#: Costs in nats that learning starts from: reading a sign as a letter, as itself, leaving out a sign or a repeated
#: letter, filling in a letter. They weigh as much as so many hidden words.
AS_LETTER, AS_ITSELF, LEFT_OUT, REPEATED, FILLED = 0.5, 3.0, 1.5, 0.4, 2.5
PRIOR_WORDS, LEAST_COST, MOST_COST = 50.0, 0.05, 5.0
#: What a word of the lexicon gains over one that isn't.
KNOWN = 9.0

_SINGLE = r"(?:[^\W_]|[@$!|+(€£¡¢§])"
_SPACED = re.compile(rf"(?<![^\W_]){_SINGLE}(?:[ .\-_*·~]{{1,3}}{_SINGLE}){{2,}}(?![^\W_])")
_ZERO_WIDTH = re.compile("[­​-‏⁠﻿]")
_EDGE = " \t\n\r\x0b\x0c.,;:?()[]{}<>\"'`“”„«»…/\\=&"
_STRAIGHT = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*\Z")
_RUN = re.compile(r"(.)\1\1|(?:(.)\2){3}")
#: A doubled letter, and a longer run of what can't stand for a letter each.
_TWICE, _LONG_RUN = re.compile(r"([^\W\d_])\1"), re.compile(r"([^*#%])\1{2,}")
_WIDE = re.compile(r"(?<=\S)[ ]{2,}(?=\S)")

_CODES = 64


def char_code(c: str) -> int:
    """0: a word's border; 1-26: a-z; 27-62: other letters, by their code point; 63: anything else."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 36 if c.isalpha() else 0 if c.isspace() else 63


@dataclass
class Channel:
    """Costs of how hidden words are written: those of (sign, letter) for a sign that stands for a letter, and of the
    other operations. Those that aren't in ``costs`` are what learning starts from."""

    costs: dict[tuple[str, str], float] = field(default_factory=dict)
    _made: dict[tuple[str, bool], tuple[list[tuple[str, float]], float | None]] = field(default_factory=dict, repr=False)

    def cost(self, sign: str, what: str) -> float:
        return self.costs.get((sign, what), _START.get(what, AS_LETTER))

    def choices(self, c: str, last: str) -> tuple[list[tuple[str, float]], float | None]:
        """What a character after ``last`` may stand for, with costs, and the cost of leaving it out, if it may be."""
        key = (c, c == last)
        if key not in self._made:
            if len(self._made) > 10_000:
                self._made.clear()
            said = [(c, 0.0 if c.isalpha() else self.cost("", "itself"))]
            said += [(x, self.cost(c, x)) for x in LEET.get(c, "")]
            if c in _WILD:
                said += [(x, self.cost("", "filled")) for x in _VOWELS]
            skip = self.cost("", "repeated") if c == last and (c.isalpha() or c in LEET) else self.cost("", "left out") if c in _DROPPED or c in _WILD else None
            self._made[key] = said, skip
        return self._made[key]


_START = {"itself": AS_ITSELF, "left out": LEFT_OUT, "repeated": REPEATED, "filled": FILLED}


def align(channel: Channel, token: str, word: str) -> list[tuple[str, str]]:
    """The cheapest way in which a token was made of a word, as (sign, letter) and ("", operation); plain letters as
    (letter, letter). Empty if there is none."""
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    last = ""
    for c in token:
        said, skip = channel.choices(c, last)
        new: dict[int, tuple[float, tuple | None]] = {}
        for j, (s, ops) in best.items():
            for x, cost in said:
                if word[j : j + 1] == x and (j + 1 not in new or s + cost < new[j + 1][0]):
                    op = (c, x) if c.isalpha() or x in LEET.get(c, "") else ("", "itself") if x == c else ("", "filled")
                    new[j + 1] = s + cost, (ops, op)
            if skip is not None and (j not in new or s + skip < new[j][0]):
                new[j] = s + skip, (ops, ("", "repeated" if c == last and (c.isalpha() or c in LEET) else "left out"))
        best, last = new, c
    out, ops = [], best.get(len(word), (0.0, None))[1]
    while ops:
        ops, op = ops
        out.append(op)
    return out[::-1]


def learned_channel(counts: dict[tuple[str, str], float], words: float) -> Channel:
    """Costs by maximum a posteriori: how often letters of hidden words are written as a sign rather than plainly, and
    how often each other operation is met in a hidden word, with the starting costs as PRIOR_WORDS words."""
    costs = {}

    def put(key: tuple[str, str], start: float, n: float, of: float) -> None:
        costs[key] = min(MOST_COST, max(LEAST_COST, math.log((of + PRIOR_WORDS) / (n + PRIOR_WORDS * math.exp(-start)))))

    for c, letters in LEET.items():
        for x in letters:
            put((c, x), AS_LETTER, counts.get((c, x), 0.0), counts.get((x, x), 0.0))
    for what, start in _START.items():
        put(("", what), start, counts.get(("", what), 0.0), words)
    return Channel(costs)


@dataclass
class Model:
    #: Natural logarithms of P(c | a, b), by a * 4096 + b * 64 + c.
    trigrams: np.ndarray
    lexicon: dict[str, float]
    prefixes: dict[str, float]
    channel: Channel = field(default_factory=Channel)
    #: Logistic weights of features(), the last for 1.
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.5, 0.5, -4.0]))
    #: Every beginning of an entry: the nodes of a trie.
    stems: set[str] = field(init=False)

    def __post_init__(self) -> None:
        self.stems = {w[:i] for w in (*self.lexicon, *self.prefixes) for i in range(len(w) + 1)}


def word_weight(model: Model, word: str) -> float:
    own = model.lexicon.get(word, 0.0)
    for n in PREFIXES:
        if len(word) > n:
            own = max(own, model.prefixes.get(word[:n], 0.0))
    return own


def core(token: str) -> str:
    """The token without punctuation at its ends, and without a run of the same signs at its end."""
    token = token.strip(_EDGE)
    end = len(token)
    while end and not token[end - 1].isalnum():
        end -= 1
    tail = token[end:]
    return token[:end] if len(tail) > 1 or tail in "!|*.,-_~%#&+" else token


def whole(token: str) -> list[str]:
    """The token with the signs at its ends that may stand for letters, where it has some."""
    bare = token.strip(_EDGE)
    out = [bare] if bare and bare[-1] in LEET and not bare[-1].isdigit() else []
    if "(" in token and ")" not in token and (open_ := token.strip(_EDGE.replace("(", ""))) != bare:
        out.append(open_)
    return out


def _spell(path: tuple | None) -> str:
    """The characters of a path (path before, character)."""
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


_Plain = dict[tuple[int, int], tuple[float, tuple | None, tuple | None]]


def _step_plain(logs: np.ndarray, states: _Plain, said: list[tuple[str, float]], skip: float | None) -> _Plain:
    """One character of the search whose state is the last two letters: for each state the best path's logarithm,
    its characters, and the words before it."""
    new: _Plain = {}
    for (a, b), (s, path, before) in states.items():
        at = a * 4096 + b * 64
        for x, cost in said:
            code = char_code(x)
            step = s + logs[at + code] - cost
            if (old := new.get((b, code))) is None or old[0] < step:
                new[b, code] = step, (path, x), before
        if skip is not None and ((old := new.get((a, b))) is None or old[0] < s - skip):
            new[a, b] = s - skip, path, before
    return new


class _Lexical:
    """The same search along the trie of the lexicon's entries, so no entry is left out; of the rest of a word that
    begins with an entry, the likeliest reading counts. Its states are the trie's nodes, and past an entry that may go
    on, that entry and the last two letters, so a character takes no longer in a long text than in a short one."""

    def __init__(self, model: Model) -> None:
        self.logs, self.stems, self.prefixes, self.lexicon = model.trigrams, model.stems, model.prefixes, model.lexicon
        self.inside: dict[str, tuple[float, int, int, tuple | None]] = {}
        self.after: dict[tuple[str, int, int], tuple[float, tuple | None, tuple | None]] = {}

    def begin(self, score: float, before: tuple | None) -> None:
        if "" not in self.inside or self.inside[""][0] < score:
            self.inside[""] = score, 0, 0, before

    def step(self, said: list[tuple[str, float]], skip: float | None) -> None:
        logs, stems, inside, after = self.logs, self.stems, {}, {}
        for w, (s, a, b, before) in self.inside.items():
            begun = w in self.prefixes
            for x, cost in said:
                to = w + x
                if begun or to in stems:
                    code = char_code(x)
                    step = s + logs[a * 4096 + b * 64 + code] - cost
                    if to in stems and (to not in inside or inside[to][0] < step):
                        inside[to] = step, b, code, before
                    if begun and ((old := after.get((w, b, code))) is None or old[0] < step):
                        after[w, b, code] = step, (None, x), before
            if skip is not None and (w not in inside or inside[w][0] < s - skip):
                inside[w] = s - skip, a, b, before
        for (e, a, b), (s, path, before) in self.after.items():
            for x, cost in said:
                code = char_code(x)
                step = s + logs[a * 4096 + b * 64 + code] - cost
                if (old := after.get((e, b, code))) is None or old[0] < step:
                    after[e, b, code] = step, (path, x), before
            if skip is not None and ((old := after.get((e, a, b))) is None or old[0] < s - skip):
                after[e, a, b] = s - skip, path, before
        self.inside, self.after = inside, after

    def ends(self) -> Iterator[tuple[float, str, tuple | None, tuple | None]]:
        """Words that may end here: logarithm, entry, the path past it, the words before."""
        for w, (s, a, b, before) in self.inside.items():
            if w in self.lexicon:
                yield s + self.logs[a * 4096 + b * 64], w, None, before
        for (e, a, b), (s, path, before) in self.after.items():
            yield s + self.logs[a * 4096 + b * 64], e, path, before


def readings(model: Model, token: str) -> list[tuple[float, str]]:
    """All lexicon words that the token can stand for, with their log probabilities."""
    search, last = _Lexical(model), ""
    search.begin(0.0, None)
    for c in token:
        search.step(*model.channel.choices(c, last))
        last = c
        if not search.inside and not search.after:
            return []
    return [(s, w + _spell(path)) for s, w, path, _ in search.ends()]


def decode(model: Model, token: str, known: list[tuple[float, str]] | None = None) -> str:
    """The likeliest word behind a token: the exact Viterbi search over what its characters may stand for, with the
    last two letters as state, and all lexicon readings, which gain KNOWN."""
    states, last = {(0, 0): (0.0, None, None)}, ""
    for c in token:
        states = _step_plain(model.trigrams, states, *model.channel.choices(c, last))
        last = c
    plain = max(((s + model.trigrams[a * 4096 + b * 64], path) for (a, b), (s, path, _) in states.items()), key=lambda x: x[0], default=None)
    ends = [(s + KNOWN, w) for s, w in (readings(model, token) if known is None else known)]
    if plain:
        ends.append((plain[0], _spell(plain[1])))
    return max(ends)[1] if ends else token


def segment(model: Model, letters: str) -> list[str]:
    """The likeliest words behind single characters: the same search, in which a border may follow any letter, and every
    lexicon reading gains KNOWN."""
    logs = model.trigrams
    at, words = 0.0, None
    states: _Plain = {}
    lexical, last = _Lexical(model), ""
    for c in letters:
        said, skip = model.channel.choices(c, last)
        last = c
        if words is not None or at == 0.0:
            lexical.begin(at, words)
            states[0, 0] = at, None, words
        lexical.step(said, skip)
        states = _step_plain(logs, states, said, skip)
        at, words = -math.inf, None
        for s, w, path, before in lexical.ends():
            if s + KNOWN > at:
                at, words = s + KNOWN, (before, (w, path))
        for (a, b), (s, path, before) in states.items():
            if s + logs[a * 4096 + b * 64] > at:
                at, words = s + logs[a * 4096 + b * 64], (before, ("", path))
    out = []
    while words:
        words, (w, path) = words
        out.append(w + _spell(path))
    return out[::-1]


class Restorer:
    """The toxic words of texts, restored where they are hidden."""

    def __init__(self, model: Model, lattice: bool = True) -> None:
        self.model, self.known, self.lattice = model, {}, lattice

    def word(self, token: str) -> tuple[str, float]:
        """The token's restored word, and its weight."""
        w = core(token)
        if w and (weight := word_weight(self.model, w)):
            return w, weight
        if "-" in w or "'" in w:
            parts = [p for p in re.split(r"[-'’]", w) if len(p) > 2]
            best = max(((word_weight(self.model, p), p) for p in parts), default=(0.0, w))
            if best[0]:
                return best[1], best[0]
        for x in dict.fromkeys((w, *whole(token))) if self.lattice else ():
            if x and (not _STRAIGHT.match(x) or _TWICE.search(x)):
                x = _LONG_RUN.sub(r"\1\1", x)
                if known := readings(self.model, x):
                    new = decode(self.model, x, known)
                    if weight := word_weight(self.model, new):
                        return new, weight
        return w, 0.0

    def unknown(self, token: str) -> str:
        """The likeliest reading of a token that hides no lexicon word; numbers and plain words stay."""
        w = core(token)
        letters = sum(c.isalpha() for c in w)
        if (_STRAIGHT.match(w) and not _RUN.search(w)) or letters < 2 or letters < len(w) / 3:
            return w
        return decode(self.model, w, [])

    def spaced(self, span: str) -> tuple[str, dict[str, float]]:
        """A span of single characters: the words they spell, unless they are likelier to stand apart, and the weights
        of those in the lexicon."""
        if len(words := _WIDE.split(span)) > 1 and all(len(w) > 1 for w in words):  # wider gaps part words
            done = [self.spaced(w) for w in words]
            return " ".join(w for w, _ in done), {k: v for _, found in done for k, v in found.items()}
        words = segment(self.model, "".join(c for c in span if c.isalnum() or c in LEET))
        found = {w: weight for w in words if (weight := word_weight(self.model, w))}
        return (" ".join(words) if any(len(w) > 1 for w in words) else span), found

    def restore(self, text: str) -> str:
        """The lower-cased text with hidden words put in their place."""
        text = _ZERO_WIDTH.sub("", text.lower())
        text = _SPACED.sub(lambda m: self.spaced(m[0])[0], text)

        def one(m: re.Match) -> str:
            w = core(m[0])
            new, weight = self.word(m[0])
            if weight and w != new and word_weight(self.model, w) == 0 and (full := whole(m[0])):
                w = max((x for x in (w, *full) if x), key=len)
            elif not weight:
                new = self.unknown(m[0])
            return m[0].replace(w, new, 1) if w and new != w else m[0]

        return re.sub(r"\S+", one, text)

    def hits(self, text: str) -> dict[str, float]:
        """Restored words of the lexicon in a text and their weights."""
        text = _ZERO_WIDTH.sub("", text.lower()) if not text.isascii() else text.lower()
        out: dict[str, float] = {}
        known = self.known
        for w in set(text.split()):
            found = known.get(w)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                word, weight = self.word(w)
                found = known[w] = (word, weight) if weight else ()
            if found:
                out[found[0]] = max(found[1], out.get(found[0], 0.0))
        if self.lattice:
            for m in _SPACED.finditer(text):
                out.update(self.spaced(m[0])[1])
        return out


def hidden_words(restorer: Restorer, text: str) -> Counter:
    """How the hidden words of a text are written: counts of align()'s operations, and of the words as ("", "words")."""
    out: Counter = Counter()
    for token in set(text.lower().split()):
        word, weight = restorer.word(token)
        if weight and word not in token:
            for x in (core(token), *whole(token)):
                if ops := align(restorer.model.channel, _LONG_RUN.sub(r"\1\1", x), word):
                    out.update(ops)
                    out["", "words"] += 1
                    break
    return out


def features(hits: dict[str, float]) -> list[float]:
    top = sorted(hits.values(), reverse=True)
    return [top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, math.log1p(len(top)), 1.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.5) -> np.ndarray:
    """Weights by Newton's method, pulled to 0 a little; those of the hits aren't negative."""
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), pull)
    keep[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - y) + keep * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-6)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    w[:-1] = np.maximum(w[:-1], 0.0)
    return w


def char_trigrams(docs: DataFrame) -> np.ndarray:
    """Smoothed log probabilities of a character after two, over every word of all documents (64 ** 3 numbers)."""
    table = np.full(65536, 63, np.int32)
    for i in range(65536):
        table[i] = char_code(chr(i).lower()[0])

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        total = np.zeros(_CODES**3, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                text = " " + " ".join(x for x in batch.column(0).slice(i, 64).to_pylist() if x) + " "
                points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
                codes = table[np.minimum(points, 65535)]
                # a word's first letter follows two borders, whatever the word before
                before = np.where(codes[1:-1] == 0, np.int32(0), codes[:-2])
                total += np.bincount(before * 4096 + codes[1:-1] * 64 + codes[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["i", "n"])

    counts = np.zeros(_CODES**3)
    for r in docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[r.i] = r.n
    cube = counts.reshape(_CODES, _CODES, _CODES)
    one = cube.sum((0, 1)) + 1
    one /= one.sum()
    two = cube.sum(0)
    two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    three = (cube + 20 * two[None]) / (cube.sum(2, keepdims=True) + 20)
    return np.log(three).ravel()


def _entries(text: str) -> set[str]:
    words = {w for t in set(text.lower().split()) if (w := core(t)) and w.isalpha()}
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


_MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _alike(text: str) -> bytes:
    """The same for many near copies only: four independent least hashes of a text's runs of three words."""
    words = text.lower().split()
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    values = pd.util.hash_array(np.array(list(runs), object), categorize=False)
    return b"".join((values * np.uint64(m) ^ (values * np.uint64(m) >> np.uint64(29))).min().tobytes() for m in _MIXERS)


def _fit_channel(own: DataFrame, model: Model) -> Channel:
    """The channel by the words that toxic labelled texts (own: text, y) hide. The result is a few hundred counts."""
    shared = own.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, sums = Restorer(shared.value), Counter()
        for pdf in batches:
            for t in pdf["text"]:
                sums.update(hidden_words(restorer, t))
        yield pd.DataFrame([(*k, n) for k, n in sums.items()], columns=["sign", "what", "n"]).astype({"n": "int64"})

    counted = own.filter("y = 1").select("text").mapInPandas(count, "sign string, what string, n long").groupBy("sign", "what").agg(F.sum("n").alias("n"))
    counts = {(r.sign, r.what): float(r.n) for r in counted.collect()}
    return learned_channel(counts, counts.get(("", "words"), 0.0))


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, lattice: bool = True) -> Model:
    """labels: doc_id, y (0 or 1). About ``rows`` labelled documents, near copies once, give the lexicon, the channel
    and the logistic model; the character model is over all documents."""
    scratch = C.Scratch(docs.sparkSession, "toxicity")
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("y").cast("int").alias("y"))
    n = labels.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1e6 * min(1.0, rows / max(n, 1)))
    few = F.broadcast(labels.filter(part))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(few, "doc_id")
    own = C.map_text(own, "text", [T.StructField("alike", T.BinaryType())], lambda: lambda ts: {"alike": [_alike(t) for t in ts]})
    own = scratch.put(own.groupBy("alike", "y").agg(F.min(F.struct("doc_id", "text")).alias("least")).select("least.text", "y"), "labelled")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()

        def rows() -> pd.DataFrame:
            got = [(w, n if y else 0, 0 if y else n) for (w, y), n in sums.items()]
            return pd.DataFrame(got, columns=["w", "n1", "n0"]).astype({"n1": "int64", "n0": "int64"})

        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["y"], strict=True):
                sums.update((w, y) for w in _entries(t))
                if len(sums) > REMEMBERED:
                    yield rows()
                    sums.clear()
        yield rows()

    have = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = have.get(0, 0), have.get(1, 0)
    weight = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    least = F.when(F.endswith("w", F.lit("*")), LEAST_DOCS_PREFIX).otherwise(LEAST_DOCS)
    words = own.mapInPandas(count, "w string, n1 long, n0 long").groupBy("w").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    words = words.filter(F.col("n1") >= least).withColumn("weight", weight).filter((F.col("weight") >= LEAST_WEIGHT) & (F.col("n1") > 2 * F.col("n0")))
    lexicon, prefixes = {}, {}
    # every entry that passes: each is in several of the labelled texts, whose number is bounded
    for r in words.orderBy("w").collect():
        if r.w.endswith("*"):
            prefixes[r.w[:-1]] = r.weight
        else:
            lexicon[r.w] = r.weight
    model = Model(char_trigrams(docs), lexicon, prefixes)
    model.channel = _fit_channel(own, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look() -> Callable:
        restorer = Restorer(shared.value, lattice)
        return lambda ts: {"x": [features(restorer.hits(t)) for t in ts]}

    seen = C.map_text(own, "text", [T.StructField("x", T.ArrayType(T.DoubleType()))], look, keep=["y"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    if n0 and n1:
        x, y = np.array([r.x for r in seen for _ in range(r.n)]), np.array([r.y for r in seen for _ in range(r.n)])
        model.weights = fit_logistic(x, y)
    scratch.drop("labelled")
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None, lattice: bool = True, restored: bool = False) -> DataFrame:
    """docs (or its columns in keep) with score (0 to 1, probability of label 1) and predicted added; columns of docs with these names are
    replaced. ``restored`` adds a column of that name: the lower-cased text with hidden words in their place. labels: doc_id, y; rows with null in either are left out, of several labels of an id the higher counts.

    ``lattice`` off leaves hidden words hidden, to measure what restoring them is worth.

    Null or empty text: no hit, and the score of a text without hits. Null doc_id: scored, never trained on.
    Repeated rows: the same score. Very long texts are read whole, in time linear in their length. Without labels of both classes the lexicon is empty and every score is low. An
    empty table gives no rows.
    """
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if restored:
        added.append(T.StructField("restored", T.StringType()))
    docs = docs.drop(*(f.name for f in added))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, lattice=lattice))

    def score() -> Callable:
        model = shared.value
        restorer = Restorer(model, lattice)

        def run(texts: list[str]) -> dict[str, list]:
            z = [float(np.dot(model.weights, features(restorer.hits(t)))) for t in texts]
            p = [1 / (1 + math.exp(-max(-500.0, min(500.0, v)))) for v in z]
            out = {"score": p, "predicted": [int(v >= threshold) for v in p]}
            return out | {"restored": [restorer.restore(t) for t in texts]} if restored else out

        return run

    return C.map_text(docs, "text", added, score, keep)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(C.id_remainder(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").alias("y"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, training_labels(C.table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", (C.id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
