"""BPE encoding and decoding with reuse of content-defined chunks: a rolling hash over a text's characters sets the
chunk borders, so passages that documents share fall into the same chunks; each chunk is encoded once, and where two
chunks meet, what the border cuts is encoded again, until it agrees with both sides."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import common as C

TOKENIZER = "word_bpe_49k.json"
#: Characters that the rolling hash covers; chunks have about 2 ** BORDER_BITS places where a border may be, and are cut beyond MAX_CHARS.
WINDOW, BORDER_BITS, MAX_CHARS = 8, 7, 8192
#: A task's dictionary of chunks is emptied beyond so many characters, that of words renewed beyond so many, which costs encoding again, never a result.
CACHE_CHARS, CACHE_WORDS = 6_000_000, 400_000

#: A piece is a word with the white space before it; all white space that Python and the tokenizer both call so.
_PIECE = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
_GAP = re.compile(r"[ \t\n]+")
_FACTORS = [0x9E3779B97F4A7C15 ** (k + 1) % 2**64 for k in range(WINDOW)]
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
_IS_GAP = np.array([chr(i) in " \t\n" for i in range(0x10000)])


#: A worker's coder lasts from task to task.
_CODERS: dict[str, ChunkCoder] = {}


def tokenizer_path(name: str = TOKENIZER, folder: str | None = None) -> str:
    """folder: where the vocabulary files are; that of the installed package if not given."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkCoder:
    """encode and decode exactly as the whole text would be."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tok.decode([i], skip_special_tokens=False) for i in range(size)]
        self.is_end = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}  # until the dictionary was last full
        self.joins: dict[tuple[str, str], bool] = {}
        self.chars = self.encoded = self.reused = self.checked = self.repaired = 0

    @staticmethod
    def cut(text: str) -> list[str]:
        """The chunks, which joined give the text. A border depends on the WINDOW characters before it and the one
        after it, unless a chunk reaches MAX_CHARS. It may be anywhere but between two letters, so it may cut words,
        runs of signs and special tokens. No chunk but a text's last is without white space, so what lies between the
        white space on both sides of a border is in the two chunks that meet there."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(points)
        if n <= WINDOW:
            return [text] if text else []
        rolled = points[WINDOW - 1 :] * np.uint64(_FACTORS[0])
        for k in range(1, WINDOW):
            rolled += points[WINDOW - 1 - k : n - k] * np.uint64(_FACTORS[k])
        rolled ^= rolled >> np.uint64(29)
        ends = np.flatnonzero((rolled * np.uint64(_FACTORS[1])) >> np.uint64(64 - BORDER_BITS) == 0) + WINDOW
        small = np.minimum(points, 0xFFFF).astype(np.int64)
        ends = ends[ends < n]
        ends = ends[~(_LETTER[small[ends - 1]] & _LETTER[small[ends]])]
        gaps = np.cumsum(_IS_GAP[small])
        out, at, seen = [], 0, 0
        for end in [*ends.tolist(), n]:
            while end - at > MAX_CHARS:
                if (cut := at + MAX_CHARS) < n and gaps[cut - 1] == seen:  # no white space yet
                    cut = int(np.searchsorted(gaps, seen, "right")) + 1
                if cut >= end:
                    break
                out.append(text[at:cut])
                at, seen = cut, gaps[cut - 1]
            if end > at and (end == n or gaps[end - 1] > seen):
                out.append(text[at:end])
                at, seen = end, gaps[end - 1]
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def fill(self, chunks: list[str]) -> None:
        """Encodes and decodes those of the chunks that are new, from their words, which are reused likewise: a word
        between white space is the smallest chunk."""
        new = [x for x in dict.fromkeys(chunks) if x not in self.chunks]
        self.encoded += len(new)
        self.reused += len(chunks) - len(new)
        cut = [_GAP.split(x) for x in new]
        self.learn(set().union(*cut))
        words = self.words
        for x, ws in zip(new, cut, strict=True):
            ids, texts = zip(*map(words.__getitem__, ws), strict=True)
            self.chunks[x] = b"".join(ids), " ".join(filter(None, texts))
            self.chars += len(x) + 100

    def learn(self, words: set[str]) -> None:
        """Words of letters alone go through the tokenizer as one text, as each ends with the one token that marks an
        end; the others go one by one."""
        missing = []
        for w in words.difference(self.words):
            if known := self.older.get(w):
                self.words[w] = known
            else:
                missing.append(w)
        plain = [w for w in missing if w.isalpha()]
        for i in range(0, len(plain), 512):
            own = plain[i : i + 512]
            ids = self._ids([" ".join(own)])[0]
            ends = np.flatnonzero(self.is_end[ids]) + 1 if ids else ()
            if len(ends) != len(own) or ends[-1] != len(ids):
                missing += own
                continue
            raw, tokens, at = np.array(ids, "<u4").tobytes(), [self.tokens[x] for x in ids], 0
            for w, end in zip(own, ends.tolist(), strict=True):
                self.words[w] = raw[4 * at : 4 * end], " ".join(tokens[at:end])
                at = end
        missing = [w for w in missing if w not in self.words]
        for w, ids in zip(missing, self._ids(missing), strict=True):
            self.words[w] = np.array(ids, "<u4").tobytes(), self.tok.decode(ids, skip_special_tokens=False)

    def check(self, cut: list[list[str]]) -> None:
        """Encodes what lies across each new join, the end of a chunk and the beginning of the next one up to white
        space on either side, and holds it against both. As no token spans white space, those who agree there agree
        everywhere."""
        new = list({k for chunks in cut for k in map(self._join, chunks, chunks[1:]) if k not in self.joins})
        self.learn({x.strip(" \t\n") for pair in new for x in pair})
        for key, ids in zip(new, self._ids([a + b for a, b in new]), strict=True):
            self.joins[key] = np.array(ids, "<u4").tobytes() == b"".join(self.words[x.strip(" \t\n")][0] for x in key)
            self.checked += 1

    @staticmethod
    def _join(left: str, right: str) -> tuple[str, str]:
        end = left.rstrip(" \t\n")
        at = max(end.rfind(" "), end.rfind("\n"), end.rfind("\t")) + 1
        head = _PIECE.match(right)
        return left[at:], head[0] if head else ""

    def code(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        if self.chars > CACHE_CHARS:
            self.chunks.clear()
            self.joins.clear()
            self.chars = 0
        cut = [self.cut(x) for x in texts]
        self.fill([x for chunks in cut for x in chunks])
        self.check(cut)
        for chunks in cut:
            at = 0
            while at + 1 < len(chunks):
                if self.joins.get(key := self._join(chunks[at], chunks[at + 1])):
                    at += 1
                elif key not in self.joins:
                    self.check([chunks[at : at + 2]])
                else:  # both become one chunk, which is held against its neighbours in turn
                    self.repaired += 1
                    chunks[at : at + 2] = [chunks[at] + chunks[at + 1]]
                    at = max(0, at - 1)
            missing = [x for x in chunks if x not in self.chunks]
            if missing:
                self.fill(missing)
            done = [self.chunks[x] for x in chunks]
            yield b"".join([x for x, _ in done]), " ".join([x for y, x in done if y])


def coder_for(path: str) -> ChunkCoder:
    if path not in _CODERS:
        _CODERS[path] = ChunkCoder(path)
    return _CODERS[path]


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with n_tokens, ids (little-endian unsigned 32-bit integers, one after the other)
    and decoded added; columns of docs that have these names are replaced. path: the vocabulary file, which every
    executor can read.

    Null or empty text: no ids, empty decoded text. Special tokens' strings in a text become their ids, as the
    library has it. Repeated rows give the same ids. An empty table gives no rows.
    """
    docs = docs.drop("n_tokens", "ids", "decoded")
    path = path or tokenizer_path()

    def make() -> Callable[[list[str]], dict[str, list]]:
        coder = coder_for(path)

        def run(texts: list[str]) -> dict[str, list]:
            coded = list(coder.code(texts))
            return {"n_tokens": [len(x) // 4 for x, _ in coded], "ids": [x for x, _ in coded], "decoded": [x for _, x in coded]}

        return run

    return C.map_text(docs, "text", [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())], make, keep)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(C.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
