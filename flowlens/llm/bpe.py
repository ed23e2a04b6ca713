"""BPE encoding and decoding by backtracking over longest token matches.

Encoding a word: an Aho-Corasick automaton over the vocabulary gives the
longest token at every position. Tokens are taken greedily from the left; a
token may follow the previous one only if the pair-compatibility table says
that byte-pair merging would really leave this pair side by side. If it may
not, the next shorter token with the same start is tried, and if none is left
the previous token is taken back. Positions found unusable are never tried
again, so the work is linear in the word's length, and the result equals that
of applying the merges in rank order.

Decoding: one flat byte buffer holds all token texts; an offset table gives
each id's slice, so a whole document is gathered with array indexing.

The vocabulary file is read on the driver (its path is a parameter) and
broadcast; its size is fixed and does not depend on the data.

Defined cases: a null text counts as empty; an empty text has no ids and
decodes to the empty string. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\n"  # stands for the word-end mark; never a byte-level character
CACHE = 400_000  # words kept per worker; the cache is emptied when full
GATHER = 1 << 18  # ids decoded at a time


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: printable Latin-1 bytes stand for themselves, the others take
    the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Vocabulary:
    """Token texts, ids, merges and pair compatibility of one vocabulary file."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model = conf["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.pattern = conf["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.literal = [""] * self.size
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.literal[i] = t
        self.id_of = {self._inner(t): i for t, i in model["vocab"].items()}
        self.rank = [-1] * self.size  # -1: a base symbol, made by no merge
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = self.id_of[self._inner(a)], self.id_of[self._inner(b)]
            made = self.id_of[self._inner(self.literal[a] + self.literal[b])]
            self.merged.setdefault((a, b), (r, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, a, b

    def _inner(self, token: str) -> str:
        s = self.suffix
        return token[: -len(s)] + END if s and token.endswith(s) else token

    def compatible(self, a: int, b: int) -> bool:
        """Would merging in rank order leave tokens ``a`` and ``b`` side by side?

        Undo the merges of both tokens from the latest on. Whenever the two
        tokens that touch the border could merge with each other before the
        merge just undone, the border would have vanished."""
        limit = len(self.merged) + 1
        while True:
            cross = self.merged.get((a, b))
            if cross is not None and cross[0] < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]  # equal ranks: the left one merges first
            else:
                limit, b = rb + 1, self.left[b]

    def canonical(self, token: int) -> bool:
        """Does merging the token's own text in rank order give this token?"""
        if self.rank[token] < 0:
            return True
        parts = list(self._inner(self.literal[token]))
        if len(parts) > 1 and parts[-1] == END:
            parts[-2:] = [parts[-2] + END]
        ids = [self.id_of.get(p, -1) for p in parts]
        while len(ids) > 1:
            best = min(((self.merged.get(p, (1 << 60, -1))), i) for i, p in enumerate(zip(ids, ids[1:])))
            if best[0][1] < 0:
                break
            ids[best[1]: best[1] + 2] = [best[0][1]]
        return ids == [token]


class Codec:
    """The tables of a worker process: automaton, shorter-token links, caches, offsets."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        self.v = v = Vocabulary(spec)
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.words = regex.compile(v.pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") \
            if v.special else None
        trie = ahocorasick.Automaton()
        usable = {t: i for t, i in v.id_of.items() if v.canonical(i)}
        for t, i in usable.items():
            trie.add_word(t, i)
        trie.make_automaton()
        self.trie = trie
        self.length = [0] * v.size
        for t, i in usable.items():
            self.length[i] = len(t)
        self.shorter = [-1] * v.size  # the longest usable token that is a proper prefix
        for t, i in usable.items():
            for k in range(len(t) - 1, 0, -1):
                if t[:k] in usable:
                    self.shorter[i] = usable[t[:k]]
                    break
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        parts = [(t + " ").encode() for t in v.literal]
        self.buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)

    def fits(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= 2 * CACHE:
                self.pairs.clear()
            got = self.pairs[a, b] = self.v.compatible(a, b)
        return got

    def word_ids(self, symbols: str) -> list[int]:
        """The exact merge result of one word (byte-level characters + END)."""
        n, length, shorter, pairs = len(symbols), self.length, self.shorter, self.pairs
        longest = [-1] * n
        for end, token in self.trie.iter(symbols):
            longest[end + 1 - length[token]] = token  # ends rise: the last is the longest
        if length[longest[0]] == n:
            return [longest[0]]
        open_ = bytearray(b"\x01") * (n + 1)
        open_[n - 1] = not self.v.suffix  # no token may leave the bare word-end mark
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            if token >= 0:
                after = at + length[token]
                if open_[after]:
                    fit = last < 0 or pairs.get((last, token))
                    if fit is None:
                        fit = self.fits(last, token)
                    if fit:
                        out.append(token)
                        at, last = after, token
                        token = longest[at] if at < n else -1
                        continue
                token = shorter[token]
            else:  # nothing fits here: this position is unusable, take the last token back
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out

    def word(self, word: str) -> bytes:
        got = self.cache.get(word)
        if got is None:
            symbols = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = self.word_ids(symbols + END if self.v.suffix else symbols)
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = got
        return got

    def chunk(self, chunk: str) -> bytes:
        """The ids of text without white space."""
        s = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        s = "".join([c.lower() for c in s]) if "Σ" in s else s.lower()  # per character, as the vocabulary's normaliser does
        got = b"".join([self.word(w) for w in self.words.findall(s)])
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.specials is not None and "<" in text and self.specials.search(text):
            return b"".join(struct.pack("<I", self.v.special[p]) if p in self.v.special else self.plain(p)
                            for p in self.specials.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        # str.split() also cuts at the four separator controls, which are no white space here.
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        known, out = self.chunks.get, []
        for c in (self._split_odd(text) if odd else text.split()):
            got = known(c)
            out.append(self.chunk(c) if got is None else got)
        return b"".join(out)

    @staticmethod
    def _split_odd(text: str) -> list[str]:
        import regex

        return [c for c in regex.split(r"(?V1)[\p{White_Space}]+", text) if c]

    def decode(self, ids: bytes) -> bytes:
        """Token texts joined by one space, gathered through the offset table."""
        arr = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        out = []
        for k in range(0, len(arr), GATHER):
            part = arr[k: k + GATHER]
            start, size = self.offset[part], self.offset[part + 1] - self.offset[part]
            ends = np.cumsum(size)
            out.append(self.buffer[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)].tobytes())
        return b"".join(out)[:-1]


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


class Tokenizer:
    """Column functions over one vocabulary file.

    ``encode(col)`` gives the ids packed as little-endian unsigned 32-bit
    integers (binary); ``decode(col)`` gives the text of such a column."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            shared = spark.sparkContext.broadcast(f.read())

        @F.pandas_udf("binary")
        def encode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            c = codec(shared.value)
            for texts in it:
                yield pd.Series([c.encode(t or "") for t in texts], dtype=object)

        @F.pandas_udf("string")
        def decode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            c = codec(shared.value)
            for ids in it:
                yield pd.Series([c.decode(i or b"").decode("utf-8", "replace") for i in ids], dtype=object)

        self.encode, self.decode = encode, decode


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (packed) and ``decoded`` (the text that the ids stand for)."""
    enc = docs.select(F.col(id_col).alias("doc_id"),
                      tokenizer.encode(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("ids"))
    return enc.withColumn("decoded", tokenizer.decode("ids"))
