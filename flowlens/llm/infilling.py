"""Fill-in-the-middle transformation by content-defined chunk memoization.

A document is cut into prefix, middle and suffix at two drawn token ends and
written in another order, with a sentinel before each part. A token is white
space followed by a word, or white space at the end of the text.

A rolling hash over the last 32 bytes ends a chunk where its bits say so, so
a passage that documents share is cut into the same chunks wherever it stands.
A chunk's boundary summary -- words, whether it begins and ends inside a word,
code points -- is kept in a cache whose key is the chunk itself: a hit is a
comparison of all its bytes, no digest stands for them. A document's summary is
the combination of its chunks' (a word that runs over a chunk's end counts
once), and the running counts say which chunk holds a drawn cut; only there is
the text looked at. Chunks have 64 to 4,096 bytes, and the cache holds at most
``CACHE`` bytes of them.

White space and sentinels are ASCII, so cuts fall between code points although
chunks may not.

Defined cases: a null text is the empty one; empty texts and texts that hold a
sentinel stay plain, as does the drawn share. A null id draws as the empty
string; rows of one id draw alike. Texts of any length are cut whole. Empty tables give
empty results; only the id and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 42
RATE = 50  # per cent of the documents that are transformed
SPM_RATE = 80  # per cent of those that lead with the suffix

ROLLING = 32  # bytes that the rolling hash sees
SHORTEST, LONGEST = 64, 4096
CUT_BITS = 9  # a chunk of 512 bytes on average
CACHE = 16 << 20

BLANKS = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _gear() -> np.ndarray:
    """A 64-bit value per byte (splitmix64 of its number)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = _gear()


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end, the last at the text's end."""
    n = len(data)
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < ROLLING:  # h[i] = sum of gear[byte i - k] << k over the last 2 * width bytes
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint64(width)
        h, width = wider, 2 * width
    marks = np.flatnonzero((h >> np.uint64(ROLLING - CUT_BITS)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    ends, last = [], 0
    for mark in [*marks.tolist(), n]:
        if mark - last < SHORTEST and mark < n:
            continue
        while mark - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if mark > last:
            ends.append(mark)
            last = mark
    return ends


class Summaries(dict):
    """Chunk -> (words, begins inside a word, ends inside a word, code points)."""

    def __init__(self, most: int = CACHE):
        super().__init__()
        self.most, self.held, self.misses = most, 0, 0

    def __missing__(self, chunk: bytes) -> tuple[int, bool, bool, int]:
        if self.held + len(chunk) > self.most:
            self.clear()
            self.held = 0
        self.held += len(chunk)
        self.misses += 1
        out = (len(chunk.split()), chunk[0] not in BLANKS, chunk[-1] not in BLANKS, points(chunk))
        self[chunk] = out
        return out


def points(data: bytes) -> int:
    """Code points that begin in the bytes."""
    return len(data) if data.isascii() else len(data.translate(None, CONTINUATION))


class Chunked:
    """A text as chunks: running counts of words and code points."""

    def __init__(self, data: bytes, cache: Summaries):
        self.data, self.ends = data, chunk_ends(data) if data else []
        self.words, self.points, self.joined = [0], [0], []  # before chunk k, and whether it goes on with a word
        begin, inside = 0, False
        for end in self.ends:
            n_words, starts, stops, n_points = cache[data[begin:end]]
            self.joined.append(inside and starts)
            self.words.append(self.words[-1] + n_words - (inside and starts))
            self.points.append(self.points[-1] + n_points)
            begin, inside = end, stops
        self.n_words = self.words[-1]
        self.n_tokens = self.n_words + (bool(data) and not inside)  # blanks at the end are a token

    def end_of(self, tokens: int) -> int:
        """The byte where the first ``tokens`` tokens end."""
        if tokens == 0:
            return 0
        if tokens > self.n_words:
            return len(self.data)
        k = bisect_left(self.words, tokens) - 1  # the chunk in which the word begins
        begin = self.ends[k - 1] if k else 0
        at = WORD.finditer(self.data, begin, self.ends[k])
        for _ in range(tokens - self.words[k] - 1 + self.joined[k]):
            next(at)
        blank = BLANK.search(self.data, next(at).start())
        return blank.start() if blank else len(self.data)

    def points_to(self, byte: int) -> int:
        k = bisect_right(self.ends, byte)
        return self.points[k] + points(self.data[self.ends[k - 1] if k else 0: byte])


def transform(data: bytes, draw: str, cache: Summaries, rate: int = RATE, spm_rate: int = SPM_RATE):
    """(n tokens, form, code points of prefix and of middle, output) for four drawn numbers in hex."""
    h1, h2, h3, h4 = (int(draw[k: k + 8], 16) for k in (0, 8, 16, 24))
    text = Chunked(data, cache)
    n = text.n_tokens
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not data or p in data or s in data or m in data or h3 % 100 >= rate:
        return n, PLAIN, None, None, data
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = text.end_of(first), text.end_of(second)
    before = text.points_to(a)
    inner = text.points_to(b) - before
    if h4 % 100 < spm_rate:
        return n, SPM, before, inner, s + data[b:] + p + data[:a] + m + data[a:b]
    return n, PSM, before, inner, p + data[:a] + s + data[b:] + m + data[a:b]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every document."""
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Summaries()
        for pdf in it:
            out = [(None if pd.isna(i) else int(i), *transform(text.encode("utf-8", "surrogatepass"), draw, cache, rate, spm_rate))
                   for i, draw, text in zip(pdf["id"], pdf["draw"], pdf["text"])]
            got = pd.DataFrame(out, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            got["output"] = [x.decode("utf-8", "surrogatepass") for x in got["output"]]
            yield got.astype({"doc_id": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(name.cast("binary"), 256).alias("draw"),
                          F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows_in.mapInPandas(rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a sentinel, and none
    can arise where a part meets one, so the first of each kind is the one written."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))

    def parts(second: str):
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == PSM, psm).when(form == SPM, F.concat(prefix, middle, suffix)).otherwise(output)
