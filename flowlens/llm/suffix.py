"""Substring deduplication by prefix-partitioned suffix trees over words.

A passage of ``WINDOW`` words is removed from a document when the same words
also start in a document with a smaller id. Suffixes start at every word; only
their first ``WINDOW`` words matter.

1. Prefixes. Of every window, the ``PREFIX``-word prefix that is picked is the
   one of least hash inside it (so equal windows pick the same one). One suffix
   in about four and a half is picked. A picked prefix that no other document
   has cannot belong to a repeated window, and its suffixes are dropped. A task
   sends one witness of what it holds in several documents itself.
2. Groups. The suffixes left are grouped by prefix into memory-sized groups.
   Prefixes with more than ``GROUP`` suffixes are lengthened to the whole
   window, and equal windows of one task go on as one with the smallest id, so
   a passage that a third of all documents share gives a group one row per task.
3. Subtrees. A group's suffixes are sorted by their words. Runs of neighbours
   whose common prefix is at least ``WINDOW`` words are the deep internal nodes
   of the group's suffix tree: their leaves are the maximal repeats, and those
   of documents with an id above the node's smallest are marked.
4. Covered words. Marked windows return to their document as intervals, and the
   words they cover are dropped.

Words stand for the 64 bits of their XXH64 in the sort.
The threshold of long prefixes rises so that at most ``MOST_LONG`` prefixes are
long (an 8 MB list): all other groups stay below total / MOST_LONG suffixes.
Texts travel compressed.

Defined cases: null text has no words; texts with fewer than ``WINDOW`` words
lose nothing; windows that repeat only inside one document, or in documents of
the same id, stay. Null ids count as larger than all others. Empty
tables give empty results; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch

WINDOW = 13
PREFIX = 6
GROUP = 50_000
MOST_LONG = 1_000_000
WORD = 8  # bytes of a word's code
BUCKET = 200_000  # suffixes that one group of prefixes should hold
FLUSH = 500_000  # picked suffixes that a task gathers before it sends them
CACHE = 300_000
LAST = (1 << 63) - 1  # stands for a null id
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class Coder(dict):
    """Word -> XXH64, for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


def codes_of(coder: Coder, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(coder.__getitem__, words), dtype=np.uint64, count=len(words))


def picked(codes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the prefix at every position, and per window the position of the
    least (leftmost) prefix inside it."""
    m, n = len(codes) - prefix + 1, len(codes) - window + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(prefix):
        h = h * MULT + codes[k: k + m]
    order = (h ^ (h >> np.uint64(31))) * MIX
    best, at = order[:n].copy(), np.zeros(n, dtype=np.int64)
    for k in range(1, window - prefix + 1):
        other = order[k: k + n]
        less = other < best
        best[less] = other[less]
        at[less] = k
    return h, at + np.arange(n)


def changes(a: np.ndarray) -> np.ndarray:
    """Where a new value starts in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, dtype=np.int64)


# --- 1. picked prefixes -----------------------------------------------------

SINGLE, SEVERAL, KNOWN = 0, 1, 2


def _prefix_rows(window: int, prefix: int, buckets: int):
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, keys, ids, at, held = Coder(), [], [], [], 0
        for pdf in it:
            for i, text in zip(pdf["ord"], pdf["text"]):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                h, pick = picked(codes_of(coder, words), window, prefix)
                pos = pick[changes(pick)]
                keys.append(h[pos])
                ids.append(np.full(len(pos), i, dtype=np.int64))
                at.append(pos.astype(np.uint32))
                held += len(pos)
                if held >= FLUSH:
                    yield from _send(keys, ids, at, buckets)
                    keys, ids, at, held = [], [], [], 0
        if held:
            yield from _send(keys, ids, at, buckets)

    return rows


def _send(keys, ids, at, buckets) -> Iterator[pd.DataFrame]:
    key, i, pos = np.concatenate(keys), np.concatenate(ids), np.concatenate(at)
    order = np.lexsort((i, key))
    key, i, pos = key[order], i[order], pos[order]
    start = changes(key)
    size = np.diff(np.append(start, len(key)))
    several = i[start] < i[start + size - 1]  # the task itself holds it in two documents
    each = np.repeat(several, size)
    out = []
    for kind, k, n, x, p in ((SINGLE, key[~each], None, i[~each], pos[~each]), (SEVERAL, key[start[several]], size[several], None, None)):
        part = (k % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cut = changes(part)
        for a, b in zip(cut, np.append(cut[1:], len(part))):
            s = order[a:b]
            out.append((int(part[a]), kind, k[s].tobytes(), b"" if x is None else x[s].tobytes(),
                        n[s].astype(np.uint32).tobytes() if p is None else p[s].tobytes()))
    i, pos = i[each], pos[each]
    order = np.lexsort((pos, i))
    i, pos = i[order], pos[order]
    cut = changes(i)
    for a, b in zip(cut, np.append(cut[1:], len(i))):
        out.append((int(i[a] % buckets), KNOWN, b"", i[a: a + 1].tobytes(), pos[a:b].tobytes()))
    yield pd.DataFrame(out, columns=["bucket", "kind", "key", "ids", "at"])


def _shared_prefixes(group: int):
    """Per group: document and position of every suffix whose prefix another
    document has; then, at position -1, prefixes with more than ``group`` suffixes."""
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda col, kind, t: np.frombuffer(b"".join(pdf.loc[pdf["kind"] == kind, col]), dtype=t)
        key, i, pos = join("key", SINGLE, np.uint64), join("ids", SINGLE, np.int64), join("at", SINGLE, np.uint32)
        known, counts = join("key", SEVERAL, np.uint64), join("at", SEVERAL, np.uint32)
        order = np.lexsort((i, key))
        key, i, pos = key[order], i[order], pos[order]
        start = changes(key)
        size = np.diff(np.append(start, len(key)))
        seen = np.unique(known)
        shared = (i[start] < i[start + size - 1]) if len(key) else np.zeros(0, dtype=bool)
        shared |= np.isin(key[start], seen)
        each = np.repeat(shared, size)
        total_keys, back = np.unique(np.concatenate((key[start], known)), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate((size, counts)), minlength=len(total_keys))
        long_ = total_keys[total > group]
        known_at = pdf.loc[pdf["kind"] == KNOWN, "at"]
        i = np.concatenate((i[each], np.repeat(join("ids", KNOWN, np.int64), known_at.str.len().to_numpy(dtype=np.int64) // 4)))
        pos = np.concatenate((pos[each], join("at", KNOWN, np.uint32))).astype(np.int32)
        n = len(long_)  # a row per suffix, then a row per long prefix (with no position)
        return pd.DataFrame({"ord": np.concatenate((i, long_.view(np.int64))), "at": np.concatenate((pos, np.full(n, -1, np.int32)))})

    return rows


# --- 2. and 3. groups and subtrees ------------------------------------------

RECORD, MARKED = 0, 1
HEAD = np.dtype([("ord", "<i8"), ("crc", "<i8"), ("first", "<u4"), ("words", "<u4")])


def _group_rows(window: int, prefix: int, buckets: int, long_shared):
    """Records of the surviving suffixes, packed by group: HEAD, then the words' codes, compressed."""
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unzip, zip_, coder = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), Coder()
        long_ = np.frombuffer(long_shared.value, dtype=np.uint64)
        held: dict[int, tuple[list, list]] = {}
        lows: dict[bytes, tuple[int, int, int]] = {}
        n = 0

        def put(bucket: int, head: tuple, data: bytes) -> None:
            h, d = held.setdefault(bucket, ([], []))
            h.append(head)
            d.append(data)

        def flush():
            for data, (i, crc, first) in lows.items():
                put(int.from_bytes(hashlib.blake2b(data, digest_size=7).digest(), "little") % buckets, (i, crc, first, window), data)
            lows.clear()
            # Records of a group share their words, so their codes shrink well.
            out = [(b, RECORD, np.array(h, dtype=HEAD).tobytes(), zip_.compress(b"".join(d))) for b, (h, d) in held.items()]
            held.clear()
            return out

        marked: list[tuple[int, int, int]] = []
        for pdf in it:
            for i, crc, z, chosen in zip(pdf["ord"], pdf["crc"], pdf["z"], pdf["at"]):
                words = unzip.decompress(z).split()
                if len(words) < window:
                    continue
                codes = codes_of(coder, words)
                h, pick = picked(codes, window, prefix)
                wanted = np.unique(np.asarray(chosen, dtype=np.int64))
                start = changes(pick)
                end = np.append(start[1:], len(pick))
                hit = np.isin(pick[start], wanted)
                start, end = start[hit], end[hit]
                key = h[pick[start]]
                coded = codes.tobytes()
                is_long = np.isin(key, long_) if len(long_) else np.zeros(len(key), dtype=bool)
                part = (key % np.uint64(buckets)).astype(np.int64).tolist()
                for a, b, p, more in zip(start.tolist(), end.tolist(), part, is_long.tolist()):
                    if not more:
                        put(p, (i, crc, a, b - a + window - 1), coded[WORD * a: WORD * (b + window - 1)])
                        n += 1
                        continue
                    for w in range(a, b):  # the whole window is the prefix: one row for all of a task
                        data = coded[WORD * w: WORD * (w + window)]
                        low = lows.get(data)
                        if low is None or i < low[0]:
                            lows[data] = (i, crc, w)
                            if low is not None:
                                marked.append(low)
                        elif low[0] < i:
                            marked.append((i, crc, w))
                        else:  # the same id again: it shares the fate of the smallest
                            put(int.from_bytes(hashlib.blake2b(data, digest_size=7).digest(), "little") % buckets, (i, crc, w, window), data)
                        n += 1
            if n >= FLUSH:
                yield _packed(flush(), marked, buckets)
                marked, n = [], 0
        yield _packed(flush(), marked, buckets)

    return rows


def _packed(rows: list[tuple], marked: list[tuple[int, int, int]], buckets: int) -> pd.DataFrame:
    if marked:
        m = np.array([(i, crc, w, 1) for i, crc, w in marked], dtype=HEAD)
        part = m["ord"] % buckets
        for b in np.unique(part):
            rows.append((int(b), MARKED, m[part == b].tobytes(), b""))
    return pd.DataFrame(rows, columns=["bucket", "kind", "head", "words"])


def _subtree(window: int):
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        rec = pdf["kind"] == RECORD
        head = np.frombuffer(b"".join(pdf.loc[rec, "head"]), dtype=HEAD)
        done = np.frombuffer(b"".join(pdf.loc[~rec, "head"]), dtype=HEAD)
        raw = np.frombuffer(b"".join(map(unzip.decompress, pdf.loc[rec, "words"])), dtype=np.uint64)
        n = head["words"].astype(np.int64) - window + 1  # suffixes of each record
        begin = np.cumsum(head["words"].astype(np.int64)) - head["words"]
        owner = np.repeat(np.arange(len(head)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[owner] + step
        suffix = np.lib.stride_tricks.sliding_window_view(raw, window)[at] if len(at) else np.zeros((0, window), np.uint64)
        ids = head["ord"][owner]
        # Leaves in order of their words; a common prefix of a whole window joins neighbours in one deep node.
        order = np.argsort(_sortable(suffix), kind="stable")
        s = suffix[order]
        depth = np.argmin(np.concatenate((s[1:] == s[:-1], np.zeros((max(len(s) - 1, 0), 1), bool)), axis=1), axis=1)
        start = np.flatnonzero(np.concatenate(([True], depth < window))) if len(s) else np.zeros(0, dtype=np.int64)
        low = np.minimum.reduceat(ids[order], start) if len(s) else ids
        size = np.diff(np.append(start, len(s)))
        above = np.zeros(len(owner), dtype=bool)
        above[order] = ids[order] > np.repeat(low, size)
        # Marked windows as intervals of starts: neighbours of one record run together.
        first = above & ~np.concatenate(([False], above[:-1] & (owner[1:] == owner[:-1]))) if len(above) else above
        last = above & ~np.concatenate((above[1:] & (owner[1:] == owner[:-1]), [False])) if len(above) else above
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        o, f = head["ord"][owner], head["first"][owner].astype(np.int64)
        return pd.DataFrame({"ord": np.concatenate((o[a], done["ord"])), "crc": np.concatenate((head["crc"][owner][a], done["crc"])),
                             "a": np.concatenate((f[a] + step[a], done["first"])).astype(np.int64),
                             "b": np.concatenate((f[b] + step[b], done["first"])).astype(np.int64)})

    return rows


def _sortable(suffix: np.ndarray) -> np.ndarray:
    """Rows as byte strings whose order is that of their bytes."""
    return np.ascontiguousarray(suffix).view(f"V{WORD * suffix.shape[1]}").ravel()


# --- the operator -----------------------------------------------------------

def _zipped():
    @F.pandas_udf("binary")
    def column(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for texts in it:
            yield pd.Series([c.compress(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    return column


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ord (the id, null last), crc (tells rows of one id apart) and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("crc"),
                       text.alias("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP,
                     id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(ord, crc, a, b): windows starting at words a..b of the document start in
    a document with a smaller id too."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffix")
    texts = _texts(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    picks = size // 6 * 2 // (window - prefix + 2)  # about six bytes a word, two picks per window's span
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), picks // BUCKET + 1)
    group = max(group, picks // MOST_LONG)
    sent = (texts.select("ord", "text")
            .mapInPandas(_prefix_rows(window, prefix, buckets), "bucket long, kind int, key binary, ids binary, at binary"))
    shared = scratch.keep(sent.groupBy("bucket").applyInPandas(_shared_prefixes(group), "ord long, at int"),
                          "shared")
    long_ = shared.filter("at < 0").select("ord").toPandas()["ord"]  # at most MOST_LONG
    long_ = spark.sparkContext.broadcast(np.sort(long_.to_numpy(dtype=np.int64).view(np.uint64)).tobytes())
    chosen = shared.filter("at >= 0").groupBy("ord").agg(F.collect_list("at").alias("at"))
    zipped = texts.select("ord", "crc", _zipped()("text").alias("z"))
    left = zipped.join(chosen.hint("merge"), "ord").select("ord", "crc", "z", "at")
    packed = left.mapInPandas(_group_rows(window, prefix, buckets, long_), "bucket long, kind int, head binary, words binary")
    return packed.groupBy("bucket").applyInPandas(_subtree(window), "ord long, crc long, a long, b long")


def _covered(n: int, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words the windows starting at a..b cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, np.minimum(b + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def kept_text(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and ``kept`` (the words left, joined
    by one blank)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    marks = scratch.keep(repeated_windows(docs, window, id_col=id_col, text_col=text_col, scratch=scratch, **options), "marks")
    marks = marks.groupBy("ord", "crc").agg(F.collect_list(F.struct("a", "b")).alias("m"))
    marks = marks.select("ord", "crc", F.col("m.a").alias("a"), F.col("m.b").alias("b"))
    zipped = _texts(docs, id_col, text_col).select("ord", "crc", _zipped()("text").alias("z"))

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for pdf in it:
            out = []
            for i, z, a, b in zip(pdf["ord"], pdf["z"], pdf["a"], pdf["b"]):
                words, n_removed = unzip.decompress(z).split(), 0
                n = len(words)
                if a is not None:
                    gone = _covered(n, np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64), window)
                    n_removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((None if i == LAST else i, n, n_removed, b" ".join(words).decode("utf-8", "surrogatepass")))
            got = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])
            yield got.astype({"doc_id": "Int64"})

    return (zipped.join(marks.hint("merge"), ["ord", "crc"], "left").select("ord", "z", "a", "b")
            .mapInPandas(rows, "doc_id long, n_words long, n_removed long, kept string"))
