"""Substring deduplication by a depth-limited radix sort of suffixes (bytes).

Every byte that is covered by a string of ``DEPTH`` bytes which also starts
anywhere else, the same document included, is removed. Suffixes start at every
byte, and only their first ``DEPTH`` bytes are ever looked at: passes over their
bytes, most significant first, split the suffixes into groups that agree so far.
A suffix alone in its group drops out; groups left at ``DEPTH`` are exactly the
repeated windows.

1. Texts. Equal texts enter once, with their number as multiplicity.
2. First digit. Of the ``GRAM``-byte strings inside a window, the one of least
   hash is its anchor; equal windows have equal anchors at equal places.
   Windows that follow each other mostly share an anchor, so one in about 140
   bytes travels: its hash, text number and place. An anchor that occurs once
   has no repeated window, and its suffixes drop out.
3. Ordinary anchors (up to ``GROUP`` occurrences). The bytes under an anchor's
   windows go to the group of anchors that holds it, equal stretches of one task
   as one with their multiplicity. The group sorts its suffixes by digits of 128
   bytes; members that agree in a digit stay, others are sorted by smaller ones.
4. Hot anchors (a passage that a third of all documents share). Their windows
   are taken in runs of ``RUN`` starts, whose common core (``DEPTH - RUN + 1``
   bytes) is the next digit; runs with a core of their own drop out. The last
   digit is the whole window. For both a task sends one row for equal keys, so
   no task ever holds a hot group.
5. Repeated windows return to their text as intervals; the covered bytes go.

Anchors and cores only ever send windows apart or together; a clash of their hashes costs
time, not results. Ordinary windows are compared byte by byte; hot windows stand
for 128 bits of BLAKE2b, and equal texts for SHA-256.
The driver sees counts only; nothing is broadcast.

Defined cases: a null text is the empty one; texts of fewer than ``DEPTH`` bytes
lose nothing. Rows that agree in everything still count as two occurrences; null ids are
ids like others. Kept bytes may be cut inside a code point, so they are binary.
Empty tables give empty results; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch

DEPTH = 400
GRAM = 128
GROUP = 2_000
RUN = 32
BUCKET_BYTES = 6 << 20  # bytes that one group of anchors should hold
FLUSH = 200_000  # anchors that a task gathers before it sends them
FLUSH_BYTES = 24 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BLOCK = 1 << 22  # window starts of a text that are looked at together
PLACE_BITS = 23  # places of a block's anchors


# --- windows and anchors ----------------------------------------------------

def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes that start at every byte (``gram`` a power of two)."""
    h, factor, width = data.astype(np.uint64) + np.uint64(1), int(BASE), 1
    h = (h * MIX) ^ (h << np.uint64(29))
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return h


def anchors(data: np.ndarray, depth: int, gram: int, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """Per anchor: its hash and place, and the first and last start of the windows whose anchor it is."""
    parts = []
    for begin in range(0, len(data) - depth + 1, block):
        key, *places = _block_anchors(data[begin: begin + block + depth - 1], depth, gram)
        parts.append((key, *(x + begin for x in places)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block_anchors(data: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    h = gram_hashes(data, gram)
    h = (h ^ (h >> np.uint64(31))) * MIX
    n, span = len(data) - depth + 1, depth - gram + 1
    # Order by the hash's upper bits; ties go to the first place.
    least = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:n], least[span - width: span - width + n])
    at = (least[:n] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]], at[first], first, np.append(first[1:], n) - 1


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)


WIDTHS = (128, 32, 8)


def radix_groups(data: np.ndarray, at: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes starting at ``at`` share their first ``depth`` bytes with
    others, multiplicities counted: a radix sort, most significant digits first.

    A digit has 128 bytes. Groups whose members agree in it stay as they are;
    only the others are sorted on it, by digits of 32 bytes, and where those differ by
    digits of 8. What is alone in its group drops out at once."""
    out = np.zeros(len(at), dtype=bool)
    if len(at):
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        digits = np.ndarray(len(data) + 1, dtype=">u8", buffer=padded.data, strides=(1,))
        order, _ = _split(digits, at, weight, depth, np.arange(len(at)), np.zeros(len(at), dtype=np.int64), 0, depth, WIDTHS)
        out[order] = True
    return out


def _digit(digits: np.ndarray, at: np.ndarray, done: int, depth: int) -> np.ndarray:
    """Bytes done .. done + 7 of the suffixes, those beyond ``depth`` left out."""
    out = digits[at + done].astype(np.uint64)
    return out >> np.uint64(8 * (8 - depth + done)) if depth - done < 8 else out


def _split(digits, at, weight, depth, order, group, begin, end, widths):
    """Groups (numbered from 0, their members side by side) split by the bytes begin .. end."""
    width = widths[0]
    for done in range(begin, end, width):
        if not len(order):
            break
        here, stop = at[order], min(done + width, end)
        differs = np.zeros(len(order) - 1, dtype=bool)
        for k in range(done, stop, 8):
            digit = _digit(digits, here, k, depth)
            differs |= digit[1:] != digit[:-1]
        new_group = group[1:] != group[:-1]
        hit = np.unique(group[1:][differs & ~new_group])
        if not len(hit) and done:
            continue
        mixed = np.zeros(group[-1] + 1, dtype=bool)
        mixed[hit] = True
        member = mixed[group]
        if width > 8:
            part = _split(digits, at, weight, depth, order[member], _renumbered(group[member]), done, stop, widths[1:])
            rest = _renumbered(group[~member])
            order = np.concatenate((order[~member], part[0]))
            group = np.concatenate((rest, part[1] + (rest[-1] + 1 if len(rest) else 0)))
            continue
        member = np.flatnonzero(member)
        turn = member[np.lexsort((digit[member], group[member]))]
        order[member], digit[member] = order[turn], digit[turn]
        start = np.flatnonzero(np.concatenate(([True], new_group | (digit[1:] != digit[:-1]))))
        size = np.diff(np.append(start, len(order)))
        many = np.add.reduceat(weight[order], start) > 1
        keep = np.repeat(many, size)
        order, group = order[keep], np.repeat(np.cumsum(many) - 1, size)[keep]
    return order, group


def _renumbered(group: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))).astype(np.int64) if len(group) else group


# --- 1. texts ---------------------------------------------------------------

def _zipped(text: Column) -> Column:
    def column(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for texts in it:
            yield pd.Series([c.compress(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    # Typed here: annotations are strings in this module, and Spark would look them up.
    column.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(column, "binary")(text)


def _unzipped(z: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), dtype=np.uint8)


# --- 2. anchors that occur more than once -----------------------------------

PLACES = ("at", "first", "last")
SHARED = "number long, key binary, at binary, first binary, last binary, n binary, hot long"


def _anchor_rows(depth: int, gram: int, buckets: int):
    """Anchors, packed per bucket."""
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in it:
            for text, weight, z in zip(pdf["number"], pdf["copies"], pdf["z"]):
                data = _unzipped(z)
                if len(data) < depth:
                    continue
                key, at, first, last = anchors(data, depth, gram)
                held.append((key, np.full(len(key), text, np.int64), at, first, last, np.full(len(key), min(weight, 2), np.int64)))
                n += len(key)
                if n >= FLUSH:
                    yield _pack(held, buckets)
                    held, n = [], 0
        if held:
            yield _pack(held, buckets)

    return rows


def _pack(held: list, buckets: int) -> pd.DataFrame:
    key, text, at, first, last, weight = (np.concatenate(x) for x in zip(*held))
    part = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = _starts(part[order])
    out = []
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        s = order[a:b]
        out.append((int(part[s[0]]), key[s].tobytes(), text[s].tobytes(), *(x[s].astype(np.uint32).tobytes() for x in (at, first, last)),
                    weight[s].astype(np.uint8).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "key", "text", "at", "first", "last", "weight"])


def _shared_anchors(group: int):
    """Per text: the anchors that occur elsewhere too, with their numbers of
    occurrences, and how many of them are hot."""
    return lambda pdf: _shared(pdf, group)


def _shared(pdf: pd.DataFrame, group: int) -> pd.DataFrame:
    column = lambda name, t: np.frombuffer(b"".join(pdf[name]), dtype=t)
    key, text = column("key", np.uint64), column("text", np.int64)
    places, weight = [column(c, np.uint32) for c in PLACES], column("weight", np.uint8).astype(np.int64)
    order = np.argsort(key, kind="stable")
    start = _starts(key[order])
    size = np.diff(np.append(start, len(key)))
    total = np.add.reduceat(weight[order], start) if len(key) else weight
    keep = np.repeat(total > 1, size)
    s, n = order[keep], np.repeat(size, size)[keep]
    by_text = np.argsort(text[s], kind="stable")
    s, n = s[by_text], n[by_text]
    cut = _starts(text[s])
    out = [(int(text[s[a]]), key[s[a:b]].tobytes(), *(x[s[a:b]].tobytes() for x in places), n[a:b].astype(np.int64).tobytes(), int((n[a:b] > group).sum()))
           for a, b in zip(cut, np.append(cut[1:], len(s)))]
    return pd.DataFrame(out, columns=["number", "key", *PLACES, "n", "hot"])


def _chosen(key, at, first, last, n):
    """One text's shared anchors, its lists of all buckets joined."""
    joined = lambda parts, t: np.frombuffer(b"".join(parts), dtype=t)
    return joined(key, np.uint64), *(joined(x, np.uint32).astype(np.int64) for x in (at, first, last)), joined(n, np.int64)


# --- 3. ordinary anchors ----------------------------------------------------

HEAD = np.dtype([("text", "<i8"), ("first", "<u4"), ("bytes", "<u4"), ("weight", "<i8")])


def _stretch_rows(depth: int, buckets: int, group: int):
    """Bytes under the windows of ordinary anchors, packed per bucket; equal
    stretches of a task go once. The others' windows are thereby known to repeat:
    they travel as marks beside them."""
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list] = {}
        known: dict[int, list] = {}
        n_bytes = 0

        def flush() -> pd.DataFrame:
            packed: dict[int, tuple[list, list]] = {}
            for data, (bucket, text, first, weight) in held.items():
                heads, parts = packed.setdefault(bucket, ([], []))
                heads.append((text, first, len(data), weight))
                parts.append(data)
            out = [(b, np.array(h, dtype=HEAD).tobytes(), b"".join(p), np.array(known.get(b, []), dtype=np.int64).tobytes())
                   for b, (h, p) in packed.items()]  # a mark's first stretch is in the same bucket
            held.clear()
            known.clear()
            return pd.DataFrame(out, columns=["bucket", "heads", "data", "known"])

        for pdf in it:
            for text, weight, z, *parts in pdf[["number", "copies", "z", "key", *PLACES, "n"]].itertuples(index=False):
                key, _, first, last, n = _chosen(*parts)
                cold = n <= group
                if not cold.any():
                    continue
                data = _unzipped(z).tobytes()
                for k, a, b in zip((key[cold] % np.uint64(buckets)).tolist(), first[cold].tolist(), last[cold].tolist()):
                    stretch = data[a: b + depth]
                    seen = held.get(stretch)
                    if seen is None:
                        held[stretch] = [k, text, a, min(weight, 2)]
                        n_bytes += len(stretch)
                    else:
                        seen[3] = 2
                        known.setdefault(k, []).append((text, a, b))
                if n_bytes >= FLUSH_BYTES:
                    yield flush()
                    n_bytes = 0
        yield flush()

    return rows


def _sorted_group(depth: int):
    """Radix sort of a group's suffixes; repeated windows as (number, a, b)."""
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        head = np.frombuffer(b"".join(pdf["heads"]), dtype=HEAD)
        data = np.frombuffer(b"".join(pdf["data"]), dtype=np.uint8)
        known = np.frombuffer(b"".join(pdf["known"]), dtype=np.int64).reshape(-1, 3)
        size = head["bytes"].astype(np.int64)
        n = size - depth + 1  # suffixes of each stretch
        owner = np.repeat(np.arange(len(head)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        hit = radix_groups(data, (np.cumsum(size) - size)[owner] + step, head["weight"][owner], depth)
        found = _intervals(hit, owner, head["text"], head["first"].astype(np.int64)[owner] + step)
        return pd.concat([found, pd.DataFrame(known, columns=["number", "a", "b"])])

    return rows


def _intervals(hit: np.ndarray, owner: np.ndarray, text: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Neighbouring hits of one owner as (number, a, b)."""
    follows = np.concatenate(([False], hit[:-1] & (owner[1:] == owner[:-1]))) if len(hit) else hit
    goes_on = np.concatenate((hit[1:] & (owner[1:] == owner[:-1]), [False])) if len(hit) else hit
    a, b = np.flatnonzero(hit & ~follows), np.flatnonzero(hit & ~goes_on)
    return pd.DataFrame({"number": text[owner[a]].astype(np.int64), "a": at[a].astype(np.int64), "b": at[b].astype(np.int64)})


# --- 4. hot anchors ---------------------------------------------------------

class Combiner:
    """Keys of a task with a place each, (text, a, b), equal keys once. What the task saw
    twice is known to repeat: its key goes without a place, its places go as they are."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.known = buckets, {}, []

    def add(self, key: bytes, place: tuple[int, int, int], weight: int) -> None:
        seen = self.held.get(key)
        if seen is None:
            self.held[key] = (min(weight, 2), place)
            return
        if seen[1] is not None:
            self.known.append(seen[1])
            self.held[key] = (2, None)
        self.known.append(place)

    def full(self) -> bool:
        return len(self.held) + len(self.known) >= FLUSH

    def rows(self) -> pd.DataFrame:
        """Packed: one row per bucket of keys, one row per text for known places."""
        items = np.array([(k, n, *(p or (-1, 0, 0))) for k, (n, p) in self.held.items()], dtype=ITEM)
        part = np.frombuffer(items["key"].tobytes(), dtype=np.uint64)[::2] % np.uint64(self.buckets)
        items = items[np.argsort(part, kind="stable")]
        part = np.sort(part)
        cut = _starts(part)
        out = [(int(part[a]), None, items[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(items)))]
        out += [(None, number, places) for number, places in _by_text(np.array(self.known, dtype=np.int64).reshape(-1, 3))]
        self.held.clear()
        self.known.clear()
        return pd.DataFrame(out, columns=["bucket", "number", "packed"]).astype({"bucket": "Int64", "number": "Int64"})


ITEM = np.dtype([("key", "V16"), ("n", "<i8"), ("text", "<i8"), ("a", "<i8"), ("b", "<i8")])
PACKED = "bucket long, number long, packed binary"


def _by_text(places: np.ndarray) -> list[tuple[int, bytes]]:
    """(text, its a and b packed) of rows (text, a, b); runs that touch become one."""
    order = np.lexsort((places[:, 1], places[:, 0]))
    p = places[order]
    if not len(p):
        return []
    first = np.concatenate(([True], (p[1:, 0] != p[:-1, 0]) | (p[1:, 1] > p[:-1, 2] + 1)))
    runs = np.stack((p[first, 1], p[np.append(first[1:], True), 2]), axis=1)
    text = p[first, 0]
    cut = _starts(text)
    return [(int(text[a]), runs[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(text)))]


def _repeated_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places of a bucket's keys that occur more than once. A task sent a key
    once or so, hence a key has about as many items as there are tasks."""
    items = np.frombuffer(b"".join(pdf["packed"]), dtype=ITEM)
    halves = np.frombuffer(items["key"].tobytes(), dtype=np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    halves, items = halves[order], items[order]
    start = np.flatnonzero(np.concatenate(([True], (halves[1:] != halves[:-1]).any(axis=1))))
    size = np.diff(np.append(start, len(items)))
    hit = np.repeat(np.add.reduceat(items["n"], start) > 1, size) & (items["text"] >= 0)
    found = np.stack([items[c][hit] for c in ("text", "a", "b")], axis=1)
    return pd.DataFrame(_by_text(found), columns=["number", "packed"]).astype({"number": "int64"})


def _repeated(rows: DataFrame) -> DataFrame:
    """(number, packed): a text's places whose keys occur more than once."""
    many = rows.filter("bucket IS NOT NULL").groupBy("bucket").applyInPandas(_repeated_keys, "number long, packed binary")
    return many.unionByName(rows.filter("bucket IS NULL").select("number", "packed"))


def _unpacked(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.int64).reshape(-1, 2)


def _core_rows(depth: int, group: int, run: int, buckets: int):
    """Runs of window starts under hot anchors, by the hash of what all windows of a run hold."""
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        combined = Combiner(buckets)
        for pdf in it:
            for text, weight, z, *parts in pdf[["number", "copies", "z", "key", *PLACES, "n"]].itertuples(index=False):
                _, at, first, last, n = _chosen(*parts)
                hot = n > group
                if not hot.any():
                    continue
                data = _unzipped(z).tobytes()
                for p, a, b in zip(at[hot].tolist(), first[hot].tolist(), last[hot].tolist()):
                    # Runs are counted from the anchor: where a and b fall depends on what stands around it.
                    for k in range((p - b) // run, (p - a) // run + 1):
                        d = p - k * run  # the run's last start, so its windows share the bytes from d on
                        combined.add(xxhash.xxh3_128_digest(data[d: d - run + 1 + depth]), (text, max(a, d - run + 1), min(b, d)), weight)
                if combined.full():
                    yield combined.rows()
        yield combined.rows()

    return rows


def _window_rows(depth: int, buckets: int):
    """The windows of runs whose core repeats."""
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        combined = Combiner(buckets)
        for pdf in it:
            for text, weight, z, packed in zip(pdf["number"], pdf["copies"], pdf["z"], pdf["packed"]):
                data = _unzipped(z).tobytes()
                for a, b in _unpacked(packed).tolist():
                    for s in range(a, b + 1):
                        combined.add(hashlib.blake2b(data[s: s + depth], digest_size=16).digest(), (text, s, s), weight)
                if combined.full():
                    yield combined.rows()
        yield combined.rows()

    return rows


def _mark_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        runs = [_unpacked([p]) for p in pdf["packed"]]
        both = np.concatenate([*runs, np.zeros((0, 2), np.int64)])
        yield pd.DataFrame({"number": np.repeat(pdf["number"].to_numpy(), [len(r) for r in runs]), "a": both[:, 0], "b": both[:, 1]})


def _hot_marks(joined: DataFrame, texts: DataFrame, depth: int, group: int, run: int, hot: int, shuffles: int, scratch: Scratch) -> DataFrame:
    buckets = lambda per_anchor: max(shuffles, hot * per_anchor // BUCKET_BYTES + 1)
    span = depth - GRAM // 2  # window starts of an anchor, more than their mean
    cores = scratch.keep(joined.filter("hot > 0").mapInPandas(
        _core_rows(depth, group, run, buckets((span // run + 1) * ITEM.itemsize)), PACKED), "cores")
    runs = _repeated(cores).groupBy("number").agg(F.collect_list("packed").alias("packed"))  # a text's own runs
    left = texts.join(runs.hint("merge"), "number").select("number", "copies", "z", "packed")
    windows = scratch.keep(left.mapInPandas(_window_rows(depth, buckets(span * ITEM.itemsize)), PACKED), "windows")
    return _repeated(windows).mapInPandas(_mark_rows, "number long, a long, b long")


# --- the operator -----------------------------------------------------------

def distinct_texts(docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """digest, number, copies, n_bytes and z (the text, compressed) of every distinct text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
                       _zipped(text).alias("z"))
    one = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("z").alias("z"))
    return scratch.keep(one.withColumn("number", F.monotonically_increasing_id()), "texts")


def repeated_windows(texts: DataFrame, scratch: Scratch, depth: int = DEPTH, gram: int = GRAM, group: int = GROUP, run: int = RUN,
                     buckets: int | None = None) -> DataFrame:
    """(number, a, b): windows starting at bytes a..b of the text start elsewhere too."""
    spark = texts.sparkSession
    run = min(run, (depth + 1) // 2)  # windows of a run must share bytes
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum("n_bytes")).first()[0] or 0
    n_anchors = 2 * size // (depth - gram + 2)  # expected: two a span of window places
    many = buckets or max(shuffles, n_anchors // FLUSH + 1)
    sent = texts.select("number", "copies", "z").filter(F.col("n_bytes") >= depth).mapInPandas(
        _anchor_rows(depth, gram, many), "bucket long, key binary, text binary, at binary, first binary, last binary, weight binary")
    shared = scratch.keep(sent.groupBy("bucket").applyInPandas(_shared_anchors(group), SHARED), "shared")
    totals = shared.agg(F.sum(F.octet_length("key")), F.sum("hot")).first()
    n_shared, hot = (totals[0] or 0) // 8, totals[1] or 0
    chosen = shared.groupBy("number").agg(*[F.collect_list(c).alias(c) for c in ("key", *PLACES, "n")], F.sum("hot").alias("hot"))  # a text's own anchors
    joined = scratch.keep(texts.join(chosen.hint("merge"), "number").select("number", "copies", "z", "key", *PLACES, "n", "hot"), "chosen")
    many = buckets or max(shuffles, n_shared * (depth + (depth - gram) // 2) // BUCKET_BYTES + 1)
    stretches = joined.mapInPandas(_stretch_rows(depth, many, group), "bucket long, heads binary, data binary, known binary")
    sorted_ = stretches.groupBy("bucket").applyInPandas(_sorted_group(depth), "number long, a long, b long")
    return sorted_.unionByName(_hot_marks(joined, texts, depth, group, run, hot, shuffles, scratch))


def _cut(data: np.ndarray, a, b, depth: int) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and the bytes left."""
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edge, np.asarray(a, dtype=np.int64), 1)
    np.add.at(edge, np.asarray(b, dtype=np.int64) + depth, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
    return int(gone.sum()), spans, data[~gone].tobytes()


def kept_bytes(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and ``kept`` (the bytes left)."""
    scratch = Scratch(docs.sparkSession, "suffixarray")
    texts = distinct_texts(docs, text_col, scratch)
    marks = scratch.keep(repeated_windows(texts, scratch, depth, **options), "marks")
    marks = marks.groupBy("number").agg(F.collect_list(F.struct("a", "b")).alias("m"))
    marks = marks.select("number", F.col("m.a").alias("a"), F.col("m.b").alias("b"))

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for digest, z, a, b in zip(pdf["digest"], pdf["z"], pdf["a"], pdf["b"]):
                data = _unzipped(z)
                out.append((digest, len(data), *((0, 0, data.tobytes()) if a is None else _cut(data, a, b, depth))))
            yield pd.DataFrame(out, columns=["digest", "n_bytes", "n_removed", "n_spans", "kept"])

    done = (texts.join(marks.hint("merge"), "number", "left").select("digest", "z", "a", "b")
            .mapInPandas(rows, "digest binary, n_bytes long, n_removed long, n_spans long, kept binary"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("d_digest"))
    return (ids.join(done.hint("merge"), F.col("d_digest") == F.col("digest"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept"))
