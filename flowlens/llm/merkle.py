"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs, which end at a blank line. A paragraph of more than
``LONG`` code points is cut into its lines, a long line into sentences and
clauses, and a long clause after words chosen by their own content, so that an
edit moves no cut elsewhere. Sections are runs of leaves ended by a leaf whose
digest says so. Every digest has ``DIGEST`` bytes: a leaf's covers its text, a
section's its leaves' digests, the root's the sections' digests, each with its
level, so every parent can be recomputed from its children and equal roots
mean equal texts. Where roots differ, equal sections are skipped and the first
differing leaf locates the edit.

The fingerprint is the tree as a string: the root (32 hex digits), then per
section ``;``, the first 16 digits of its digest, ``:`` and the first 8 digits
of its leaves' digests; digests are shortened in this string only. Likeness of
two fingerprints is the Dice share of common leaves, 1 only for equal roots.

Defined cases: null text counts as empty; an empty text has a root and no
section. Documents follow each other by descending id, null ids last, equal
ids by text; after the last comes the first. A table of one document has
itself as the next.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = re.compile(r"\n[ \t]*\n\s*")
LINE = re.compile(r"[^\n]*\n+|[^\n]+")
PIECE = re.compile(r"[^\n.!?,;:]*[\n.!?,;:]+[ \t]*|[^\n.!?,;:]+")
WORD = re.compile(r"\S+\s*|\s+")
LONG = 48  # code points; a longer piece is cut after chosen words
WORD_CUT = 4  # one word in so many ends a leaf inside a long piece
SECTION_CUT = 16  # one leaf in so many ends a section

DIGEST = 16  # bytes of every digest
ROOT, SECTION, LEAF = 2 * DIGEST, 16, 8  # hex digits in the string


def paragraphs(text: str) -> Iterator[str]:
    """The text cut after blank lines."""
    start = 0
    for m in BLANK.finditer(text):
        yield text[start: m.end()]
        start = m.end()
    if start < len(text):
        yield text[start:]


def leaves(text: str) -> list[str]:
    """The text cut into leaves; their concatenation is the text."""
    out = []
    for paragraph in paragraphs(text):
        for line in (paragraph,) if len(paragraph) <= LONG else LINE.findall(paragraph):
            for piece in (line,) if len(line) <= LONG else PIECE.findall(line):
                if len(piece) <= LONG:
                    out.append(piece)
                    continue
                held: list[str] = []
                for word in WORD.findall(piece):
                    held.append(word)
                    if zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_CUT == 0:
                        out.append("".join(held))
                        held = []
                if held:
                    out.append("".join(held))
    return out


def node(children: list[bytes], level: bytes) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=DIGEST, person=level).digest()


class Tree:
    """Digests of the root, the sections and their leaves, and the leaves' lengths."""

    __slots__ = ("lengths", "root", "sections")

    def __init__(self, text: str):
        self.sections: list[tuple[bytes, list[bytes]]] = []
        self.lengths: list[int] = []
        held: list[bytes] = []
        for leaf in leaves(text):
            d = hashlib.blake2b(leaf.encode("utf-8", "surrogatepass"), digest_size=DIGEST, person=b"leaf").digest()
            held.append(d)
            self.lengths.append(len(leaf))
            if d[-1] % SECTION_CUT == 0:
                self.sections.append((node(held, b"section"), held))
                held = []
        if held:
            self.sections.append((node(held, b"section"), held))
        self.root = node([d for d, _ in self.sections], b"root").hex()

    def __str__(self) -> str:
        short = [f";{d.hex()[:SECTION]}:{b''.join([x[:LEAF // 2] for x in held]).hex()}" for d, held in self.sections]
        return self.root + "".join(short)


def parse(fingerprint: str) -> tuple[str, list[tuple[str, list[str]]]]:
    root, *sections = fingerprint.split(";")
    return root, [(d, [held[k: k + LEAF] for k in range(0, len(held), LEAF)])
                  for d, held in (s.split(":") for s in sections)]


def _likeness(a_root, a_sections, b_root, b_sections) -> float:
    if a_root == b_root:
        return 1.0
    sa, sb = Counter([d for d, _ in a_sections]), Counter([d for d, _ in b_sections])
    common = sa & sb
    total, same, spare = 0, 0, (Counter(common), Counter(common))
    rest: tuple[list[str], list[str]] = ([], [])
    for side, sections in enumerate((a_sections, b_sections)):
        for d, held in sections:
            total += len(held)
            if spare[side][d] > 0:  # an equal section: nothing below it needs a look
                spare[side][d] -= 1
                same += len(held)
            else:
                rest[side].extend(held)
    same += 2 * sum((Counter(rest[0]) & Counter(rest[1])).values())
    return min(same / total, 1.0 - 1e-9) if total else 0.0


def likeness(a: str, b: str) -> float:
    """Likeness (0 to 1) of two fingerprint strings."""
    return _likeness(*parse(a), *parse(b))


def first_difference(a: Tree, b: Tree) -> int:
    """Code points before the first differing leaf; -1 for equal texts."""
    if a.root == b.root:
        return -1
    leaf = 0
    for (da, ha), (db, hb) in zip(a.sections, b.sections):
        if da != db:
            for x, y in zip(ha, hb):
                if x != y:
                    break
                leaf += 1
            break
        leaf += len(ha)
    return sum(a.lengths[:leaf])


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and ``differs_from`` (code
    points before the first leaf in which the edited text differs, -1 if none).

    Documents meet their successor by range buckets of the id: only each
    bucket's first document is also sent to the bucket before it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("c")).first().c if n > 1 else []
    cuts = sorted(set(cuts or []))  # at most n numbers, whatever the table's size

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:  # descending ids, nulls after all others
        at = len(cuts) - np.searchsorted(np.array(cuts, dtype=np.int64), ids.fillna(0).astype("int64"), side="left")
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, at)).astype("int32")

    rows = rows.withColumn("bucket", bucket(F.col("doc_id")))
    heads = {r.bucket: r.head for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # <= n + 1 rows
    used = sorted(heads)
    first, before = F.lit(False), F.lit(None).cast("int")
    if used:
        pairs = [(F.lit(b), F.lit(heads[b]).cast("long")) for b in used]
        head_of = F.create_map(*[x for p in pairs for x in p])
        first = F.col("doc_id").eqNullSafe(head_of[F.col("bucket")])
        before = F.create_map(*[F.lit(x) for k, b in enumerate(used) for x in (b, used[k - 1])])[F.col("bucket")]
    place = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("tail"))
    also = F.struct(before.alias("b"), F.lit(1).alias("tail"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(first, F.array(place, also)).otherwise(F.array(place))).alias("p"))
    dealt = (dealt.select(F.col("p.b").alias("bucket"), F.col("p.tail").alias("tail"), "doc_id", "text")
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
             .sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text"))
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, differs_from long")
    return dealt.mapInPandas(_fingerprint_rows, schema)


def _fingerprint_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
            "differs_from"]
    held = None  # the row that waits for its successor: (bucket, tail, id, text, tree)
    for pdf in it:
        out = []
        ids = pdf["doc_id"].astype("Int64")
        for b, tail, i, text in zip(pdf["bucket"], pdf["tail"], ids, pdf["text"]):
            if held is not None and held[0] == b and held[1] and tail:
                continue  # several rows carry the first id: the first one is the successor
            tree = Tree(text)
            if held is not None and held[0] == b and not held[1]:
                out.append(_one(held, text, tree))
            held = (b, tail, i, text, tree)
        got = pd.DataFrame(out, columns=cols)
        got["doc_id"] = got["doc_id"].astype("Int64")
        yield got


def _one(held, following: str, next_tree: Tree) -> tuple:
    _, _, i, text, tree = held
    changed = edited(text, following)
    other = tree if changed == text else Tree(changed)
    return (i, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), str(tree), str(other),
            _likeness(tree.root, tree.sections, other.root, other.sections),
            _likeness(tree.root, tree.sections, next_tree.root, next_tree.sections), first_difference(tree, other))
