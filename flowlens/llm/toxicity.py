"""Toxicity of obfuscated text: noisy-channel restoration, then scoring.

Restoration. A word that shows obfuscation (leetspeak signs among letters, a
sign between letters, a repeated letter, letters set apart by blanks) is read
as the output of a noisy channel. Its lattice has, per character, the letters
that the sign may stand for, dropping the sign, ending the word there, or
dropping a repeated letter, each at a cost. Viterbi decoding under a character
trigram model picks the likeliest path. Other words have a lattice of one path
and stay as they are. A word whose only sign is a doubled letter is scored both
as it is and as decoded; where no form that decoding can give has a lift, the
word scores nothing either way and is not decoded.

Letters set apart by blanks are decoded in overlapping stretches, as one word
and with word ends between letters; every part of 3 to 14 letters of what they
spell may be a word too, as the blanks between words are lost.

The character model is counted over all documents. The counts have a fixed
size (64 letter classes, three deep), whatever the corpus.

Scoring. Every restored word has its text and its first letters as features.
From the labelled training rows each feature gets the share of toxic documents
among those that have it, shrunk towards the share of the next shorter prefix;
a word's lift is the log-odds of its most specific known feature above the
base rate. A document's evidence is its largest lift and the sum of its words'
lifts, absolute and per word, and a logistic regression turns that into a
score. The regression is fitted on one half of the training rows with lifts
from the other half, so it does not trust words merely for having been seen.
The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, those with
the smallest hash of the id (a parameter), and keeps all their telling features and
those longer ones that tell a harmless word from a telling prefix, so the
number of features is bounded by these rows. Every document is scored, whole.

Defined cases: null text counts as empty; an empty text scores what the curve
gives for no evidence. Several labels of one id count as toxic if any is. With
labels of one class only (or none) every score is the smoothed share of toxic
labels. A null id is held out or not by the CRC of the empty string.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch

TRAIN_ROWS = 20_000
MIN_TOXIC = 2  # toxic training documents that a telling feature must occur in
MIN_LIFT = 0.5  # log-odds above the base rate of a telling feature
SHRINK = 8.0  # strength of the prior, in documents
FAINT = 1.5  # lifts up to this do not add up: long texts have many by chance
SUPPORT = 5  # training documents that a harmless longer feature must occur in
EVIDENCE = 4  # numbers that describe a document
CACHE = 40_000  # readings of tokens that a training task holds
HELD = 50_000  # lifts of tokens that a worker holds; a common token is soon back after a purge
PREFIXES = (4, 5, 6)
HEAD = PREFIXES[0]

# The letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "€": "e",
    "£": "l", "¥": "y", "¢": "c", "*": "aeiou", "#": "h", "%": "o", "&": "a", "§": "s",
}
# Channel costs: a sign read as a letter; a letter doubled or drawn out; a sign
# dropped or ending the word, for separators, signs with a reading, and digits.
SUBSTITUTE, DOUBLED, DRAWN_OUT = -0.7, -6.0, -0.5
SEPARATOR, SIGN, DIGIT = (-0.5, 0.0), (-5.0, -3.0), (-8.0, -8.0)
APART = -2.0  # a word end between letters that all stand apart
PART = (3, 14)  # letters of a word among letters that stand apart
STRETCH = 96  # letters decoded at once; half of them are decoded in the next stretch too
TWICE, RUN = re.compile(r"(.)\1"), re.compile(r"(.)\1+")
EDGES = string.punctuation + "…“”„«»‘’¿¡"
SIZE = 64  # letter classes: 0 none, 1-26 a-z, 27-59 U+00DF-U+00FF, 60 any other letter
OTHER = 60


def letter_classes() -> np.ndarray:
    """Class of each code point below 256; other code points are looked up by isalpha."""
    t = np.zeros(256, dtype=np.uint8)
    t[ord("a"): ord("z") + 1] = np.arange(1, 27)
    t[0xDF: 0x100] = np.arange(27, 60)
    t[0xF7] = 0
    return t


CLASSES = letter_classes()


def class_of(ch: str) -> int:
    o = ord(ch)
    return int(CLASSES[o]) if o < 256 else (OTHER if ch.isalpha() else 0)


def trigrams(text: str) -> np.ndarray:
    """Trigram indexes of a text's letter classes (lower-cased)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = CLASSES[np.minimum(codes, 255)].astype(np.int32)
    c[codes > 255] = OTHER
    c = np.concatenate(([0, 0], c, [0])).astype(np.int32)
    keep = (c[1:-1] > 0) | (c[2:] > 0)  # no runs of blanks
    return ((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:])[keep]


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probability of a letter class after two others, from all documents."""
    def partial(it):
        n = np.zeros(SIZE ** 3, dtype=np.int64)
        for pdf in it:
            part = []
            for t in pdf["text"]:
                if t:
                    for k in range(0, len(t), 1 << 20):
                        part.append(trigrams(t[k: k + (1 << 20)]))
            if part:
                n += np.bincount(np.concatenate(part), minlength=SIZE ** 3)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"k": at, "n": n[at]})

    got = (docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(partial, "k int, n long")
           .groupBy("k").agg(F.sum("n").alias("n")).toPandas())
    n = np.zeros(SIZE ** 3)
    n[got["k"].to_numpy(dtype=int)] = got["n"].to_numpy(dtype=float)
    n = n.reshape(SIZE, SIZE, SIZE)
    share = lambda x: (x + 1e-3) / (x + 1e-3).sum(axis=-1, keepdims=True)
    two, one = share(n.sum(axis=0)), share(n.sum(axis=(0, 1)))
    weight = n.sum(axis=2, keepdims=True)
    three = (n + 5.0 * two[None]) / (weight + 5.0)
    return np.log(0.95 * three + 0.04 * two[None] + 0.01 * one).astype(np.float32)


class Restorer:
    """Viterbi decoding of obfuscated words under the character model."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp.tolist()

    @staticmethod
    def noisy(word: str) -> bool:
        if word.isalpha():
            return TWICE.search(word) is not None
        return any(c.isalpha() for c in word) and len(word) > 2

    def decode(self, word: str, doubled: float = DOUBLED, apart: float | None = None) -> str:
        """The likeliest plain reading; blanks part it where words end. With
        ``apart``, a word may end after any letter at that cost."""
        logp, states = self.logp, {(0, 0): (0.0, "")}
        runs = [(c, n, k) for c, g in groupby(word.lower()) for n in [len(list(g))] for k in range(n)]
        for ch, length, place in runs:
            if apart is not None:
                for (a, b), (score, out) in list(states.items()):
                    s = score + apart + logp[a][b][0]
                    if b and ((b, 0) not in states or states[b, 0][0] < s):
                        states[b, 0] = (s, out + " ")
            k = class_of(ch)
            if k:
                options = [(ch, k, 0.0)]
                drop = None if place == 0 else doubled if length == 2 else DRAWN_OUT
            else:
                drop, ends = DIGIT if ch.isdigit() else SIGN if ch in LEET else SEPARATOR
                options = [(c, class_of(c), SUBSTITUTE) for c in LEET.get(ch, "")] + [(" ", 0, ends)]
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, out) in states.items():
                if drop is not None and ((a, b) not in new or new[a, b][0] < score + drop):
                    new[a, b] = (score + drop, out)
                row = logp[a][b]
                for c, cls, cost in options:
                    if cls == 0 and b == 0:
                        s, key, text = score + cost, (a, b), out
                    else:
                        s, key, text = score + cost + row[cls], (b, cls), out + c
                    if key not in new or new[key][0] < s:
                        new[key] = (s, text)
            states = new
        return max(((s + logp[a][b][0], out) for (a, b), (s, out) in states.items()))[1].strip()

    def readings(self, token: str) -> list[str]:
        """Plain words of one blank-separated token."""
        low = token.lower()
        core = low.strip(EDGES)
        if core and (core.isalpha() and not self.noisy(core)):
            out = [core]
            if core is not low and low[0] in LEET and len(low) > len(core):
                out += self.decode(low.rstrip(EDGES)).split()  # a sign in front may be the first letter
            return out
        out = [core] if core.isalpha() else []  # a repeated letter may be right
        for form in {core, low.rstrip(EDGES)} if core else ():
            if self.noisy(form):
                out += self.decode(form).split()
                if any(a == b for a, b in zip(form, form[1:])):
                    out += self.decode(form, DRAWN_OUT).split()
            elif form:
                out.append(form)
        return list(dict.fromkeys(out))

    def spaced(self, letters: str) -> Iterator[str]:
        """Readings of letters that stood apart, one by one: the words of every decoding, and
        any part of the letters, as they are and as decoded. Some come twice."""
        low = letters.lower()
        yield from parts("".join(LEET[c][0] if c in LEET and not c.isalpha() else c for c in low))
        for stretch, first, last in stretches(low):
            for got in {self.decode(stretch), self.decode(stretch, DRAWN_OUT), self.decode(stretch, apart=APART)}:
                words = got.split()
                # A word at a cut may be a piece; the stretch that overlaps there has it whole.
                yield from (w for w in words[not first: len(words) - (not last)] if len(w) >= PART[0])
                yield from parts("".join(words))

    def restore(self, text: str) -> str:
        """The text with obfuscated words restored."""
        out, tokens, k = [], text.split(), 0
        while k < len(tokens):
            end = k
            while end < len(tokens) and len(tokens[end]) == 1:
                end += 1
            if end - k >= 3:
                out.append(self.decode("".join(tokens[k:end])))
                k = end
                continue
            t = tokens[k]
            word = t.rstrip(EDGES) if t[0] in LEET else t.strip(EDGES)
            out.append(self.decode(word) if self.noisy(word) else t)
            k += 1
        return " ".join(out)


def parts(letters: str) -> Iterator[str]:
    """Every part of PART letters."""
    least, most = PART
    return (letters[i: j] for i in range(len(letters)) for j in range(i + least, min(len(letters), i + most) + 1))


def stretches(letters: str) -> Iterator[tuple[str, bool, bool]]:
    """Overlapping stretches of at most STRETCH letters, and whether each is the
    first and the last. Letters drawn out further than three times count as three:
    the channel drops any number of them at one cost each."""
    letters = "".join(c * min(len(list(g)), 3) if c.isalpha() else "".join(g) for c, g in groupby(letters))
    step = STRETCH // 2
    for k in range(0, max(len(letters) - step, 1), step):
        yield letters[k: k + STRETCH], k == 0, k + STRETCH >= len(letters)


def dropped(word: str, most: int = 64) -> list[str] | None:
    """Every form that decoding a word of letters can give: each repeated letter
    kept or dropped. None if there are more than ``most``."""
    runs = [(c, len(list(g))) for c, g in groupby(word)]
    if math.prod(n for _, n in runs) > most:
        return None
    out = [""]
    for c, n in runs:
        out = [w + c * k for w in out for k in range(1, n + 1)]
    return out


def features(word: str) -> list[str]:
    """From the most specific to the least."""
    return ["=" + word, *[word[:k] for k in reversed(PREFIXES) if len(word) > k]]


def document_words(r: Restorer, text: str, cache: dict[str, list[str]]) -> Iterator[list[str]]:
    tokens = text.split()
    for t in set(tokens):
        got = cache.get(t)
        if got is None:
            if len(cache) >= CACHE:
                cache.clear()
            got = cache[t] = r.readings(t)
        yield got
    for run in spaced_runs(tokens):
        yield r.spaced(run)


def spaced_runs(tokens: list[str]) -> list[str]:
    """Letters of every run of three or more one-character tokens."""
    ones = bytes([len(t) == 1 for t in tokens])
    out, k = [], ones.find(b"\x01\x01\x01")
    while k >= 0:
        end = ones.find(b"\x00", k)
        end = len(ones) if end < 0 else end
        out.append("".join(tokens[k:end]))
        k = ones.find(b"\x01\x01\x01", end)
    return out


def is_held_out(id_col: Column, parts: int, held: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == held


class Model:
    """Character model, feature lifts and the regression's weights."""

    def __init__(self, logp: np.ndarray, lifts: dict[str, float], base: float):
        self.logp, self.base = logp, base
        self.know(lifts)
        self.weights, self.bias = [0.0] * EVIDENCE, math.log(base / (1 - base))

    def know(self, lifts: dict[str, float]) -> None:
        self.lifts = lifts
        self.whole = {f[1:]: v for f, v in lifts.items() if f[0] == "="}
        raising = [f for f, v in lifts.items() if v > 0]  # no other feature changes a document's evidence
        self.heads = {f.removeprefix("=")[:HEAD] for f in raising}  # how a word with such a feature begins
        self.once = {RUN.sub(r"\1", f) for f in raising}
        self.key = uuid.uuid4().hex  # tells a worker's memoised lifts of one model from another's

    def plain_lift(self, word: str) -> float:
        """The lift of a plain word, 0 where it has none or a negative one."""
        if word[:HEAD] not in self.heads:
            return 0.0
        v = self.whole.get(word)
        for k in reversed(PREFIXES):
            if v is not None:
                break
            v = self.lifts.get(word[:k]) if len(word) > k else None
        return max(v or 0.0, 0.0)

    def may_lift(self, word: str) -> bool:
        """Whether a form that decoding a word of letters can give may have a lift: all forms, and so
        the beginnings of all forms, are alike with their repeated letters taken once."""
        once = RUN.sub(r"\1", word)
        return any(once[:k] in self.once for k in range(1, PREFIXES[-1] + 1)) or "=" + once in self.once

    def lift(self, words: list[str]) -> float:
        """The largest lift of a token's readings; 0 without any."""
        get, heads, best = self.lifts.get, self.heads, 0.0
        for w in words:
            if w[:HEAD] not in heads:
                continue
            for f in features(w):  # the most specific known feature decides
                v = get(f)
                if v is not None:
                    best = max(best, v)
                    break
        return best

    def token_lift(self, r: Restorer, token: str) -> float:
        """The largest lift of a token's readings. A word whose only sign is a
        repeated letter is decoded only if a form that decoding can give has a lift."""
        low = token.lower()
        core = low if low.isalpha() else low.strip(EDGES)
        if core.isalpha() and (core is low or not any(c in LEET for c in low[: low.find(core[0])])):
            if not TWICE.search(core):
                return self.plain_lift(core)
            if not self.may_lift(core):
                return 0.0
            forms = dropped(core)
            if forms is not None and not self.lift(forms):
                return 0.0
        return self.lift(r.readings(token))


def lifts_of(rows: list, base: float, toxic: str, clean: str) -> dict[str, float]:
    """Lift of every feature, each shrunk towards the next shorter known one."""
    share, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.feature[0] == "=", len(r.feature))):
        word = r.feature.removeprefix("=")
        parent = next((share[word[:k]] for k in reversed(PREFIXES) if word[:k] in share and word[:k] != r.feature), base)
        p = (r[toxic] + SHRINK * parent) / (r[toxic] + r[clean] + SHRINK)
        share[r.feature] = p
        out[r.feature] = math.log(p / (1 - p)) - math.log(base / (1 - base))
    return out


MEMO: dict[str, tuple[Restorer, dict[str, float]]] = {}


def worker_memo(model: Model) -> tuple[Restorer, dict[str, float]]:
    """This worker process's restorer and lifts of tokens, for one model at a time."""
    if model.key not in MEMO:
        MEMO.clear()
        MEMO[model.key] = Restorer(model.logp), {}
    return MEMO[model.key]


def evidence_column(spark, model: Model):
    """EVIDENCE numbers per text: the largest lift, and the sum of the distinct
    words' lifts above FAINT as a logarithm, per square root of the words and per word."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def column(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        r, cache = worker_memo(m)
        heads, twice, plain_lift, may_lift = m.heads, TWICE.search, m.plain_lift, m.may_lift

        def one(text: str) -> list[float]:
            tokens = text.split()
            distinct = set(tokens)
            best = total = 0.0
            for t in distinct:
                low = t.lower()
                core = low if low.isalpha() else low.strip(EDGES)
                if not core:
                    continue
                if core.isalpha() and low[0] == core[0]:  # letters, with no sign in front
                    if not twice(core):
                        if core[:HEAD] not in heads:
                            continue
                        got = plain_lift(core)  # as quick as a look into the memo
                        if got > best:
                            best = got
                        if got > FAINT:
                            total += got - FAINT
                        continue
                    if not may_lift(core):
                        continue
                got = cache.get(t)
                if got is None:
                    if len(cache) >= HELD:
                        cache.clear()
                    got = cache[t] = m.token_lift(r, t)
                if got > best:
                    best = got
                if got > FAINT:
                    total += got - FAINT
            for run in spaced_runs(tokens):
                got = max((m.lift([w]) for w in r.spaced(run)), default=0.0)
                total, best = total + max(got - FAINT, 0.0), max(best, got)
            n = max(len(distinct), 1)
            return [best, math.log1p(total), total / math.sqrt(n), min(10.0 * total / n, 10.0)]

        for texts in it:
            yield pd.Series([one(t or "") for t in texts], dtype=object)

    return column


def training_rows(labels: DataFrame, label_col: str, parts: int, held: int, rows: int) -> DataFrame:
    """(t_id, label) of at most ``rows`` labelled rows outside the held-out part."""
    one = (labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()
                         & ~is_held_out(F.col("doc_id"), parts, held))
           .groupBy(F.col("doc_id").alias("t_id")).agg(F.max(label_col).cast("int").alias("label")))
    return one.orderBy(F.xxhash64(F.col("t_id").cast("string")), "t_id").limit(rows)


def feature_counts(train: DataFrame, logp: np.ndarray) -> DataFrame:
    """(feature, toxic, clean, toxic_a, clean_a): training documents with the
    feature by label, in all rows and in half a."""
    shared = train.sparkSession.sparkContext.broadcast(logp)

    def partial(it):
        r, cache = Restorer(shared.value), {}
        n = {(label, half): Counter() for label in (0, 1) for half in (0, 1)}

        def flush():
            keys = list(set().union(*n.values()))
            count = lambda label, halves: np.array([sum(n[label, h][k] for h in halves) for k in keys], dtype=np.int64)
            got = pd.DataFrame({"feature": pd.Series(keys, dtype=object), "toxic": count(1, (0, 1)), "clean": count(0, (0, 1)),
                                "toxic_a": count(1, (0,)), "clean_a": count(0, (0,))})
            for c in n.values():
                c.clear()
            return got

        for pdf in it:
            for text, label, half in zip(pdf["text"], pdf["label"], pdf["half"]):
                seen = set()
                for words in document_words(r, text or "", cache):
                    for w in words:
                        seen.update(features(w))
                n[int(label > 0), int(half)].update(seen)
                if sum(map(len, n.values())) > 3 * CACHE:
                    yield flush()
        yield flush()

    counted = train.mapInPandas(partial, "feature string, toxic long, clean long, toxic_a long, clean_a long")
    return counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_a", "clean_a")])


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> tuple[list[float], float]:
    """Weights and bias of a ridge logistic regression, by Newton steps. More
    evidence must not lower a score: a column with a negative weight is left out."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + penalty, z.T @ (y - q) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    worst = int(np.argmin(w[:-1])) if len(w) > 1 else 0
    if len(w) > 1 and w[worst] < 0:
        rest = [k for k in range(x.shape[1]) if k != worst]
        some, bias = regression(x[:, rest], y, ridge, rounds)
        weights = [0.0] * x.shape[1]
        for k, v in zip(rest, some):
            weights[k] = v
        return weights, bias
    return (w[:-1] / scale).tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", parts: int = 5, held: int = 0,
        train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark = docs.sparkSession
    logp = character_model(docs, text_col)
    chosen = training_rows(labels, label_col, parts, held, train_rows)  # at most train_rows rows: broadcast is bounded
    train = (docs.select(F.col(id_col).alias("t_id"), F.col(text_col).cast("string").alias("text"))
             .join(F.broadcast(chosen), "t_id")
             .select("text", "label", F.pmod(F.xxhash64("t_id"), F.lit(2)).cast("int").alias("half")))
    size = {(int(r.label > 0), r.half): r["count"] for r in train.groupBy("label", "half").count().collect()}
    toxic, clean = (sum(size.get((label, h), 0) for h in (0, 1)) for label in (1, 0))
    base = (toxic + 1.0) / (toxic + clean + 2.0)
    model = Model(logp, {}, base)
    if not toxic or not clean:
        return model
    counts = Scratch(spark, "toxicity").keep(feature_counts(train, logp), "features")
    p = (F.col("toxic") + SHRINK * base) / (F.col("toxic") + F.col("clean") + SHRINK)
    telling = (counts.filter(F.col("toxic") >= MIN_TOXIC).withColumn("odds", F.log(p / (1 - p)))
               .filter(F.col("odds") > math.log(base / (1 - base)) + MIN_LIFT)
               .drop("odds").collect())  # words of the training rows only
    if not telling:
        return model
    # Longer features that begin like a telling prefix: they tell harmless words from telling ones.
    known = {r.feature for r in telling}
    heads = spark.createDataFrame([(f,) for f in known if f[0] != "="], "head string")  # words of the training rows only
    word = F.ltrim(F.lit("="), F.col("feature"))
    longer = (counts.filter(F.col("toxic") + F.col("clean") >= SUPPORT)
              .select("*", F.explode(F.array(*[F.substring(word, 1, k) for k in PREFIXES])).alias("head"))
              .join(F.broadcast(heads), "head").filter(F.col("feature") != F.col("head")).drop("head").distinct().collect())
    rows = telling + [r for r in longer if r.feature not in known]
    model.know(lifts_of(rows, base, "toxic_a", "clean_a"))
    other = train.filter("half = 1").select(evidence_column(spark, model)("text").alias("x"), "label").toPandas()  # <= train_rows
    y = (other["label"].to_numpy() > 0).astype(float)
    if 0 < y.sum() < len(y):
        model.weights, model.bias = regression(np.stack(other["x"].to_numpy()), y)
    model.know(lifts_of(rows, base, "toxic", "clean"))
    return model


def score(spark, model: Model, text: Column) -> Column:
    """Toxicity between 0 and 1 of a text column."""
    e = evidence_column(spark, model)(F.coalesce(text.cast("string"), F.lit("")))
    dot = F.aggregate(F.zip_with(e, F.array(*[F.lit(float(w)) for w in model.weights]), lambda x, w: x * w), F.lit(float(model.bias)),
                      lambda a, x: a + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-dot))


def restored(spark, model: Model, text: Column) -> Column:
    """The text with obfuscated words restored."""
    shared = spark.sparkContext.broadcast(model.logp)

    @F.pandas_udf("string")
    def column(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Restorer(shared.value)
        for texts in it:
            yield pd.Series([r.restore(t or "") for t in texts], dtype=object)

    return column(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The input's rows and columns without the documents scored at or above the threshold."""
    model = fit(docs, labels, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = docs.select(row, score(docs.sparkSession, model, F.col(options.get("text_col", "text"))).alias("score"))
    return (scored.filter(F.col("score") < threshold)
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
