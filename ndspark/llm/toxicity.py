"""Toxicity by a support vector machine over a gap-weighted subsequence kernel.

Strings are compared by the character subsequences of length 3 that they share, each weighted
by DECAY to the power of the span that it covers in either, so "idioot", "id.iot" or
"i d i o t" stay close to "idiot". Training reads labelled sentences: a sentence's units (its
words, and words broken up by punctuation or spaces, put together) are the instances, those
found in toxic sentences almost alone are positive, those of clean sentences negative. Nystroem
landmarks give the kernel an explicit feature map, on which a linear machine is trained.

The trained function, a weighted sum of kernels with the landmarks, is linear in a string's
subsequence counts. It is therefore stored as one weight for each subsequence of length 3,
which gives the same values without a pass over the landmarks for each string. A document
scores by its most toxic unit, put on a probability scale by a logistic fit.

Insults of two words that are harmless alone are found as phrases: pairs of neighbouring words,
without signs and doubled letters, that stand in many different contexts of toxic sentences,
more than chance would give any pair, and in no clean one.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, least_by_hash, small_batches, stage, unstage

DECAY = 0.6
SPAN = 7  # characters that a subsequence covers at most
ALPHABET = 64
FEATURES = 2 * ALPHABET**3  # subsequences of length 3, and hashed ones of length 4
FIRST, LAST = "\x02", "\x03"  # a unit's edges count as characters
WIDTH, STRIDE = 24, 12  # longer units are read in windows of WIDTH characters
HARD_COUNT = 100  # sentences that each counts as
RIDGE = 0.1
BIAS = -1.0  # what is like no landmark is clean
CLEAN_WEIGHT = 4.0  # of all clean units together; a document has many and few may be wrong
FOLDS, HELD_OUT = 5, 0
PHRASE = 1.5  # the margin of a text with a toxic phrase
MEMO = 250_000  # tokens whose scores a worker remembers



@dataclass(frozen=True)
class Bounds:
    """How much training holds at most, at any size of the input. They bound the sample that
    the machine is fitted on; what is scored has no bound.

    docs: labelled documents that are read, those least by the hash of their id.
    positive, negative: units that training starts with: the positive ones found in most
        sentences, half of the negative ones likewise, half by their hash.
    landmarks: of the Nystroem features at the start; candidates: positive units they are
        chosen from; broken: positive units that are also trained on with a character put in.
    rounds: of further training, each with up to `hard` clean units that the machine found most
        toxic, and `marks` of them as landmarks.
    phrases: of two words, those found in most contexts.
    """

    docs: int = 12_000
    positive: int = 2_000
    negative: int = 8_000
    landmarks: int = 320
    candidates: int = 1_000
    broken: int = 200
    rounds: int = 4
    hard: int = 2_000
    marks: int = 40
    phrases: int = 500


_PIECES = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:\s[^\W_]){2,}(?!\S)")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{3,}")


def token_units(token: str) -> list[str]:
    """The strings that a token (lower case, no white space) stands for: itself without
    signs, and its parts between signs; in scripts without spaces also each two and three
    characters that follow each other."""
    if token.isalnum():
        found = [token]
    else:
        found = _PIECES.findall(token)
        if len(found) > 1:
            found.append("".join(found))
    out = []
    for x in found:
        for run in () if x.isascii() else _UNSPACED.findall(x):
            out += [run[i : i + k] for k in (2, 3) for i in range(len(run) - k + 1)]
        if len(x) <= WIDTH:
            out.append(x)
        else:
            out += [x[i : i + WIDTH] for i in range(0, len(x) - WIDTH + STRIDE, STRIDE)]
    return out


def tokens_of(text: str) -> set[str]:
    """Distinct tokens of a text, in lower case; runs of single characters count as one too."""
    text = text.lower()
    found = set(text.split())
    for run in _SPACED.findall(text):
        found.add("".join(run.split()))
    return found


_DOUBLED = re.compile(r"(.)\1+")


def plain_form(token: str) -> str:
    """A token (lower case) without signs, its doubled letters once."""
    return _DOUBLED.sub(r"\1", token if token.isalnum() else "".join(_PIECES.findall(token)))


def neighbours(sentence: str) -> list[tuple[str, str, str, str]]:
    """(before, first, second, after) of each two neighbouring words, in plain form."""
    forms = ["", *filter(None, map(plain_form, sentence.lower().split())), ""]
    return list(zip(forms, forms[1:-2], forms[2:-1], forms[3:], strict=False))


@lru_cache(maxsize=WIDTH + 3)
def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the subsequences of length 3 and 4 that span at most SPAN characters of a
    string of n, and the weights of all of them, threes first."""
    out, weights = [], []
    for k in (3, 4):
        at = np.array(
            [
                (i, *rest)
                for i in range(n)
                for rest in itertools.combinations(range(i + 1, min(n, i + SPAN)), k - 1)
            ],
            np.int64,
        ).reshape(-1, k)
        out.append(at.T)
        weights.append(DECAY ** (at[:, -1] - at[:, 0] + 1))
    return out[0], out[1], np.concatenate(weights).astype(np.float32)


@dataclass
class Alphabet:
    """Numbers of characters: one each for the commonest, and for all others one by their hash."""

    chars: str
    table: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.table = self._hashed(np.arange(0x3000))
        for i, c in enumerate(self.chars, 1):
            if ord(c) < len(self.table):
                self.table[ord(c)] = i

    @staticmethod
    def _hashed(raw: np.ndarray) -> np.ndarray:
        return ((raw.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int32) % ALPHABET

    def numbers(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        low = raw < len(self.table)
        return np.where(low, self.table[np.where(low, raw, 0)], self._hashed(raw))

    def features(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For units of one length: a row of feature numbers each, the weights of a row, and
        the norm of each unit's counts. Threes have a number each, fours a hashed one."""
        codes = self.numbers("".join(f"{FIRST}{u}{LAST}" for u in units)).reshape(len(units), -1)
        three, four, fade = _places(codes.shape[1])
        a = (codes[:, three[0]] * ALPHABET + codes[:, three[1]]) * ALPHABET + codes[:, three[2]]
        b = (codes[:, four[0]] * ALPHABET + codes[:, four[1]]) * ALPHABET + codes[:, four[2]]
        b = ((b * ALPHABET + codes[:, four[3]]).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(14)
        index = np.concatenate([a, b.astype(np.int32) + ALPHABET**3], axis=1)
        order = np.argsort(index, axis=1)
        ranked = np.take_along_axis(index, order, 1) + (np.arange(len(units)) * FEATURES)[:, None]
        flat, weight = ranked.ravel(), fade[order].ravel()
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        sums = np.add.reduceat(weight, first)
        norm = np.sqrt(np.bincount(flat[first] // FEATURES, sums * sums, len(units)))
        return index, fade, norm.astype(np.float32)

    def kernel(self, units: list[str], weights: np.ndarray) -> np.ndarray:
        """For each unit the sum over its subsequences of weight times rows of `weights`, over
        the unit's norm: with a landmark's normed counts in a column, its kernel."""
        out = np.zeros((len(units), weights.shape[1]), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_length.setdefault(len(u), []).append(i)
        for n, own in by_length.items():
            step = max(1, (1 << 20) // (len(_places(n + 2)[2]) * weights.shape[1]))
            step = min(step, 2048)
            for lo in range(0, len(own), step):
                rows = own[lo : lo + step]
                index, fade, norm = self.features([units[i] for i in rows])
                if weights.shape[1] == 1:
                    sums = (weights[:, 0][index] @ fade)[:, None]
                else:
                    sums = np.matmul(fade[None, None, :], weights[index])[:, 0, :]
                out[rows] = sums / norm[:, None]
        return out

    def counts(self, units: list[str]) -> np.ndarray:
        """Normed subsequence counts, a column for each unit."""
        out = np.zeros((FEATURES, len(units)), np.float32)
        for i, u in enumerate(units):
            index, fade, norm = self.features([u])
            np.add.at(out[:, i], index[0], fade / norm[0])
        return out

    def gram(self, units: list[str], marks: list[str], block: int = 24) -> np.ndarray:
        """The kernel of every unit with every landmark, a few landmarks at once."""
        parts = [self.kernel(units, self.counts(marks[i : i + block])) for i in range(0, len(marks), block)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(units), 0), np.float32)

    def combine(self, marks: list[str], beta: np.ndarray) -> np.ndarray:
        """Weights of subsequences: the landmarks' normed counts, times beta."""
        out = np.zeros(FEATURES, np.float32)
        for u, w in zip(marks, beta, strict=True):
            index, fade, norm = self.features([u])
            np.add.at(out, index[0], fade * np.float32(w) / norm[0])
        return out


@dataclass
class Model:
    """Weights of subsequences, bias, and the logistic scale; without weights every document
    scores the share of toxic labels."""

    alphabet: Alphabet | None
    weights: np.ndarray | None
    bias: float
    slope: float
    shift: float
    phrases: frozenset = frozenset()  # of "first second"

    def units(self, units: list[str]) -> np.ndarray:
        return self.alphabet.kernel(units, self.weights)[:, 0] + self.bias

    def probability(self, margin: float) -> float:
        x = self.slope * min(max(margin, -2.0), 2.0) + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, bias: float) -> np.ndarray:
    """Squared hinge loss with a ridge, for a fixed bias, by Newton steps over the rows that
    are inside the margin."""
    w = np.zeros(x.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(60):
        a = x[active] * weight[active, None]
        step = np.linalg.solve(a.T @ x[active] + ridge * np.eye(len(w)), a.T @ (y[active] - bias))
        w = step
        after = y * (x @ w + bias) < 1
        if (after == active).all():
            break
        active = after
    return w


def _broken(rng: np.random.Generator, unit: str, letters: str) -> list[str]:
    """A unit with a character put in, and with one doubled."""
    i, j = (int(rng.integers(1, len(unit))) for _ in range(2))
    c = letters[int(rng.integers(len(letters)))]
    return [unit[:i] + c + unit[i:], unit[:j] + unit[j - 1] + unit[j:]]


class Trainer:
    """Fits units by Nystroem features, and again with clean units that it got most wrong. The
    kernel of units and landmarks is kept; a round adds the rows and columns that are new."""

    def __init__(self, positive: dict[str, int], negative: dict[str, int], bounds: Bounds):
        landmarks = bounds.landmarks
        rng = np.random.default_rng(7)
        seen: dict[str, int] = {}
        for u, n in [*positive.items(), *negative.items()]:
            for c in u:
                seen[c] = seen.get(c, 0) + n
        letters = sorted(seen, key=lambda c: (-seen[c], c))[: ALPHABET - 3]
        self.alphabet = a = Alphabet(FIRST + LAST + "".join(letters))
        pos = sorted(positive, key=lambda u: (-positive[u], u))
        neg = sorted(negative, key=lambda u: (-negative[u], u))
        # landmarks: positives far from each other, then the clean units nearest to them
        pool, chosen = pos[: bounds.candidates], []
        near, value = np.zeros(len(pool)), np.log1p([positive[u] for u in pool])
        for _ in range(min(landmarks // 2, len(pool))):
            best = int(np.argmax((1 - near) * value))
            if near[best] > 0.97:
                break
            chosen.append(best)
            near = np.maximum(near, a.kernel(pool, a.counts([pool[best]]))[:, 0])
        self.marks = [pool[i] for i in chosen]
        close = a.gram(neg, self.marks).max(axis=1)
        order = np.argsort(-close, kind="stable")[: (landmarks - len(self.marks)) // 2]
        self.marks += [neg[i] for i in order]
        taken = set(self.marks)
        self.marks += [u for u in neg if u not in taken][: landmarks - len(self.marks)]
        broken = [x for u in pos[: bounds.broken] if len(u) > 1 for x in _broken(rng, u, letters) if x not in negative]
        self.units = [*pos, *broken, *neg]
        self.y = [1.0] * (len(pos) + len(broken)) + [-1.0] * len(neg)
        self.often = [*[positive[u] for u in pos], *[1] * len(broken), *[negative[u] for u in neg]]
        self.rows = a.gram(self.units, self.marks)
        self.place = {u: i for i, u in enumerate(self.units)}

    def add(self, hard: list[str], marks: int) -> None:
        """Clean units, the worst first; the worst few become landmarks as well."""
        new = [u for u in hard if u not in self.place]
        for u in hard:
            if u in self.place:
                i = self.place[u]
                if self.y[i] < 0:
                    self.often[i] = max(self.often[i], HARD_COUNT) * 2
        if new:
            self.rows = np.concatenate([self.rows, self.alphabet.gram(new, self.marks)])
            for u in new:
                self.place[u] = len(self.units)
                self.units.append(u)
                self.y.append(-1.0)
                self.often.append(HARD_COUNT)
        own = [u for u in hard if u not in set(self.marks)][:marks]
        if own:
            self.rows = np.concatenate([self.rows, self.alphabet.gram(self.units, own)], axis=1)
            self.marks += own

    def fit(self) -> Model:
        inner = self.alphabet.gram(self.marks, self.marks).astype(np.float64)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        whiten = vectors / np.sqrt(np.maximum(values, 1e-4))
        x, y = self.rows.astype(np.float64) @ whiten, np.array(self.y)
        # a unit weighs by the sentences that hold it
        often = np.sqrt(self.often)
        weight = np.where(y > 0, often / often[y > 0].sum(), CLEAN_WEIGHT * often / often[y < 0].sum())
        w = linear_svm(x, y, weight * len(y), RIDGE, BIAS)
        self.beta = whiten @ w
        primal = self.alphabet.combine(self.marks, self.beta)
        return Model(self.alphabet, primal[:, None], BIAS, 1.0, 0.0)


def fit_scale(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, both classes weighing the same, by Newton steps
    with a small ridge."""
    x = np.column_stack([np.clip(margins, -2, 2), np.ones(len(margins))])
    yes = toxic > 0
    weight = np.where(yes, 0.5 / max(1, yes.sum()), 0.5 / max(1, (~yes).sum())) * len(margins)
    target = np.where(yes, 1 - 1e-3, 1e-3)
    w = np.array([4.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-2 * (w - np.array([4.0, 0.0])))
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


class Scorer:
    """Scores whole texts; remembers the margins of recent tokens."""

    def __init__(self, model: Model, memo: int = MEMO):
        self.model, self.limit, self.memo = model, memo, {}
        self.parts = {w for x in model.phrases for w in x.split(" ")}

    def _has_phrase(self, text: str, tokens: set[str]) -> bool:
        if len({w for t in tokens if (w := plain_form(t)) in self.parts}) < 2 - any(a == b for a, b in map(str.split, self.model.phrases)):
            return False
        return any(f"{a} {b}" in self.model.phrases for s in _SENTENCE.findall(text) for _, a, b, _ in neighbours(s))

    def margins(self, texts: list[str]) -> list[float]:
        floor = -2.0
        if self.model.weights is None:
            return [floor] * len(texts)
        split = [tokens_of(t) for t in texts]
        new = set().union(*split).difference(self.memo)
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = set().union(*split)
        # tokens share units: each unit is computed once
        units = {t: token_units(t) for t in new}
        distinct = sorted({u for own in units.values() for u in own})
        value = dict(zip(distinct, self.model.units(distinct).tolist(), strict=True)) if distinct else {}
        for t, own in units.items():
            self.memo[t] = max(map(value.__getitem__, own), default=floor)
        get = self.memo.__getitem__
        out = [max(map(get, tokens), default=floor) for tokens in split]
        for t in new:
            if len(t) > 64:
                del self.memo[t]
        if self.parts:
            out = [PHRASE if m < PHRASE and self._has_phrase(t, s) else m for m, t, s in zip(out, texts, split, strict=True)]
        return out


def _sentences(text: str):
    def run(batches):
        for batch in small_batches(batches, text, 4 << 20):
            rows = []
            for raw, toxic in zip(binary_texts(batch, text), batch.column("toxic").to_pylist(), strict=True):
                body = (raw or b"").decode("utf-8", "surrogatepass")
                for s in _SENTENCE.findall(body):
                    own = sorted({u for t in tokens_of(s) for u in token_units(t)})
                    if own:
                        rows.append((toxic, xxhash.xxh64_intdigest(s.strip().encode("utf-8", "replace")) - (1 << 63), own))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.string()))], names=["toxic", "sentence", "units"],
            )

    return run


def _neighbours(text: str):
    """(pair, context) of all neighbouring words."""

    def run(batches):
        for batch in small_batches(batches, text, 4 << 20):
            for raw in binary_texts(batch, text):
                body = (raw or b"").decode("utf-8", "surrogatepass")
                found = {(f"{b} {c}", xxhash.xxh64_intdigest(f"{a} {d}".encode("utf-8", "replace")) - (1 << 63)) for s in _SENTENCE.findall(body) for a, b, c, d in neighbours(s)}
                cols = list(zip(*found, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["pair", "context"])

    return run


def _held_pairs(text: str, wanted: frozenset):
    """Those of the pairs that a text holds."""

    def run(batches):
        for batch in small_batches(batches, text, 4 << 20):
            found = set()
            for raw in binary_texts(batch, text):
                body = (raw or b"").decode("utf-8", "surrogatepass")
                found |= wanted.intersection(f"{b} {c}" for s in _SENTENCE.findall(body) for _, b, c, _ in neighbours(s))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["pair"])

    return run


def _phrases(rows: DataFrame, base: float, alone: set[str], bounds: Bounds) -> frozenset:
    """Pairs of words, none of them in `alone`, for Model. rows: toxic, body."""
    if not 0 < base < 1:
        return frozenset()
    pairs = stage(
        rows.where("toxic > 0").mapInArrow(_neighbours("body"), "pair string, context long").distinct()
        .groupBy("pair").count(),
        "toxic-pairs",
    )
    # so many contexts that chance alone would give no pair as many
    least = max(4, int(np.ceil(np.log(max(2, pairs.count())) / -np.log(base))))
    often = pairs.where(F.col("count") >= least).orderBy(F.desc("count"), "pair")
    parts = {plain_form(x) for x in alone}
    wanted = [r["pair"] for r in often.limit(4 * bounds.phrases).collect()]
    wanted = frozenset([x for x in wanted if parts.isdisjoint(x.split(" "))])
    unstage(pairs)
    if not wanted:
        return wanted
    clean = rows.where("toxic <= 0").mapInArrow(_held_pairs("body", wanted), "pair string").distinct().collect()
    left = wanted.difference(r["pair"] for r in clean)
    return frozenset(sorted(left)[: bounds.phrases])


def _score(key: str, text: str, model: Model):
    def run(batches):
        scorer = Scorer(model)
        for batch in small_batches(batches, text, 4 << 20):
            texts = [(x or b"").decode("utf-8", "surrogatepass") for x in binary_texts(batch, text)]
            margins = scorer.margins(texts)
            out = {key: batch.column(key)}
            out["margin"] = pa.array(margins, pa.float64())
            out["score"] = pa.array([model.probability(m) for m in margins], pa.float64())
            yield pa.RecordBatch.from_pydict(out)

    return run


def _margins(model: Model):
    def run(batches):
        for batch in batches:
            units = batch.column(0)
            found = model.units(units.to_pylist())
            yield pa.RecordBatch.from_arrays([units, pa.array(found, pa.float64())], names=["unit", "margin"])

    return run


def held_out(key) -> F.Column:
    """Rows that training never reads: crc32 of the id as text, modulo 5, is 0. A null id is
    not held out; no label can name it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label_key: str = "doc_id",
    label: str = "toxic",
    bounds: Bounds = Bounds(),
) -> Model:
    """A model from at most bounds.docs labelled documents whose ids are not held out (those
    least by the hash of their id). Ids with several or null labels: the largest not null. Null
    ids and texts, repeated rows and equal sentences: a sentence counts once, as clean if any
    document that holds it is clean. Units found equally often go by their spelling, so that a
    table always gives the same model. Without labels, or without units of both kinds, the
    model scores every document by the share of toxic labels."""
    usable = (
        labels.select(F.col(label_key).alias("id"), F.col(label).cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = stage(least_by_hash(usable, ["id"], bounds.docs), "toxic-labels")
    # the labels are at most bounds.docs rows of two numbers
    rows = stage(
        docs.select(F.col(key).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), "id"),
        "toxic-train",
    )
    sentences = (
        rows.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism))
        .mapInArrow(_sentences("body"), "toxic int, sentence long, units array<string>")
        .groupBy("sentence")
        .agg(F.min("toxic").alias("toxic"), F.first("units").alias("units"))
    )
    sentences = stage(sentences, "toxic-sentences")
    units = stage(
        sentences.select("toxic", F.explode("units").alias("unit"))
        .groupBy("unit")
        .agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")),
        "toxic-units",
    )
    share = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    prior = ((share[0] or 0) + 0.5) / (share[1] + 2)
    flat = Model(None, None, 0.0, 0.0, float(np.log(prior / (1 - prior))))
    # so many toxic sentences that chance alone would give no unit as many
    base = sentences.agg(F.avg("toxic")).first()[0] or 0.0
    least = max(3, int(np.ceil(np.log(max(2, units.count())) / -np.log(base)))) if 0 < base < 1 else 3
    pos = units.where(f"pos >= {least} and pos >= 4 * neg").orderBy(F.desc("pos"), "unit").limit(bounds.positive).collect()
    negative = units.where("neg >= 1 and 4 * neg > pos")
    neg = negative.orderBy(F.desc("neg"), "unit").limit(bounds.negative // 2).collect()
    neg += least_by_hash(negative, ["unit"], bounds.negative // 2).collect()
    phrases = _phrases(rows, base, {r["unit"] for r in pos}, bounds)
    if not (pos or phrases) or not neg:
        unstage(chosen, rows, sentences, units)
        return flat
    # with phrases alone there is no unit to be like
    trainer = Trainer({r["unit"]: r["pos"] for r in pos} or {FIRST * 3: 1}, {r["unit"]: r["neg"] for r in neg}, bounds)
    model = replace(trainer.fit(), phrases=phrases)
    for _ in range(bounds.rounds):
        hard = (
            negative.select("unit")
            .mapInArrow(_margins(model), "unit string, margin double")
            .where("margin > -0.5")
            .orderBy(F.desc("margin"), "unit")
            .limit(bounds.hard)
            .collect()
        )
        if not hard:
            break
        trainer.add([r["unit"] for r in hard], bounds.marks)
        model = replace(trainer.fit(), phrases=phrases)
    found = (
        rows.mapInArrow(_score("toxic", "body", model), "toxic int, margin double, score double").collect()
    )
    model.slope, model.shift = fit_scale(
        np.array([r["margin"] for r in found]), np.array([r["toxic"] for r in found])
    )
    unstage(chosen, rows, sentences, units)
    return model


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text.

    score is from 0 to 1; predicted is 1 from 0.5 on. Null and empty texts score as clean as
    a text can. Repeated rows stay repeated, null keys are kept and are not held out, other
    columns are not read, and an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body"))
    scored = rows.mapInArrow(_score("doc_id", "body", model), f"doc_id {kind}, margin double, score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents that are not held out, then score every document: one row
    for each row of docs, as score_documents() says. Labels of unknown, repeated or null ids do
    no harm, as train() says. Either table may be empty, have null in any column and more columns
    of any names, and ids of any type."""
    return score_documents(docs, train(docs, labels))


def _clean_rows(text: str, model: Model):
    def run(batches):
        scorer = Scorer(model)
        for batch in small_batches(batches, text, 4 << 20):
            texts = [(x or b"").decode("utf-8", "surrogatepass") for x in binary_texts(batch, text)]
            keep = [model.probability(m) < 0.5 for m in scorer.margins(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that score_documents() would not predict as toxic, all columns kept."""
    return docs.mapInArrow(_clean_rows(text, model), docs.schema)
