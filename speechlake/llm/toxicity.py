"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear support vector machine.

The kernel of two words counts common character subsequences of length ORDER, each weighted by DECAY to the power of the
stretch it spans in either word, normalised to 1 for equal words. An insult with characters put in or left out keeps
most of its subsequences, at longer stretches. A mark before the first character counts as one, so that stems weigh more
than endings. The kernel of two sentences is the sum over their pairs of distinct words of the
word kernel to the power SHARPEN, a convolution kernel. Landmarks, words or stems chosen from the labelled sentences, give Nyström
features, in which a linear SVM is fitted to sentences: of a toxic document the sentence that its current model finds
worst, of other documents all sampled sentences. As the kernel is a sum over words, so is the SVM's value, and a word's
share is computed once per worker. A document is as toxic as its worst sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, documents, schema_with, workers_see_package
from .words import sliced

ORDER, DECAY, SHARPEN = 3, 0.6, 3
#: Stems of toxic sentences, the most telling ones, and harmless words like them, that become landmarks at most.
LANDMARKS = (48, 16)
#: Log-likelihood ratio from which a word of toxic sentences may become a landmark.
LEAST_G2 = 12.0
#: Labelled documents of either class, code points of one, and code points of all, that a model is fitted to at most.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_TOTAL = 1500, 200_000, 40_000_000
#: Longer words are compared window by window.
LONGEST = 24
#: Tokens of a sentence at most.
SENTENCE = 32
BORDER = re.compile(r"[.!?]+(?:\s+|$)|\n+")
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    """Character codes of the words, each after a mark for its beginning."""
    out = np.full((len(words), width), pad, np.int32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    out[np.arange(width) < size[:, None]] = np.frombuffer("".join("\x02" + w for w in words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def raw_kernel(a: np.ndarray, b: np.ndarray, pairwise: bool = True) -> np.ndarray:
    """Gap-weighted subsequence kernel of rows of character codes (a padded with -1, b with -2): all pairs, or row by row."""
    width = b.shape[1]
    decay = np.triu(DECAY ** np.abs(np.subtract.outer(np.arange(width), np.arange(width)))).astype(np.float32)
    b = b[None] if pairwise else b
    shape = (len(a), b.shape[1], width) if pairwise else (len(a), width)
    # part[k][.., j]: common subsequences of length k + 1 of the characters of a so far and b[:j], weighted up to both ends
    part = [np.zeros((*shape[:-1], width + 1), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(shape[:-1], np.float32)
    square, fade = np.float32(DECAY * DECAY), np.float32(DECAY)
    for i in range(a.shape[1]):
        match = np.multiply((a[:, i, None, None] if pairwise else a[:, i, None]) == b, square, dtype=np.float32)
        total += np.einsum("...j,...j->...", match, part[-1][..., :-1])
        for k in range(ORDER - 2, -1, -1):  # the longer first: they need the shorter ones as they were
            grown = (match * part[k - 1][..., :-1] if k else match).reshape(-1, width) @ decay
            part[k] *= fade
            part[k][..., 1:] += grown.reshape(shape)
    return total


class WordKernel:
    """Normalised word kernels with fixed landmark words.

    The landmarks' subsequences are few: a table has the row of each, with its weight in every landmark. A word's kernels
    are the sum of its own subsequences' rows, each by its weight there; most of them are in no landmark and cost a look.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        codes = _codes(landmarks, 1 + max(map(len, landmarks)), -1)
        norm = np.sqrt(raw_kernel(codes, np.where(codes == -1, -2, codes), False))
        letters = np.unique(codes[codes >= 0])
        self.letters, self.size = letters, len(letters) + 1  # letter 0: in no landmark
        self.row = np.zeros(self.size**ORDER, np.int32)
        found: dict[int, np.ndarray] = {}
        mapped = self._mapped(codes)
        for i, word in enumerate(mapped.tolist()):
            for at in combinations(range(len(word)), ORDER):
                if all(codes[i, x] >= 0 for x in at):
                    key = 0
                    for x in at:
                        key = key * self.size + word[x]
                    found.setdefault(key, np.zeros(len(landmarks), np.float32))[i] += DECAY ** (at[-1] - at[0] + 1)
        self.weights = np.array([np.zeros(len(landmarks), np.float32), *found.values()])
        self.weights /= np.maximum(norm, 1e-12)[None]
        self.row[list(found)] = np.arange(1, len(found) + 1)

    def _mapped(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0)

    def _with_landmarks(self, a: np.ndarray) -> np.ndarray:
        """Kernels of rows of character codes (padded with -1) with the landmarks, divided by the landmarks' norms."""
        mapped = np.ascontiguousarray(self._mapped(a).T)
        out = np.zeros((len(a), len(self.landmarks)), np.float32)
        for at in combinations(range(len(mapped)), ORDER):
            key = mapped[at[0]]
            for x in at[1:]:
                key = key * self.size + mapped[x]
            row = self.row[key]
            hit = np.flatnonzero(row)
            if len(hit):
                out[hit] += self.weights[row[hit]] * np.float32(DECAY ** (at[-1] - at[0] + 1))
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        """Rows of kernels to the power SHARPEN; of a word over LONGEST characters, the largest over its windows."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_width: dict[int, list[tuple[int, str]]] = {}
        for i, w in enumerate(words):
            for part in [w] if len(w) <= LONGEST else [w[s : s + LONGEST] for s in range(0, len(w) - LONGEST // 2, LONGEST // 2)]:
                if len(part) >= ORDER - 1:
                    by_width.setdefault(1 + len(part), []).append((i, part))
        for width, found in by_width.items():
            for s in range(0, len(found), 4000):
                some = found[s : s + 4000]
                a = _codes([p for _, p in some], width, -1)
                own = np.sqrt(raw_kernel(a, np.where(a == -1, -2, a), False))
                k = self._with_landmarks(a) / np.maximum(own[:, None], 1e-12)
                np.maximum.at(out, [i for i, _ in some], np.clip(k, 0, 1) ** SHARPEN)
        return out


def sentences(text: str) -> list[list[str]]:
    """The distinct lower-case tokens of each sentence, or of each SENTENCE tokens of a longer one.

    Runs of three or more single characters add the word they spell. Model.values finds the same in many texts at once.
    """
    out = []
    for s in BORDER.split(text.lower()):
        tokens = s.split()
        out += [list(dict.fromkeys(tokens[i : i + SENTENCE])) for i in range(0, len(tokens), SENTENCE)]
    if SPACED.search(text):
        out += [[re.sub(r"\s+", "", m[0].lower())] for m in SPACED.finditer(text)]
    return out


def bare(token: str) -> str:
    return EDGE.sub("", token)


class _Numbers(dict):
    """A number for each token, in the order of their first look-up."""

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        return n


class Model:
    """value(sentence) = sum of word shares + bias; score = logistic(a * worst value + b)."""

    #: Code points of the texts that are worked on at a time.
    GROUP = 2_000_000
    #: Stands for a line's end among the tokens.
    LINE = "\x00"

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, a: float, b: float):
        self.landmarks, self.weights, self.bias, self.a, self.b = landmarks, weights, bias, a, b
        self._kernel: WordKernel | None = None
        self._forget()

    def _forget(self) -> None:
        self._numbers = _Numbers({self.LINE: 0})
        self._kinds = np.array([1], np.uint8)  # 1: a sentence ends here, 2: a single character
        self._word = np.array([0], np.int64)  # the token without the marks that end a sentence
        self._share = np.zeros(1)

    def __getstate__(self):
        return (self.landmarks, self.weights, self.bias, self.a, self.b)

    def __setstate__(self, state):
        self.__init__(*state)

    def shares(self, tokens: list[str]) -> np.ndarray:
        """What each token adds to a sentence."""
        self._kernel = self._kernel or WordKernel(self.landmarks)
        distinct = _Numbers()
        at = [distinct[bare(t)] for t in tokens]
        return (self._kernel(list(distinct)) @ self.weights)[at] if tokens else np.zeros(0)

    def _learn(self) -> None:
        """Fills in what is known of new tokens."""
        known = len(self._share)
        new = list(islice(self._numbers, known, None))
        words = [self._numbers[t.rstrip(".!?")] for t in new]  # may add more tokens
        more = list(islice(self._numbers, known + len(new), None))
        kinds = [t.endswith((".", "!", "?")) + 2 * (len(t) == 1) for t in new + more]
        self._kinds = np.concatenate([self._kinds, np.array(kinds, np.uint8)])
        self._word = np.concatenate([self._word, np.array(words + [self._numbers[t] for t in more], np.int64)])
        self._share = np.concatenate([self._share, self.shares(new + more)])

    def worst(self, found: list[list[str]]) -> float:
        """Value of a text from its sentences."""
        return max((float(self.shares(s).sum()) for s in found), default=0.0) + self.bias

    def values(self, texts: list[str]) -> np.ndarray:
        """worst(sentences(t)) of each text."""
        if len(self._numbers) > CACHE_ENTRIES:
            self._forget()
        tokens = [t.lower().replace("\n", f" {self.LINE} ").split() for t in texts]
        n = np.array([len(t) for t in tokens])
        flat = list(chain.from_iterable(tokens))
        ids = np.fromiter(map(self._numbers.__getitem__, flat), np.int64, len(flat))
        self._learn()
        out = np.full(len(texts), -np.inf)
        out[n == 0] = 0.0
        if not len(ids):
            return out + self.bias
        text = np.repeat(np.arange(len(texts)), n)
        first = np.ones(len(ids), bool)  # of a sentence
        first[1:] = (text[1:] != text[:-1]) | (self._kinds[ids[:-1]] & 1 > 0)
        heads = np.flatnonzero(first)
        place = np.arange(len(ids)) - np.repeat(heads, np.diff(np.append(heads, len(ids))))
        part = np.cumsum(place % SENTENCE == 0) - 1
        text_of = text[np.flatnonzero(place % SENTENCE == 0)]
        key = (part << 32) | self._word[ids]
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        part = key >> 32
        sums = np.add.reduceat(self._share[key & 0xFFFFFFFF], np.flatnonzero(np.append(True, part[1:] != part[:-1])))
        np.maximum.at(out, text_of, sums)
        single = self._kinds[ids] & 2 > 0
        runs = np.flatnonzero(single[2:] & single[1:-1] & single[:-2] & (text[2:] == text[:-2]))
        if len(runs):
            starts = runs[np.append(True, (runs[1:] != runs[:-1] + 1) | (text[runs[1:]] != text[runs[:-1]]))].tolist()
            spelled = []
            for i in starts:
                end = i
                while end < len(ids) and single[end] and text[end] == text[i]:
                    end += 1
                spelled.append("".join(flat[i:end]))
            np.maximum.at(out, text[starts], self.shares(spelled))
        return out + self.bias

    def score(self, texts: list[str]) -> list[float]:
        value, start = [], 0
        while start < len(texts):
            end, n = start, 0
            while end < len(texts) and (end == start or n + len(texts[end]) <= self.GROUP):
                n, end = n + len(texts[end]), end + 1
            value.append(self.values(texts[start:end]))
            start = end
        value = np.concatenate(value) if value else np.zeros(0)
        return (1 / (1 + np.exp(-np.clip(self.a * value + self.b, -60, 60)))).tolist()


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 2000, c: float = 3000.0) -> tuple[np.ndarray, float]:
    """Linear SVM by averaged subgradient steps on the weighted hinge loss, from zero; no randomness."""
    w, b, lam = np.zeros(x.shape[1]), 0.0, 1.0 / c
    sw, sb = w.copy(), 0.0
    pull = y * weight
    for t in range(1, rounds + 1):
        hit = np.where(y * (x @ w.astype(np.float32) + b) < 1, pull, 0.0)
        step = 3.0 / t**0.5
        w = w - step * (lam * w - hit.astype(np.float32) @ x)
        b += step * float(hit.sum())
        if t > rounds // 2:
            sw, sb = sw + w, sb + b
    n = rounds - rounds // 2
    return sw / n, sb / n


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's fit, slope kept positive."""
    a, b = 1.0, 0.0
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * v * v).sum() + 1e-3, (h * v).sum()], [(h * v).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(g * v).sum() + 1e-3 * a, g.sum()])
        a, b = max(a - float(np.clip(da, -2, 2)), 1e-3), b - float(np.clip(db, -2, 2))
    return a, b


def _stems(docs: list[list[list[str]]], among: Counter | None = None) -> Counter:
    """In how many documents a word begins so, for all beginnings of 3 to LONGEST characters, or those in `among`."""
    out: Counter = Counter()
    for d in docs:
        words = {bare(t)[:LONGEST] for s in d for t in s}
        stems = {w[:n] for w in words for n in range(3, len(w) + 1)}
        out.update(stems if among is None else stems & among.keys())
    return out


def _g2(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio that a of n and b of m differ; negative where the first share is the smaller one."""
    share = (a + b) / (n + m)
    parts = ((a, n * share), (n - a, n * (1 - share)), (b, m * share), (m - b, m * (1 - share)))
    g = 2 * sum(o * np.log(o / e) for o, e in parts if o > 0)
    return float(g if a * m >= b * n else -g)


def fit(toxic: list[str], clean: list[str]) -> Model:
    """A model of labelled texts. With a class missing, every score is 0.5 times the share of toxic texts, rounded to 0 or 0.5."""
    if not toxic or not clean:
        return Model(["none"], np.zeros(1), 0.0, 0.0, 0.0 if toxic else -60.0)
    same: dict[str, str] = {}  # one string for equal tokens of all texts
    shared = lambda t: [[same.setdefault(x, x) for x in s] for s in sentences(t)]
    pos, neg = [shared(t) for t in toxic], [shared(t) for t in clean]
    del same
    n_pos = _stems(pos)
    n_neg = _stems(neg, n_pos)
    strength = {w: _g2(n, len(pos), n_neg[w], len(neg)) for w, n in n_pos.items()}
    del n_pos, n_neg
    top: list[str] = []
    for w in sorted(strength, key=lambda w: (-strength[w], -len(w), w)):
        if len(top) == LANDMARKS[0] or top and strength[w] < LEAST_G2:
            break
        if not any(w.startswith(t) or t.startswith(w) for t in top):
            top.append(w)
    top = top or ["none"]
    # harmless words that look most like these
    others = sorted({bare(t) for d in neg for s in d for t in s}.difference(top))
    kernel = WordKernel(top)
    like = np.concatenate([kernel(others[i : i + 20_000]).max(1) for i in range(0, len(others), 20_000)] or [np.zeros(0)])
    strength = {w: strength.get(w, 0.0) for w in top}
    landmarks = top + [others[i] for i in np.argsort(-like, kind="stable")[: LANDMARKS[1]]]
    kernel = WordKernel(landmarks)
    words = list(dict.fromkeys(bare(t) for d in [*pos, *neg] for s in d for t in s))
    index = {w: i for i, w in enumerate(words)}
    value, vectors = np.linalg.eigh(kernel(landmarks).astype(float))
    keep = value > 1e-6
    root = vectors[:, keep] / np.sqrt(value[keep])  # features of a word: k @ root
    phi = np.concatenate([(kernel(words[i : i + 20_000]) @ root).astype(np.float32) for i in range(0, len(words), 20_000)] or [np.zeros((0, root.shape[1]), np.float32)])
    of = lambda s: phi[[index[bare(t)] for t in s]].sum(0)
    x_pos = [np.array([of(s) for s in d]) if d else np.zeros((1, phi.shape[1]), np.float32) for d in pos]
    x_neg = np.array([of(s) for d in neg for s in d] or [np.zeros(phi.shape[1])], np.float32)
    guess = root.T @ (np.array([strength[w] if w in top and w in strength else 0.0 for w in landmarks]))
    w, b = guess, 0.0
    for _ in range(3):
        witness = np.array([x[int((x @ w).argmax())] for x in x_pos])
        x, y = np.vstack([witness, x_neg]), np.array([1.0] * len(witness) + [-1.0] * len(x_neg))
        w, b = _svm(x, y, np.where(y > 0, 0.1 / len(witness), 0.9 / len(x_neg)))
    worst = np.array([(x @ w).max() for x in x_pos] + [max([float(of(s) @ w) for s in d], default=0.0) for d in neg]) + b
    a, c = _logistic(worst, np.array([1.0] * len(pos) + [-1.0] * len(neg)))
    return Model(landmarks, root @ w, b, a, c)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, toxic, text) of at most `limit` toxic and as many other documents, by a hash of the id; 2 * limit ids are
    broadcast.

    Texts that are null, empty or over TRAIN_CHARS teach nothing; what is gathered is bounded by TRAIN_TOTAL code points
    of either class, the documents first in the order of the hash.
    """
    per_id = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda v: per_id.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    some = F.broadcast(pick(1).unionByName(pick(0)))
    rows = docs.where(F.char_length("text").between(1, TRAIN_CHARS)).join(some, "doc_id").select("doc_id", "toxic", "text")
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text")  # of 2 * limit documents
    return rows.withColumn("sum", F.sum(F.char_length("text")).over(before)).where(F.col("sum") <= TRAIN_TOTAL).drop("sum")


def by_class(rows: list[tuple]) -> tuple[list[str], list[str]]:
    """Texts of toxic and of other documents, from (doc_id, toxic, text), in the order of doc_id and text."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    return [t for _, toxic, t in rows if toxic], [t for _, toxic, t in rows if not toxic]


def training_texts(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """The texts of training_rows, toxic and other ones, on the driver."""
    return by_class(training_rows(docs, labels, limit).collect())


def trained(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """fit(*training_texts(...)) in a task: the texts, and what the fit makes of them, take no memory of the driver."""
    workers_see_package(docs.sparkSession)

    def train(batches):
        model = fit(*by_class([r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]))
        yield pa.RecordBatch.from_pylist([dict(zip(("landmarks", "weights", "bias", "a", "b"), model.__getstate__(), strict=True))], of)

    of = pa.schema([("landmarks", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())), *((x, pa.float64()) for x in ("bias", "a", "b"))])
    rows = training_rows(docs, labels, limit).coalesce(1)  # bounded
    found = rows.mapInArrow(train, "landmarks array<string>, weights array<double>, bias double, a double, b double").collect()
    if not found:  # no partition, no task
        return fit([], [])
    m = found[0]
    return Model(list(m["landmarks"]), np.array(m["weights"]), m["bias"], m["a"], m["b"])


def toxicity(df: DataFrame, model: Model) -> DataFrame:
    """df (text; others kept) with score (double, 0 to 1) and predicted (int, 1 from 0.5 on); such columns are replaced.

    A null text counts as empty; an empty text's score is that of a sentence without words. Equal texts have equal scores,
    whatever stands beside them; a very long text or word is worked on whole; an empty df gives no rows.
    """
    workers_see_package(df.sparkSession)
    df = df.drop("score", "predicted")
    at = df.schema.fieldNames().index("text")
    schema = schema_with(df, "score double, predicted int")
    known = df.sparkSession.sparkContext.broadcast(model)  # LANDMARKS words and numbers

    def run(batches):
        m = known.value
        for b in (part for whole in batches for part in sliced(whole, at)):
            score = m.score([t or "" for t in b.column(at).to_pylist()])
            new = [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op3_subsequence_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = trained(docs, labels.where(~held_out(F.col("doc_id"))))
    out = toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
