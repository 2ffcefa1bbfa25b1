"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums over common subsequences of three letters, each weighted by how far it is spread, so an
insult with letters put in, left out or added at its end stays close to the plain one. A sentence meets each landmark
with its nearest word. The machine learns from sentences: all those of documents that are not toxic, and of each toxic
document that has a near word the sentence that looks worst to the machine of the round before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import written

#: Labelled documents that the machine is fitted on, at most in expectation, of each label; and its landmarks.
TOXIC, CLEAN, LANDMARKS = 2000, 3000, 128
LENGTH, DECAY = 3, 0.6
#: Longer words are looked at in overlapping parts.
LONGEST = 24
#: A word is compared with a landmark if it holds this share of its letter pairs, gaps of two letters allowed.
SCREEN = 0.6
FOLDS = 5
REMEMBERED = 400_000
#: Pairs of words that one pass of the kernel takes.
STEP = 4096
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){3,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    width = max(1, int(lengths.max(initial=0)))
    signs = "".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le")
    return np.frombuffer(signs, np.int32).reshape(len(words), width), lengths


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel of row i of a with row i of b (letters as numbers, filled up with 0), by dynamic programming over all rows at once."""
    rows, n, m = len(a), a.shape[1], b.shape[1]
    across, down = np.ascontiguousarray(a.T)[:, None], np.ascontiguousarray(b.T)[None]
    same = (across == down) & (across > 0)  # rows last, so that each step below reads them in one piece
    before = np.ones((n + 1, m + 1, rows), np.float32)
    square = np.float32(DECAY * DECAY)
    for _ in range(LENGTH - 1):
        now = np.zeros_like(before)
        for i in range(1, n + 1):
            run = same[i - 1] * (square * before[i - 1, :-1])
            for j in range(1, m):
                run[j] += run[j - 1] * np.float32(DECAY)
            now[i, 1:] = now[i - 1, 1:] * np.float32(DECAY) + run
        before = now
    out = np.zeros(rows, np.float64)
    for i in range(n):
        out += (same[i] * (square * before[i, :-1])).sum(0, dtype=np.float64)
    return out


def _pairs(codes: np.ndarray, reach: int) -> np.ndarray:
    """256-bit masks of the ordered letter pairs at most `reach` apart."""
    masks = np.zeros((len(codes), 4), np.uint64)
    for gap in range(1, min(reach, codes.shape[1] - 1) + 1):
        x, y = codes[:, :-gap], codes[:, gap:]
        bit = (x * 37 + y * 11) % 256
        value = np.where((x > 0) & (y > 0), np.uint64(1) << (bit % 64).astype(np.uint64), np.uint64(0))
        for word in range(4):
            masks[:, word] |= np.bitwise_or.reduce(np.where(bit // 64 == word, value, np.uint64(0)), axis=1)
    return masks


def parts(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class Landmarks:
    """near(words): kernel values, scaled to 1 for equal words, of each word with each landmark."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.lengths = _codes(words)
        self.norm = np.sqrt(np.maximum(subsequence_kernel(self.codes, self.codes), 1e-12)) if words else np.empty(0)
        self.masks = _pairs(self.codes, 1)
        self.bits = np.maximum(1, np.bitwise_count(self.masks).sum(1))

    def near(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        if not words or not self.words:
            return out
        for begin in range(0, len(words), 8192):
            codes, lengths = _codes(words[begin : begin + 8192])
            masks = _pairs(codes, 3)
            common = np.zeros((len(codes), len(self.words)), np.uint8)
            for word in range(4):
                common += np.bitwise_count(masks[:, word, None] & self.masks[None, :, word])
            w, l = np.nonzero((common >= SCREEN * self.bits) & (lengths[:, None] >= LENGTH))
            if len(w):
                by_length = np.argsort(lengths[w], kind="stable")  # short words together need few columns
                w, l = w[by_length], l[by_length]
                norm, used = np.zeros(len(codes)), np.unique(w)
                used = used[np.argsort(lengths[used], kind="stable")]
                for i in range(0, len(used), STEP):
                    x = used[i : i + STEP]
                    own = codes[x, : lengths[x].max()]
                    norm[x] = np.sqrt(np.maximum(subsequence_kernel(own, own), 1e-12))
                for i in range(0, len(w), STEP):
                    x, y = w[i : i + STEP], l[i : i + STEP]
                    value = subsequence_kernel(codes[x, : lengths[x].max()], self.codes[y, : self.lengths[y].max()])
                    out[begin + x, y] = value / (norm[x] * self.norm[y])
        return out


def plain_form(token: str) -> str:
    """The letters of a token: the same wherever a sentence is cut."""
    return token if token.isalpha() else _NOT_LETTERS.sub("", token)


class Words:
    """Remembers which words (by their letters alone) are near a landmark. Most words are near none, and those are only kept as a set."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.cold, self.hot = landmarks, set(), {}

    def learn(self, words: set[str]) -> None:
        units = [(w, p) for w in words for p in parts(w)]
        values = self.landmarks.near([p for _, p in units])
        if len(self.cold) < REMEMBERED:  # the first words seen hold the frequent ones
            self.cold.update(words)
        for i in np.flatnonzero(values.any(1)):
            word = units[i][0]
            self.hot[word] = np.maximum(self.hot[word], values[i]) if word in self.hot else values[i]
        self.cold.difference_update(self.hot)

    def sentences(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """For each text the landmark values of the sentences that have any."""
        lowered = [(t or "").lower() for t in texts]
        words = []
        for i, t in enumerate(lowered):
            own = set(t.split())
            if sum(len(x) == 1 for x in own) > 2:  # letters with blanks between are one word
                lowered[i] = t = _SPACED.sub(lambda m: re.sub(r"\s", "", m[0]), t)
                own = set(t.split())
            words.append(set(map(plain_form, own)))
        unknown = set().union(*words) if words else set()
        unknown -= self.cold
        self.learn(unknown.difference(self.hot, [""]))
        hot, out = self.hot, []
        for t, own in zip(lowered, words, strict=True):
            found = []
            if not own.isdisjoint(hot):
                for sentence in _SENTENCE.split(t):
                    values = [hot[y] for y in map(plain_form, sentence.split()) if y in hot]
                    if values:
                        found.append(np.max(values, axis=0))
            out.append(found)
        return out


def _vectors(stored: list[bytes], root: np.ndarray) -> np.ndarray:
    """Stored landmark values (none: all 0) in the Nystroem basis, with a 1 for the intercept at the end."""
    width = len(root)
    near = np.frombuffer(b"".join(v or bytes(2 * width) for v in stored), np.float16).reshape(-1, width)
    return np.hstack([near.astype(np.float64) @ root, np.ones((len(near), 1))])


def _inside(x: np.ndarray, y: float, n: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, products and sums of n rows of each x with label y that lie inside the margin of w."""
    gap = 1 - y * (x @ w)
    x, n, gap = x[gap > 0], n[gap > 0], gap[gap > 0]
    return float((n * gap * gap).sum()), (x * n[:, None]).T @ x, y * (x * n[:, None]).sum(0)


def svm(clean: DataFrame, root: np.ndarray, toxic: tuple[np.ndarray, np.ndarray], start: np.ndarray, penalty: float = 1e-5, rounds: int = 100) -> np.ndarray:
    """Linear machine with a squared hinge and an intercept (last), by Newton steps over the rows inside the margin.

    clean: x, n (landmark values and how often they occur), of any number of rows. A step reads them once and sums the
    products of those inside the margin cell by cell; the driver holds one matrix. toxic: vectors and counts.
    """
    size = len(root) + 1
    upper = np.triu_indices(size)
    good, bad = float(toxic[1].sum()), float(clean.agg(F.sum("n")).first()[0] or 0)
    weight = good / max(1.0, bad)
    total = good + weight * bad
    ridge = penalty * np.append(np.ones(size - 1), 1e-6)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def add(batches):
            loss, products, sums = 0.0, np.zeros((size, size)), np.zeros(size)
            for batch in batches:
                part = _inside(_vectors(batch["x"].tolist(), root), -1.0, batch["n"].to_numpy(np.float64), w)
                loss, products, sums = loss + part[0], products + part[1], sums + part[2]
            cells = np.concatenate([[loss], sums, products[upper]])
            yield pd.DataFrame({"cell": np.arange(len(cells)), "v": cells})

        cells = np.zeros(1 + size + len(upper[0]))
        summed = clean.mapInPandas(add, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
        cells[summed["cell"].to_numpy()] = summed["v"].to_numpy()
        loss, products, sums = _inside(toxic[0], 1.0, toxic[1], w)
        other = np.zeros((size, size))
        other[upper] = cells[1 + size :]
        other = np.triu(other) + np.triu(other, 1).T
        return (
            (loss + weight * cells[0]) / total + float((ridge * w * w).sum()),
            (products + weight * other) / total,
            (sums + weight * cells[1 : 1 + size]) / total,
        )

    w = start
    loss, products, sums = at(w)
    for _ in range(rounds):
        step, part = np.linalg.solve(products + np.diag(ridge), sums) - w, 1.0
        if np.abs(step).max() < 1e-7:
            break
        new = at(w + step)
        while new[0] > loss and part > 1e-6:
            part /= 2
            new = at(w + part * step)
        if new[0] >= loss:
            break
        w, (loss, products, sums) = w + part * step, new
    return w


def sigmoid_of(values: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn decision values into probabilities, targets drawn in a little from 0 and 1."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * values + b, -30, 30)))
        g = np.array([((p - target) * values).sum(), (p - target).sum()])
        h = p * (1 - p)
        m = np.array([[(h * values * values).sum(), (h * values).sum()], [(h * values).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(m, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)


@dataclass
class Model:
    landmarks: Landmarks
    root: np.ndarray
    w: np.ndarray
    slope: float
    offset: float

    def score(self, sentences: list[np.ndarray]) -> float:
        value = self.w[-1]
        if sentences:
            value = max(value, float((np.array(sentences) @ self.root @ self.w[:-1]).max() + self.w[-1]))
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """docs: id, text; labels: id, toxic (0 or 1; rows with other values or without an id are left out).

    Fitted on at most about TOXIC and CLEAN labelled documents, drawn by a hash of the id. Without documents of both
    labels there are no landmarks and every score is the share of toxic ones (0 if there are none).
    """
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    bound = F.when(F.col("toxic") == 1, TOXIC / max(1, n.get(1, 0))).otherwise(CLEAN / max(1, n.get(0, 0)))
    chosen = labels.filter(draw < bound).select("id", "toxic")
    sample = written(docs.join(F.broadcast(chosen), "id"), "labelled")  # bounded by TOXIC + CLEAN rows
    share = n.get(1, 0) / max(1, sum(n.values()))
    none = Model(Landmarks([]), np.zeros((0, 0)), np.zeros(1), 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not n.get(0) or not n.get(1):
        return none

    # words that go with the label: a chi-square of documents that hold them
    word = F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\s]+", ""), r"\s+")))
    held = sample.select("toxic", word.alias("word")).filter(F.length("word").between(LENGTH, LONGEST))
    counts = held.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).filter("p >= 4")
    total = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    good, bad = float(total[0] or 0), float(total[1] or 0)
    if not good or not bad:
        return none
    p, q = F.col("p") / good, F.col("q") / bad
    pooled = (F.col("p") + F.col("q")) / (good + bad)
    ranked = counts.filter(p > 3 * q).withColumn("gain", (p - q) * (p - q) / pooled)
    words = [r.word for r in ranked.orderBy(F.desc("gain"), "word").limit(LANDMARKS).collect()]
    if not words:
        return none
    landmarks = Landmarks(words)

    def values(batches):
        known = Words(landmarks)
        for batch in batches:
            rows = []
            for key, toxic, found in zip(batch["id"], batch["toxic"], known.sentences(batch["text"].tolist()), strict=True):
                different = {x.astype(np.float16).tobytes() for x in found}
                rows += [(key, toxic, x) for x in sorted(different)] or [(key, toxic, b"")]
            yield pd.DataFrame(rows, columns=["id", "toxic", "x"])

    # sentences stay in the shared folder; clean ones are counted by value, toxic ones keep their document
    table = written(sample.mapInPandas(values, "id bigint, toxic int, x binary"), "sentences")
    clean = written(table.filter("toxic = 0").groupBy("x").agg(F.count(F.lit(1)).alias("n")), "clean")
    suspects = written(table.filter("toxic = 1").select("id", "x").distinct(), "suspects")
    gram = landmarks.near(words).astype(np.float64)
    own, basis = np.linalg.eigh((gram + gram.T) / 2)
    root = basis @ np.diag(1 / np.sqrt(np.maximum(own, 0.05))) @ basis.T

    def looks(w: np.ndarray | None):
        """The decision value of each row, before the first round its largest landmark value."""

        def value(batches):
            for batch in batches:
                x = batch["x"].tolist()
                if w is None:
                    batch["v"] = [float(np.frombuffer(b, np.float16).max(initial=0)) for b in x]
                else:
                    batch["v"] = _vectors(x, root) @ w if x else np.zeros(0)
                yield batch

        return value

    w = None
    for _ in range(4):
        seen = suspects.filter(F.length("x") > 0)  # a toxic document without any near word shows nothing
        seen = seen.mapInPandas(looks(w), "id bigint, x binary, v double")
        worst = seen.groupBy("id").agg(F.min_by("x", F.struct(-F.col("v"), "x")).alias("x")).select("x").toPandas()["x"].tolist()
        if not worst:
            return none
        # at most one row for each of the sampled toxic documents
        positive = _vectors(worst, root), np.ones(len(worst))
        w = svm(clean, root, positive, np.zeros(len(words) + 1) if w is None else w)
    # one number for each sampled document
    scored = table.mapInPandas(looks(w), "id bigint, toxic int, x binary, v double").groupBy("id").agg(F.max("v").alias("v"), F.first("toxic").alias("toxic"))
    best = scored.select("v", "toxic").toPandas()
    slope, offset = sigmoid_of(np.maximum(best["v"].to_numpy(), w[-1]), np.where(best["toxic"] == 1, 1.0, -1.0))
    return Model(landmarks, root, w, slope, offset)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs.

    Labels of ids whose crc32 modulo 5 is 0 are held out; scores read the text alone. Whole texts, of any length; a
    null text is an empty one and gets the score of a sentence without any near word; rows with null or repeated ids
    are scored like all others (held_out is that of the empty id). An empty table gives an empty table.
    """
    key = F.col(f"`{id_col}`").cast("bigint")
    fold = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(key.alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), (fold == 0).alias("held_out"))
    known = labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter(
        F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != 0
    )
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.select("id", "text"), known))

    def score(batches):
        m = model.value
        words = Words(m.landmarks)
        for batch in batches:
            texts = batch["text"].tolist()
            for i in range(0, len(texts), 500):
                found = words.sentences(texts[i : i + 500])
                yield pd.DataFrame({"id": batch["id"].iloc[i : i + 500], "held_out": batch["held_out"].iloc[i : i + 500], "score": [m.score(x) for x in found]})

    scored = rows.mapInPandas(score, "id bigint, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
