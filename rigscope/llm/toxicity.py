"""Toxicity by class-conditional Kneser-Ney models: length-normalised toxic against ordinary log-likelihood.

Each class has an interpolated Kneser-Ney model of the characters inside words (a word's edges are characters too), so
that an insult is known by its stem whatever its ending. The longest histories use counts, shorter ones the number of
different characters seen in front, and the shortest order is shared: both classes back off to the same counts, which
smooths rare expressions alike. The mean log-likelihood ratio by character goes through a logistic curve fitted on
labelled rows that the models have not counted.

Labels are learned only from rows whose crc32 of the id mod 5 is not 0: remainder 4 fits the curve, the others are
counted, all of them. Texts are lower-cased; everything but letters separates words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.llm.langid import _Letters, remainder, slices
from rigscope.llm.tables import materialize, small_batches

ORDER = 4                 # characters of an n-gram: 16 bits each in a 64-bit key
BINS = 4000               # of the histogram that the logistic curve is fitted on
RANGE = 4.0               # mean log-likelihood ratios beyond this are one bin
_STRIP = 1 << 20
_EDGE = "\0"


def _codes(text: str) -> np.ndarray:
    """16-bit codes of the lower-cased letters, zero for all else, with a zero at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    codes = (points ^ points >> np.uint32(16)) & np.uint32(0xFFFF)     # code points beyond 16 bits share codes
    codes[codes == 0] = 1
    out = np.zeros(len(codes) + 2, np.uint64)
    np.multiply(codes, _Letters.get()[points], out=out[1:-1], dtype=np.uint64)
    return out


def _keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of every letter and word end with its history, which does not reach beyond the word's start."""
    padded = np.concatenate([np.zeros(ORDER - 1, np.uint64), codes])
    n = len(codes)
    history = [padded[ORDER - 1 - k:ORDER - 1 - k + n] for k in range(ORDER)]      # k characters back
    for k in range(2, ORDER):
        history[k] = np.where(history[k - 1] != 0, history[k], 0)
    key = history[0].copy()
    for k in range(1, ORDER):
        key |= history[k] << np.uint64(16 * k)
    places = np.flatnonzero(key)                # a zero after a zero predicts nothing
    return places, key[places]


def _gram(key: int) -> str:
    """The n-gram of a key as a string; leading zeros are one word start."""
    text = "".join(chr(key >> 16 * k & 0xFFFF) for k in range(ORDER - 1, 0, -1)).lstrip(_EDGE)
    return (text if len(text) == ORDER - 1 else _EDGE + text) + chr(key & 0xFFFF)


def _key(gram: str) -> int:
    key = 0
    for c in gram:
        key = key << 16 | ord(c)
    return key


class _ClassModel:
    """One class: interpolated Kneser-Ney over n-gram counts; ``shared`` holds the counts of the shortest order."""

    def __init__(self, top: dict[str, int], shared: Counter, letters: int):
        raw = [Counter() for _ in range(ORDER + 1)]
        for gram, n in top.items():
            for k in range(1, len(gram) + 1):
                raw[k][gram[-k:]] += n
        self.counts: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
        self.counts[ORDER] = raw[ORDER]
        for k in range(2, ORDER):
            self.counts[k] = Counter(g[1:] for g in raw[k + 1])
            self.counts[k].update({g: n - self.counts[k].get(g, 0) for g, n in raw[k].items()
                                   if g[0] == _EDGE and len(g) > 1})
        self.counts[1] = shared
        self.letters = letters
        self.discount, self.total, self.kinds = [0.5] * (ORDER + 1), [], []
        for k, counts in enumerate(self.counts):
            many = Counter(counts.values())
            if many[1]:
                self.discount[k] = many[1] / (many[1] + 2 * many[2])
            total, kinds = Counter(), Counter()
            for g, n in counts.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            self.total.append(total)
            self.kinds.append(kinds)
        self.known: dict[str, float] = {}

    def backoff(self, history: str) -> float:
        """Share that a history leaves to the shorter one; all of it if this class has not seen it."""
        k = len(history) + 1
        total = self.total[k].get(history, 0)
        return self.discount[k] * self.kinds[k][history] / total if total else 1.0

    def p(self, gram: str) -> float:
        if not gram:
            return 1 / self.letters
        if gram not in self.known:
            k, history = len(gram), gram[:-1]
            total = self.total[k].get(history, 0)
            own = max(self.counts[k].get(gram, 0) - self.discount[k], 0) / total if total else 0.0
            self.known[gram] = own + self.backoff(history) * self.p(gram[1:])
        return self.known[gram]


@dataclass
class _Table:
    """Values by sorted 64-bit keys."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, values: dict[int, float]) -> _Table:
        keys = np.array(sorted(values), np.uint64)
        return cls(keys, np.array([values[k] for k in keys.tolist()]))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]


@dataclass
class ToxicityModel:
    """Log-likelihood ratios of all n-grams that either class has seen, by order, and of the histories' backoffs."""

    grams: list[_Table] = field(default_factory=list)
    backoffs: list[_Table] = field(default_factory=list)

    @classmethod
    def fit(cls, ordinary: dict[str, int], toxic: dict[str, int]) -> ToxicityModel:
        if not ordinary or not toxic:
            return cls()
        shared: Counter = Counter()
        for top in (ordinary, toxic):
            shared.update(Counter(g[-1] for g in {g[-2:] for g in top}))
        letters = len(shared) + 1
        models = [_ClassModel(top, shared, letters) for top in (ordinary, toxic)]
        ratio = lambda f, x: float(np.log(f(models[1])(x) / f(models[0])(x)))
        grams: list[dict[int, float]] = [{} for _ in range(ORDER + 1)]
        backoffs: list[dict[int, float]] = [{} for _ in range(ORDER + 1)]
        for g in set(ordinary) | set(toxic):
            grams[ORDER][_key(g)] = ratio(lambda m: m.p, g)
            backoffs[ORDER][_key(g[:-1])] = ratio(lambda m: m.backoff, g[:-1])
            for k in range(1, len(g)):
                short = g[-k:]
                if short[0] != _EDGE or k == 1:
                    grams[k].setdefault(_key(short), ratio(lambda m: m.p, short))
                    backoffs[k].setdefault(_key(short[:-1]), ratio(lambda m: m.backoff, short[:-1]))
        return cls([_Table.of(x) for x in grams], [_Table.of(x) for x in backoffs])

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of the last character of each key after the others."""
        if not self.grams:
            return np.zeros(len(keys))
        found, out = self.grams[ORDER].find(keys)
        out = np.where(found, out, 0.0)
        left = np.flatnonzero(~found)
        if not len(left):
            return out
        seen, value = self.backoffs[ORDER].find(keys[left] >> np.uint64(16))
        out[left] += np.where(seen, value, 0.0)
        # dropping the first character of the history leaves its letters; a word's start leaves none in front
        rest = keys[left]
        length = np.ones(len(left), np.int64)
        for k in range(1, ORDER - 1):
            length[(rest >> np.uint64(16 * k) & np.uint64(0xFFFF)) != 0] = k + 1
        for k in range(ORDER - 1, 0, -1):
            at = np.flatnonzero(length >= k)
            at = at[left[at] >= 0]
            short = rest[at] & np.uint64((1 << 16 * k) - 1)
            found, value = self.grams[k].find(short)
            out[left[at[found]]] += value[found]
            seen, value = self.backoffs[k].find(short[~found] >> np.uint64(16))
            out[left[at[~found]]] += np.where(seen, value, 0.0)
            left[at[found]] = -1
        return out

    def mean_ratios(self, texts: list[str | None]) -> np.ndarray:
        """Mean log-likelihood ratio by character of whole texts; 0 where there is no letter."""
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        for k, text in enumerate(texts):
            for part in slices(text or "", _STRIP):
                codes = _codes(part)
                for begin in range(0, len(codes), _STRIP):       # a strip takes its history along
                    ahead = max(0, begin - ORDER + 1)
                    places, keys = _keys(codes[ahead:begin + _STRIP])
                    keys = keys[places >= begin - ahead]
                    sums[k] += self.ratios(keys).sum()
                    counts[k] += len(keys)
        return sums / np.maximum(counts, 1)


def _count(batches):
    """Distinct n-grams of each batch and class with their counts."""
    for batch in batches:
        rows: dict[int, list[np.ndarray]] = {0: [], 1: []}
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
            rows[toxic] += (_keys(_codes(part))[1] for part in slices(text, _STRIP))
        for toxic, keys in rows.items():
            if keys:
                gram, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": gram.view(np.int64), "toxic": np.full(len(gram), toxic),
                                                  "n": n})


def learnable(id_col: str) -> Column:
    return F.coalesce(remainder(id_col, 5) != 0, F.lit(False))


def _calibrates(id_col: str) -> Column:
    return remainder(id_col, 5) == 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> ToxicityModel:
    """Count the n-grams of all labelled texts to learn from; the counts of each task are merged before they travel.

    All distinct n-grams, the rarest too, make the model: discounts and backoffs rest on them. The driver holds them."""
    small_batches(docs.sparkSession)
    known = (labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("toxic")).dropna()
             .where(F.col("toxic").isin(0, 1)).distinct())
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).dropna()
    counted = learnable("doc") & ~_calibrates("doc")
    # a merge join at any size: labels grow with the input, so no task may hold them all
    joined = texts.where(counted).join(known.where(counted).hint("merge"), "doc").select("toxic", "text")
    grams = joined.mapInArrow(_count, "gram long, toxic long, n long").groupBy("gram").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("ordinary"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    table = grams.toArrow()
    names = [_gram(k) for k in table["gram"].to_numpy().view(np.uint64).tolist()]
    both = (dict(zip(names, table[c].to_pylist())) for c in ("ordinary", "toxic"))
    return ToxicityModel.fit(*({g: n for g, n in x.items() if n} for x in both))


def mean_ratios(docs: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """Column of the mean log-likelihood ratio of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.mean_ratios(texts.to_pylist()))

    return of(text)


def fit_curve(x: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve over bins at x with y0 and y1 rows of either class; Newton's method with a
    small penalty on the slope. With rows of one class only: no slope, and the share of that class."""
    if not y0.sum() or not y1.sum():
        return 0.0, float(np.log((y1.sum() + 1) / (y0.sum() + 1)))
    w, scale = np.zeros(2), 10.0        # in tenths of a nat, so that the penalty is mild
    rows = np.stack([x * scale, np.ones(len(x))], axis=1)
    penalty = np.diag([1e-2, 1e-6])
    loss = lambda w: (np.logaddexp(0, -(rows @ w)) @ y1 + np.logaddexp(0, rows @ w) @ y0 + w @ penalty @ w / 2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -500, 500)))
        gradient = rows.T @ ((y0 + y1) * p - y1) + penalty @ w
        curve = (rows * ((y0 + y1) * p * (1 - p))[:, None]).T @ rows + penalty
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] * scale), float(w[1])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, mean_ratio) for every row.

    Null texts count as empty; texts without a letter get the score of a ratio of 0. Rows without an id are scored, held
    out, and never learned from; label rows with a null or any label but 0 and 1 are ignored. Without labels of both
    classes every score is the smoothed share of toxic labels. Repeated rows are scored alike; an empty table gives no
    rows; other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    held_out = F.coalesce(remainder(id_col, 5) == 0, F.lit(True))
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"),
                         mean_ratios(docs, model, F.col(text_col)).alias("mean_ratio"))
    scored = materialize(scored, "toxicity-ratios")
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
             .where(F.col("toxic").isin(0, 1) & _calibrates("doc_id")).distinct())
    place = F.floor((F.col("mean_ratio") + RANGE) / (2 * RANGE) * BINS).cast("int")
    bins = (scored.join(known, "doc_id").groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).alias("bin"))
            .agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1")).orderBy("bin").collect())
    x = np.array([(r.bin + 0.5) * 2 * RANGE / BINS - RANGE for r in bins])
    slope, offset = fit_curve(x, np.array([r.n0 for r in bins], float), np.array([r.n1 for r in bins], float))
    sure = 1 / (1 + F.exp(-(F.lit(slope) * F.col("mean_ratio") + F.lit(offset))))
    out = scored.withColumn("score", sure)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "mean_ratio")
