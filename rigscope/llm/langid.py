"""Language identification: averaged hashed subword embeddings, a linear softmax trained by SGD, calibrated rejection.

A text is lower-cased; subwords are its character 2-, 3- and 4-grams that stay inside a word, with the word's edges as
characters of their own. Each is hashed to one of ``BUCKETS`` embeddings. The mean embedding goes through a linear
softmax; because both are linear, a trained model is one table of class scores by bucket, small enough to broadcast
whatever the corpus (``BUCKETS`` x languages).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.llm.tables import small_batches

BUCKETS = 1 << 16
DIMENSION = 16
MAX_ROWS_PER_LANGUAGE = 500   # bound of the labelled sample that the model is fitted on
UNDETERMINED = "und"
_CROPS = (2, 5, 12, 40)       # words of the short passages that are learned beside whole texts
_STRIP = 1 << 20              # characters hashed at a time
_BAG = "label string, calibrates boolean, at array<int>, weight array<float>"
_MULTIPLIERS = {2: (2654435761, 2246822519), 3: (3266489917, 668265263, 374761393),
                4: (2870177451, 1540483477, 3432918353, 461845907)}


class _Letters:
    """Which code points are letters, made once in each worker."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        return cls.table


def slices(text: str, limit: int) -> Iterator[str]:
    """A text in parts of about ``limit`` characters, cut at blanks only, so that no word is torn."""
    start = 0
    while len(text) - start > limit:
        cut = text.rfind(" ", start + 1, start + limit)
        cut = cut if cut > 0 else text.find(" ", start + limit)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, zero where there is no letter, with a zero at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    out = np.zeros(len(points) + 2, np.uint32)
    np.multiply(points, _Letters.get()[points], out=out[1:-1])
    return out


def _subwords(chars: np.ndarray, begin: int, end: int):
    """For each n the bucket of the n-gram that starts at each position in [begin, end); BUCKETS where there is none."""
    for n, factors in _MULTIPLIERS.items():
        stop = min(end, len(chars) - n + 1)
        if stop <= begin:
            continue
        parts = [chars[begin + k:stop + k] for k in range(n)]
        mixed = parts[0] * np.uint32(factors[0])
        for part, factor in zip(parts[1:], factors[1:]):
            mixed += part * np.uint32(factor)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(2246822507)
        inside = (parts[0] | parts[1]) != 0 if n == 2 else parts[1] != 0
        for part in parts[2:-1]:
            inside &= part != 0
        yield np.where(inside, mixed >> np.uint32(16), np.uint32(BUCKETS)).astype(np.int32)


@dataclass
class LanguageModel:
    """Class scores by bucket (a last row of zeros for "no subword"), temperature and the least accepted confidence."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    history: list[float] = field(default_factory=list)

    def logits(self, texts: list[str]) -> np.ndarray:
        """Mean subword scores of each text, over the whole text; memory follows the strip, not the text."""
        sums, counts = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        group: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            if group:
                part, n = np.zeros((len(group), len(self.labels))), np.zeros(len(group))
                self._add(group, part, n)
                np.add.at(sums, owner, part)
                np.add.at(counts, owner, n)
                group.clear()
                owner.clear()

        for k, text in enumerate(texts):
            for part in slices(text, _STRIP):
                group.append(_characters(part))
                owner.append(k)
                size += len(group[-1])
                if size >= _STRIP:
                    flush()
                    size = 0
        flush()
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def _add(self, group: list[np.ndarray], sums: np.ndarray, counts: np.ndarray) -> None:
        chars = np.concatenate(group)
        starts = np.cumsum([0, *(len(x) for x in group[:-1])])
        for begin in range(0, len(chars), _STRIP):
            end = min(begin + _STRIP, len(chars))
            first = np.searchsorted(starts, begin, side="right") - 1
            last = np.searchsorted(starts, end, side="left")
            cuts = np.maximum(starts[first:last], begin) - begin
            for at in _subwords(chars, begin, end):
                cut = cuts[cuts < len(at)]      # the last positions start no n-gram
                rows = slice(first, first + len(cut))
                sums[rows] += np.add.reduceat(self.scores[at], cut, axis=0, dtype=np.float64)
                counts[rows] += np.add.reduceat(at != BUCKETS, cut, dtype=np.int64)

    def confidence(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct buckets of a text and the share of its subwords in each."""
    chars = _characters(text)
    at = np.concatenate([np.empty(0, np.int32), *_subwords(chars, 0, len(chars))])
    at = at[at != BUCKETS]
    if not len(at):
        return None
    buckets, n = np.unique(at, return_counts=True)
    return buckets, (n / n.sum()).astype(np.float32)


def _bags(batches):
    """Bags of whole texts and of short passages at places that the text's hash picks."""
    for batch in batches:
        rows = {name: [] for name in ("label", "calibrates", "at", "weight")}
        for label, text, pick in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.split()
            passages = [text]
            for n in _CROPS:
                start = (pick >> 8) % max(1, len(words) - n)
                passages.append(" ".join(words[start:start + n]))
            for passage in passages:
                if bag := _bag(passage):
                    for name, value in zip(rows, (label, pick % 5 == 0, *bag)):
                        rows[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["label"], pa.string()), pa.array(rows["calibrates"], pa.bool_()),
             pa.array(rows["at"], pa.list_(pa.int32())), pa.array(rows["weight"], pa.list_(pa.float32()))], list(rows))


def _examples(sample: pa.Table, labels: list[str]):
    """(language number, buckets, shares) of the passages to fit on, and of those to calibrate on, in a fixed order."""
    lists = [sample[name].combine_chunks() for name in ("at", "weight")]
    ends = lists[0].offsets.to_numpy()
    at, weight = (np.split(x.values.to_numpy(), ends[1:-1]) for x in lists) if len(sample) else ([], [])
    number = {y: k for k, y in enumerate(labels)}
    label, calibrates = sample["label"].to_pylist(), sample["calibrates"].to_pylist()
    order = sorted(range(len(at)), key=lambda k: (label[k], len(at[k]), at[k].tobytes()))
    examples = [(calibrates[k], (number[label[k]], at[k], weight[k])) for k in order]
    return [x for aside, x in examples if not aside], [x for aside, x in examples if aside]


def _sgd(bags: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int, rate: float, seed: int):
    """Plain stochastic gradient descent on the cross entropy, one example a step, the rate falling linearly."""
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    weight, bias = np.zeros((classes, DIMENSION), np.float32), np.zeros(classes, np.float32)
    share = np.bincount([y for y, _, _ in bags], minlength=classes) / max(1, len(bags))
    balance = 1 / np.maximum(share * classes, 1e-9)     # every language weighs the same
    steps, step, history = epochs * len(bags), 0, []
    for _ in range(epochs):
        loss = 0.0
        for k in rng.permutation(len(bags)):
            y, at, share_at = bags[k]
            mean = share_at @ embedding[at]
            p = _softmax(weight @ mean + bias)
            loss -= float(np.log(max(p[y], 1e-12)))
            p[y] -= 1
            p *= min(balance[y], 5.0) * rate * (1 - step / steps)
            back = p @ weight
            weight -= np.outer(p, mean)
            bias -= 0.1 * p
            embedding[at] -= share_at[:, None] * back
            step += 1
        history.append(loss / max(1, len(bags)))
    return embedding, weight, bias, history


def train(docs: DataFrame, learn: Column, text_col: str = "text", label_col: str = "lang",
          max_rows: int = MAX_ROWS_PER_LANGUAGE, epochs: int = 6, rate: float = 2.0, accepted: float = 0.999,
          seed: int = 7) -> LanguageModel:
    """Fit on rows where ``learn`` holds and text and label are not null: about ``max_rows`` of each language, picked by
    a hash of the text over all rows (that bound is the operator's parameter; rarer languages give all their rows).

    A fifth of the sample sets the temperature (least cross entropy) and the least accepted confidence: the one that
    lets ``accepted`` of the rightly told calibration passages pass, never above one half. No rows to learn from: a
    model without languages, which calls every text undetermined.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learn).select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).dropna()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    labels = sorted(counts)
    if not labels:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for y in labels for x in (y, min(1.0, 1.1 * max_rows / counts[y]))))
    pick = F.xxhash64("text").bitwiseAND(F.lit((1 << 48) - 1))
    picked = rows.withColumn("pick", pick).where(F.col("pick") / float(1 << 48) < share[F.col("label")])
    fitted, checked = _examples(picked.mapInArrow(_bags, _BAG).toArrow(), labels)
    embedding, linear, bias, history = _sgd(fitted or checked, len(labels), epochs, rate, seed)
    scores = np.zeros((BUCKETS + 1, len(labels)), np.float32)
    scores[:BUCKETS] = embedding @ linear.T
    model = LanguageModel(labels, scores, bias.astype(np.float64), history=history)
    if checked:
        truth = np.array([y for y, _, _ in checked])
        logits = np.array([w @ scores[a] for _, a, w in checked]) + model.bias
        loss = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
                for t in np.geomspace(0.25, 4, 33)}
        model.temperature = float(min(loss, key=loss.get))
        sure = model.confidence(logits)
        right = sure.argmax(1) == truth
        if right.any():
            model.least = float(min(0.5, np.quantile(sure.max(1)[right], 1 - accepted)))
    return model


def predict(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    """Struct column (lang_pred, score, rejected) over whole texts.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Texts whose calibrated confidence is
    below the model's least accepted one keep their likeliest language and are marked rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        label = np.full(len(texts), UNDETERMINED, object)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        known = [k for k, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if model.labels else []
        if known:
            sure = model.confidence(model.logits([texts.iloc[k] for k in known]))
            label[known] = np.array(model.labels, object)[sure.argmax(1)]
            score[known] = sure.max(1)
            rejected[known] = score[known] < model.least
        return pd.DataFrame({"lang_pred": label, "score": score, "rejected": rejected})

    return of(text)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, by the modulus; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out_rows(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id mod 3 is 1, or there is no id."""
    return F.coalesce(remainder(id_col, 3) == 1, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
             **fit) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row; learns from the rows that are not held out.

    Repeated rows are told alike; an empty table gives no rows; other columns are not read.
    """
    model = train(docs, ~held_out_rows(id_col), text_col, label_col, **fit)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out_rows(id_col).alias("held_out"),
                        predict(docs, model, F.col(text_col)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                  **fit) -> DataFrame:
    """The rows whose language is told with enough confidence, with the columns of ``docs``."""
    model = train(docs, ~held_out_rows(id_col), text_col, label_col, **fit)
    return docs.where(~predict(docs, model, F.col(text_col))["rejected"])
