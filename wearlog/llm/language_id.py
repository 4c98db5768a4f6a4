"""Language of whole texts from averaged hashed subword embeddings with a linear softmax.

A text is lower-cased and all ASCII characters but letters become spaces. Its subwords are the
runs of two to four bytes that have no space inside (at their ends it marks where a word begins
or ends), hashed into 2^18 rows. A text's vector is the mean embedding of its subwords; a linear
layer and softmax turn it into probabilities. Embeddings and layer are learned together by
stochastic gradient descent in numpy.

The model is fitted on a bounded sample: about ``per_language`` labelled texts of each language,
picked by a hash of the id among all that have a letter, however long. Of a text longer than
``max_chars`` characters the fit reads that many from the middle, or from the first letter on if
there is none; prediction reads the whole text. A fifth of the sample is kept
out of the descent and used to calibrate: the temperature that makes probabilities match how often
they are right, and the rejection threshold, below which at most ``miss`` of the texts lie that are
classified correctly. Prediction covers every byte of every text; because mean and layer are
linear, each hashed row then needs one number per language.

Behaviour: a text that is null or has no letter is ``und`` with score 0 and rejected. A row with a
null id or language is predicted but not learned from. With nothing to learn from, every text is
``und``. Equal texts get equal predictions; repeated rows are kept. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog.llm.words import slices

ROW_BITS = 18
DIMENSIONS = 16
PER_LANGUAGE = 1500
MAX_CHARS = 20_000
EPOCHS = 6
RATE = 2.0
BATCH = 16
MISS = 0.001
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: hashed rows and index of the text, for lower-cased texts."""
    n = len(data)
    count = np.diff(offsets)
    text = np.repeat(np.arange(len(count), dtype=np.int32), count)
    space = ~_LETTER[data]
    plain = np.where(space, np.uint8(32), data).astype(np.uint32)
    packed = plain
    inside = np.zeros(n, bool)  # a space inside the run that starts here
    for k in range(1, 4):
        if n <= k:
            return
        if k > 1:
            inside = inside[:-1] | space[k - 1 : n - 1]
        else:
            inside = inside[:-1]
        packed = packed[:-1] | plain[k:] << np.uint32(8 * k)
        good = ~inside & (text[:-k] == text[k:]) & ~(space[:-k] & space[k:])
        rows = (packed[good] + np.uint32(k)) * np.uint32(2654435761) >> np.uint32(32 - ROW_BITS)
        yield rows, text[:-k][good]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a number for each hashed row and language
    bias: np.ndarray
    temperature: float
    threshold: float


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    found = [r for r, _ in subwords(data, np.array([0, len(data)]))]
    rows = np.concatenate(found) if found else np.zeros(0, np.uint32)
    rows, times = np.unique(rows, return_counts=True)
    return rows, (times / max(1, times.sum())).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7, miss: float = MISS) -> Model:
    """Gradient descent over the texts in a seeded order, then calibration on every fifth."""
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    features = [_features(x) for x in texts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept_out, learned = order[: len(order) // 5], order[len(order) // 5 :]
    rows = rng.normal(0, 1 / DIMENSIONS, (1 << ROW_BITS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = max(1, EPOCHS * len(learned)), 0
    for _ in range(EPOCHS):
        learned = rng.permutation(learned)
        for start in range(0, len(learned), BATCH):
            batch = learned[start : start + BATCH]
            rate = np.float32(RATE * (1 - done / steps))
            done += len(batch)
            mean = np.stack([features[i][1] @ rows[features[i][0]] for i in batch])
            wrong = _softmax(mean @ layer + bias)
            wrong[np.arange(len(batch)), target[batch]] -= 1
            back = wrong @ layer.T
            layer -= rate * mean.T @ wrong / len(batch)
            bias -= rate * wrong.mean(axis=0)
            for i, g in zip(batch, back):
                rows[features[i][0]] -= rate * features[i][1][:, None] * g
    table = rows @ layer
    logits = lambda which: np.array([features[i][1] @ table[features[i][0]] + bias for i in which]).reshape(len(which), len(languages))
    temperature, threshold = 1.0, 0.0
    if len(kept_out):
        x, y = logits(kept_out), target[kept_out]

        def loss(t: float) -> float:
            return float(-np.log(_softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean())

        temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        p = _softmax(x / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        threshold = min(0.5, float(np.quantile(right, miss))) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), bias, float(temperature), threshold)


def learn(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model | None:
    """Fit on about ``per_language`` texts of each language among the rows that may be learned from."""
    labelled = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    middle = F.col("text").substr(F.floor((F.length("text") - max_chars) / 2).cast("int") + 1, F.lit(max_chars))
    first = F.regexp_extract("text", r"\p{L}(?s:.*)", 0).substr(1, max_chars)
    window = F.when(F.length("text") <= max_chars, F.col("text")).when(middle.rlike(r"\p{L}"), middle).otherwise(first)
    sample = labelled.where(spot < share[F.col("lang")]).select("doc_id", "lang", window.alias("text")).limit(2 * per_language * len(counts)).collect()
    sample.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return fit([r.text for r in sample], [r.lang for r in sample]) if sample else None


def score_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and calibrated probability of each text."""
    best, sure = [], []
    for _, data, offsets in slices(pc.utf8_lower(pc.fill_null(texts, ""))):
        n = len(offsets) - 1
        total, times = np.zeros((n, len(model.languages))), np.zeros(n)
        for rows, text in subwords(data, offsets):
            times += np.bincount(text, minlength=n)
            for k in range(len(model.languages)):
                total[:, k] += np.bincount(text, model.table[:, k][rows], n)
        p = _softmax((total / np.maximum(times, 1)[:, None] + model.bias) / model.temperature)
        best.append(p.argmax(axis=1))
        sure.append(p.max(axis=1))
    return np.concatenate(best) if best else np.zeros(0, int), np.concatenate(sure) if sure else np.zeros(0)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred, score and rejected to the rows; all other columns stay."""
    name = "_text"
    while name in docs.columns:
        name += "_"
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.table = np.asfortranarray(m.table)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            best, sure = score_texts(m, texts)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            named = pa.array([m.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)], pa.string())
            sure = np.where(lettered, np.clip(sure, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], named, pa.array(sure), pa.array(~lettered | (sure < m.threshold))],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"],
            )

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = docs.select(kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*kept, F.col("text").alias(name)).mapInArrow(predict, schema)
