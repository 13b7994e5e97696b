"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent in numpy, with a calibrated
rejection threshold.

Subwords are the byte 2-, 3- and 4-grams of the lower-cased text with every
ASCII non-letter as a space. Every language that is known of a training row is
a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches, bounded_windows, sample_ids, sampled_texts, spread_windows

BUCKETS = 1 << 16
DIM = 16
EPOCHS = 12
PER_LABEL = 400       # training documents of a language, at most
WINDOW = 4_000        # characters of a training window
PER_DOCUMENT = 2      # windows of a training document, at most
WINDOWS = 20_000      # training windows of all languages, about
LEAST_WINDOWS = 8     # of each language, where there are many
BLOCK = 1 << 20       # bytes hashed at a time
MULTIPLIER = np.uint32(2654435761)
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords, a block of the text at a time."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS_ONLY) + b" "
    for at in range(0, len(raw), BLOCK):
        a = np.frombuffer(raw[at:at + BLOCK + 3], np.uint8).astype(np.uint32)
        out, h = [], a
        for n in (2, 3, 4):
            if len(a) < n:
                break
            h = (h[:-1] << np.uint32(8)) | a[n - 1:]
            # a block's last grams reach into the next block's bytes
            out.append(((h[:BLOCK] + np.uint32(n)) * MULTIPLIER) >> np.uint32(16))
        if out:
            yield np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return text is not None and next((True for c in text if c.isalpha()), False)


@dataclass
class Model:
    labels: list[str]
    emb: np.ndarray        # embedding per bucket
    out: np.ndarray        # class scores per dimension
    bias: np.ndarray
    temperature: float     # divides the scores; fitted on held-back training rows
    threshold: float       # probability below which a prediction counts as rejected

    @property
    def table(self) -> np.ndarray:
        """Class scores per bucket."""
        return self.emb @ self.out

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.emb.shape[1]), 0
        for ids in buckets(text):
            times = np.bincount(ids, minlength=len(self.emb))
            used = np.flatnonzero(times)  # a bucket's embedding is looked up once a block
            total += times[used] @ self.emb[used]
            n += len(ids)
        s = (total / max(n, 1) @ self.out + self.bias) / self.temperature
        e = np.exp(s - s.max())
        return e / e.sum()


def train(texts: list[str], labels: list[str], seed: int = 3, epochs: int = EPOCHS, rate: float = 0.5) -> Model:
    """SGD over the documents; every fifth, but none of a language of fewer
    than five, is held back to fit the temperature and the threshold that 99
    of 100 right predictions reach."""
    names, y = np.unique(np.array(labels, dtype=object), return_inverse=True)
    names = names.tolist()
    feats = []
    for t in texts:
        ids, n = np.unique(np.concatenate([*buckets(t), np.zeros(0, np.uint32)]), return_counts=True)
        feats.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    back = (np.arange(len(y)) % 5 == 4) & (np.bincount(y)[y] >= 5)
    learn = np.flatnonzero(~back)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            ids, w = feats[i]
            hidden = w @ emb[ids]
            s = hidden @ out + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            to_hidden = out @ p
            out -= step * np.outer(hidden, p)
            bias -= step * 0.1 * p
            # an average over thousands of subwords: scale the step up again
            emb[ids] -= (step * 50 * w)[:, None] * to_hidden[None, :]
    held = np.flatnonzero(back) if back.any() else learn
    scores = np.stack([feats[i][1] @ emb[feats[i][0]] @ out + bias for i in held])
    right = scores.argmax(1) == y[held]

    def prob(t: float) -> np.ndarray:
        e = np.exp((scores - scores.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(prob(t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    sure = np.sort(prob(t).max(1)[right])
    return Model(names, emb, out, bias, t, float(sure[int(0.01 * len(sure))]) if len(sure) else 1.0)


def fit(docs: DataFrame, learn, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        per_label: int = PER_LABEL) -> Model | None:
    """Model from a bounded sample of the rows where ``learn`` holds and the
    language is known: all languages; of each, the ``per_label`` documents with
    the smallest hashes, whatever their length, and of these windows of
    WINDOW characters, at most PER_DOCUMENT of one and as many of a language
    as WINDOWS leaves it, but LEAST_WINDOWS. The driver gets windows only.
    None if there are none."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labels = rows.select("lang").distinct().count()
    # ids has at most per_label rows a language; an id under several languages counts for the last of them
    ids = sample_ids(rows, "doc_id", "lang", per_label)
    sample = sampled_texts(rows, ids, "doc_id", "lang", "text")
    share = min(PER_DOCUMENT * per_label, max(LEAST_WINDOWS, WINDOWS // max(1, labels)))
    got = bounded_windows(sample, lambda t: [w for w in spread_windows(t, WINDOW, PER_DOCUMENT) if has_letter(w)], share)
    return train([r["text"] for r in got], [r["label"] for r in got]) if got else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` (a learned language; ``und`` for a null text
    or one without a letter, or without a model), ``score`` (its calibrated
    probability, 0 for und) and ``rejected`` (below the model's threshold).
    Columns of these names are replaced. Whole texts are scored."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                if model is None or not has_letter(t):
                    out.append(("und", 0.0, True))
                else:
                    p = model.probabilities(t)
                    out.append((model.labels[int(p.argmax())], float(p.max()), bool(p.max() < model.threshold)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    new = ["lang_pred", "score", "rejected"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    r = docs.select(*keep, predict(F.col(text_col)).alias("_prediction"))
    return r.select(*keep, *[F.col(f"_prediction.{c}") for c in new])
