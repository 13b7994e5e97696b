"""Toxicity: a bidirectional gated recurrent network with attention pooling
over word and character inputs, trained in numpy, scoring every overlapping
window of a whole text.

A word's input is a hashed word embedding beside the sum of its hashed
character 4- and 5-gram embeddings (scaled by the root of their number). Both
directions of the network read a window; attention weighs the states; a
document's score is that of its most toxic window. Training picks, in each
epoch, the windows that score highest under the current weights and
back-propagates through them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches, bounded_windows, sample_ids, sampled_texts

WINDOW, STRIDE = 32, 16  # every run of WINDOW - STRIDE + 1 words lies whole in a window
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 16
WORD_DIM = CHAR_DIM = 8
HIDDEN = 8
GROUP = 4096             # windows run together
PER_LABEL = 500          # training documents of a label, at most
EXCERPT = 48             # windows of a long training document chosen by their words, and as many spread over it
LONGEST = 200            # bytes of a word that training reads
PRIOR_WORDS = 2000       # weight of the common rate of a word, in words
BLOCK_WORDS = 60_000     # words of one text scored at a time
EPOCHS = 8
STRIP = b".,;:!?\"'()[]{}<>"


def split_words(text: str | None) -> list[bytes]:
    return [w.strip(STRIP) for w in text.lower().encode("utf-8", "surrogatepass").split()] if text else []


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 4- and 5-grams (with a space at either end) of all
    words: bucket numbers and the number of the word of each."""
    raw = np.frombuffer(b" " + b" ".join(words) + b"     ", np.uint8).astype(np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(length + 1)[:-1]))  # of the space before each word
    word = np.repeat(np.arange(len(words)), length + 1)
    room = (start + length + 2)[word] - np.arange(len(word))   # bytes up to the space after, inclusive
    ids, owner = [], []
    h = raw.copy()
    for n in range(2, 6):
        h = (h[:-1] * np.uint32(0x01000193)) ^ raw[n - 1:]
        if n >= 4:
            ok = room >= n
            x = h[:len(word)][ok] + np.uint32(n)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            ids.append(((x ^ (x >> np.uint32(13))) % np.uint32(CHAR_BUCKETS)).astype(np.int64))
            owner.append(word[ok])
    return np.concatenate(ids), np.concatenate(owner)


@dataclass
class Inputs:
    """The distinct words of some texts, hashed."""
    bucket: np.ndarray       # word bucket
    grams: np.ndarray        # character grams ...
    owner: np.ndarray        # ... and their word
    scale: np.ndarray        # 1 / sqrt(number of grams)

    @staticmethod
    def of(words: list[bytes]) -> "Inputs":
        bucket = np.array([xxhash.xxh32_intdigest(w) % WORD_BUCKETS for w in words], dtype=np.int64)
        grams, owner = char_grams(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        count = np.bincount(owner, minlength=len(words))
        return Inputs(bucket, grams, owner, (1 / np.sqrt(np.maximum(1, count))).astype(np.float32))


def word_numbers(texts: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words of texts, and each text as numbers of them."""
    number: dict[bytes, int] = {}
    out = []
    for words in texts:
        for w in words:
            if w not in number:
                number[w] = len(number)
        out.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    return list(number), out


def windows(ids: np.ndarray, pad: int) -> np.ndarray:
    """Overlapping windows over all words of a text (rows; -> pad after its end)."""
    starts = np.arange(0, max(1, len(ids) - (WINDOW - STRIDE)), STRIDE)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < len(ids), ids[np.minimum(at, max(0, len(ids) - 1))], pad) if len(ids) else np.full((1, WINDOW), pad)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    shift: float = 0.0       # calibration: added to the logit
    _g: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def fresh(seed: int = 5) -> "Network":
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        n = lambda *s, k=0.3: r.normal(0, k, s).astype(np.float32)
        return Network({"word": n(WORD_BUCKETS, WORD_DIM, k=0.05), "char": n(CHAR_BUCKETS, CHAR_DIM, k=0.05),
                        "in": n(d, 6 * h), "in_b": np.zeros(6 * h, np.float32),
                        "rec_f": n(h, 3 * h), "rec_b": n(h, 3 * h),
                        "att": n(2 * h, h), "att_v": n(h), "out": n(2 * h), "out_b": np.full(1, -1.0, np.float32)})

    def embed(self, x: Inputs) -> np.ndarray:
        """Inputs of distinct words, with a zero row at the end for padding."""
        chars = np.zeros((len(x.bucket), CHAR_DIM), np.float32)
        if len(x.grams):
            order = np.argsort(x.owner, kind="stable")
            own = x.owner[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            chars[own[first]] = np.add.reduceat(self.p["char"][x.grams[order]], first, axis=0)
        e = np.hstack([self.p["word"][x.bucket], chars * x.scale[:, None]])
        return np.vstack([e, np.zeros((1, e.shape[1]), np.float32)])

    def forward(self, proj: np.ndarray, w: np.ndarray, pad: int, keep: bool = False):
        """Logits of windows ``w`` (word numbers) given projected inputs."""
        h, n, steps = HIDDEN, len(w), w.shape[1]
        real = (w != pad)
        states = np.zeros((steps, n, 2 * h), np.float32)
        cache = []
        for d, (name, order) in enumerate((("rec_f", range(steps)), ("rec_b", range(steps - 1, -1, -1)))):
            rec, s = self.p[name], np.zeros((n, h), np.float32)
            block = np.ascontiguousarray(proj[:, 3 * h * d:3 * h * (d + 1)])
            for t in order:
                x, a = block[w[:, t]], s @ rec
                zr = _sigmoid(x[:, :2 * h] + a[:, :2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h:] + r * a[:, 2 * h:])
                new = np.where(real[:, t, None], (1 - z) * c + z * s, s)
                if keep:
                    cache.append((d, t, s, z, r, c, a[:, 2 * h:]))
                s = new
                states[t, :, d * h:(d + 1) * h] = s
        u = np.tanh(states @ self.p["att"])
        score = np.where(real.T, u @ self.p["att_v"], np.float32(-1e4))
        e = np.exp(score - score.max(0))
        weight = e / e.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logit, (states, u, weight, pooled, cache, real)) if keep else logit

    def project(self, e: np.ndarray) -> np.ndarray:
        return e @ self.p["in"] + self.p["in_b"]

    def gradients(self, x: Inputs, w: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of windows ``w`` with labels ``y`` and its gradients;
        ``word`` and ``char`` as (rows, values)."""
        h, pad = HIDDEN, len(x.bucket)
        e = self.embed(x)
        logit, (states, u, weight, pooled, cache, real) = self.forward(self.project(e), w, pad, keep=True)
        prob = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d_logit = ((prob - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()])}
        d_pool = d_logit[:, None] * self.p["out"]
        d_weight = (states * d_pool[None]).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0)) * real.T
        d_u = d_score[:, :, None] * self.p["att_v"] * (1 - u * u)
        g["att_v"] = np.einsum("tn,tnk->k", d_score, u)
        g["att"] = np.einsum("tnk,tnj->kj", states, d_u)
        d_states = weight[:, :, None] * d_pool[None] + d_u @ self.p["att"].T
        d_proj = np.zeros((w.shape[1], len(w), 6 * h), np.float32)
        g["rec_f"], g["rec_b"] = np.zeros_like(self.p["rec_f"]), np.zeros_like(self.p["rec_b"])
        carry = {0: np.zeros((len(w), h), np.float32), 1: np.zeros((len(w), h), np.float32)}
        for d, t, s, z, r, c, a in reversed(cache):
            name, rec = ("rec_f", "rec_b")[d], self.p[("rec_f", "rec_b")[d]]
            ds = d_states[t, :, d * h:(d + 1) * h] + carry[d]
            on = real[:, t, None]
            dc = ds * (1 - z) * (1 - c * c) * on
            dz = ds * (s - c) * z * (1 - z) * on
            dr = dc * a * r * (1 - r)
            da = np.hstack([dz, dr, dc * r])
            g[name] += s.T @ da
            d_proj[t, :, 3 * h * d:3 * h * (d + 1)] = np.hstack([dz, dr, dc])
            carry[d] = np.where(on, ds * z, ds) + da @ rec.T
        flat, at = d_proj.reshape(-1, 6 * h), w.T.reshape(-1)
        d_word = np.zeros((pad + 1, 6 * h), np.float32)
        np.add.at(d_word, at, flat)
        d_word[pad] = 0
        g["in"], g["in_b"] = e.T @ d_word, d_word.sum(0)
        d_e = d_word[:pad] @ self.p["in"].T
        touched = np.zeros(pad, bool)
        touched[at[at < pad]] = True
        rows = np.flatnonzero(touched)
        gram = touched[x.owner]
        g["word"] = (x.bucket[rows], d_e[rows, :WORD_DIM])
        g["char"] = (x.grams[gram], (d_e[:, WORD_DIM:] * x.scale[:, None])[x.owner[gram]])
        return loss, g

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Highest window logit of every text (calibrated)."""
        out = np.full(len(texts), -np.inf)
        at = 0
        words = [split_words(t) for t in texts]
        while at < len(words):  # groups of texts of bounded size; a longer text in overlapping blocks
            end, n = at, 0
            while end < len(words) and (end == at or n + len(words[end]) <= BLOCK_WORDS):
                n += len(words[end])
                end += 1
            part = words[at:end]
            step = BLOCK_WORDS // STRIDE * STRIDE
            blocks = [(i, p[b:b + step + WINDOW - STRIDE]) for i, p in enumerate(part)
                      for b in range(0, max(1, len(p)), step)]
            for lo in range(0, len(blocks), max(1, len(blocks) if n <= BLOCK_WORDS else 1)):
                some = blocks[lo:lo + (len(blocks) if n <= BLOCK_WORDS else 1)]
                vocab, ids = word_numbers([b for _, b in some])
                proj = self.project(self.embed(Inputs.of(vocab)))
                w = [windows(v, len(vocab)) for v in ids]
                owner = np.repeat([i for i, _ in some], [len(v) for v in w])
                w = np.concatenate(w)
                for g in range(0, len(w), GROUP):
                    np.maximum.at(out, at + owner[g:g + GROUP], self.forward(proj, w[g:g + GROUP], len(vocab)))
            at = end
        return out + self.shift

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.logits(texts).astype(np.float64))


def rate_odds(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Log ratio of the buckets' rates among all words of toxic and of other
    texts, shrunk towards their common rate; 0 for what is too rare to tell.
    Rates, not documents with a word: longer documents hold more words of any
    kind."""
    n1, n0 = toxic.sum(), other.sum()
    prior = PRIOR_WORDS * (toxic + other) / max(1, n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log((toxic + prior) / (n1 + PRIOR_WORDS)) - np.log((other + prior) / (n0 + PRIOR_WORDS))
    return np.where(toxic + other >= 3, np.clip(odds, -3, 3), 0)


def _warm_start(net: Network, x: Inputs, ids: list[np.ndarray], y: np.ndarray) -> None:
    """First components of the embeddings: the buckets' ``rate_odds``."""
    for key, owner, bucket in (("word", np.arange(len(x.bucket)), x.bucket), ("char", x.owner, x.grams)):
        count = []
        for label in (1, 0):
            of = [v for v, t in zip(ids, y) if t == label]
            times = np.bincount(np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64), minlength=len(x.bucket))
            count.append(np.bincount(bucket, weights=times[owner], minlength=len(net.p[key])))
        net.p[key][:, 0] = rate_odds(*count) * 0.5


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the highest-scoring windows of each document (two of a
    non-toxic one), then a calibration shift on every fifth document, which
    training does not see: the one with the fewest errors, a wrongly flagged
    document counting three times (toxic documents are over-sampled)."""
    net, y = Network.fresh(seed), np.array(labels, dtype=np.float32)
    vocab, ids = word_numbers([split_words(t) for t in texts])
    x, pad, rng = Inputs.of(vocab), len(vocab), np.random.default_rng(seed)
    back = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), bool)
    learn = np.flatnonzero(~back)
    _warm_start(net, x, [ids[i] for i in learn], y[learn])
    win = [windows(v, pad) for v in ids]
    flat, owner = np.concatenate(win), np.repeat(np.arange(len(win)), [len(v) for v in win])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    for _ in range(epochs):
        proj = net.project(net.embed(x))
        logit = np.concatenate([net.forward(proj, flat[i:i + GROUP], pad) for i in range(0, len(flat), GROUP)])
        order = np.lexsort((-logit, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        picked = order[(place < np.where(y[owner[order]] > 0, 1, 2)) & ~back[owner[order]]]
        rng.shuffle(picked)
        for b in range(0, len(picked), 64):
            some = picked[b:b + 64]
            used, w = np.unique(flat[some], return_inverse=True)
            used, w = used[used != pad], w.reshape(len(some), -1)
            _, g = net.gradients(_subset(x, used), w, y[owner[some]])
            t += 1
            for k, grad in g.items():
                if isinstance(grad, tuple):
                    rows, inv = np.unique(grad[0], return_inverse=True)
                    full = np.zeros((len(rows), grad[1].shape[1]), np.float32)
                    np.add.at(full, inv, grad[1])
                else:
                    rows, full = slice(None), grad
                m[k][rows] = 0.9 * m[k][rows] + 0.1 * full
                v2[k][rows] = 0.999 * v2[k][rows] + 0.001 * full * full
                net.p[k][rows] -= rate * (m[k][rows] / (1 - 0.9 ** t)) / (np.sqrt(v2[k][rows] / (1 - 0.999 ** t)) + 1e-8)
    held = np.flatnonzero(back)
    if len(held) and 0 < y[held].sum() < len(held):
        s = net.logits([texts[i] for i in held])
        cut = np.unique(np.concatenate([[s.min() - 1], (np.sort(s)[1:] + np.sort(s)[:-1]) / 2, [s.max() + 1]]))
        cost = [((s < c) & (y[held] > 0)).sum() + 3 * ((s >= c) & (y[held] == 0)).sum() for c in cut]
        best = np.flatnonzero(np.array(cost) == min(cost))
        net.shift = -float(cut[best].mean()) if np.ptp(best) == len(best) - 1 else -float(cut[best[0]])
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    return net


def _subset(x: Inputs, words: np.ndarray) -> Inputs:
    number = np.full(len(x.bucket), -1)
    number[words] = np.arange(len(words))
    on = number[x.owner] >= 0
    return Inputs(x.bucket[words], x.grams[on], number[x.owner[on]], x.scale[words])


def word_buckets(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh32_intdigest(w) % WORD_BUCKETS) for w in words),
                       np.int64, len(words))


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of every bucket, by label."""
    count = np.zeros((2, WORD_BUCKETS), np.int64)
    for batch in batches:
        for y, text in zip(batch["label"], batch["text"]):
            count[y] += np.bincount(word_buckets(split_words(text)), minlength=WORD_BUCKETS)
    for y in (0, 1):
        at = np.flatnonzero(count[y])
        yield pd.DataFrame({"bucket": at, "y": y, "n": count[y, at]})


def excerpt(text: str, odds: np.ndarray) -> str:
    """What training reads of a document: all of it, or of a long one the
    EXCERPT windows whose words speak most for toxicity, and as many spread
    over it. Every window of the text is compared."""
    words = split_words(text)
    if len(words) > 2 * EXCERPT * STRIDE:
        total = np.concatenate(([0], np.cumsum(odds[word_buckets(words)])))
        starts = np.arange(0, len(words), STRIDE)
        sums = total[np.minimum(starts + WINDOW, len(words))] - total[starts]
        keep = np.zeros(len(words), bool)
        best = np.argsort(-sums, kind="stable")[:EXCERPT]
        for i in np.concatenate((best, np.linspace(0, len(starts) - 1, EXCERPT).astype(int))):
            keep[starts[i]:starts[i] + WINDOW] = True
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(w[:LONGEST] for w in words).decode("utf-8", "replace")


def fit(docs: DataFrame, labels: DataFrame, learn, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "toxic", per_label: int = PER_LABEL) -> Network | None:
    """Network from a bounded sample of labelled rows where ``learn`` holds:
    the ``per_label`` documents of label 1 and of label 0 with the smallest
    hashes, whatever their length. All their words are counted on the
    executors; these counts choose the windows of a long document that the
    driver gets (``excerpt``). None without both labels. An id labelled both
    ways counts as toxic."""
    marks = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
                   .where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(learn & (F.length("text") >= 1))
    ids = sample_ids(rows.select("doc_id").distinct().join(marks, "doc_id"), "doc_id", "y", per_label)
    # ids has at most 2 * per_label rows
    sample = sampled_texts(rows, ids, "doc_id", "y", "text")
    # at most two rows a bucket
    counts = (sample.mapInPandas(_bucket_counts, "bucket long, y int, n long").groupBy("bucket", "y").agg(F.sum("n").alias("n")).collect())
    n = np.zeros((2, WORD_BUCKETS))
    for r in counts:
        n[r["y"], r["bucket"]] = r["n"]
    odds = rate_odds(n[1], n[0])
    got = bounded_windows(sample, lambda t: [excerpt(t, odds)], per_label)
    y = [r["label"] for r in got]
    return train([r["text"] for r in got], y) if 0 < sum(y) < len(y) else None


def score(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5);
    columns of these names are replaced. Whole texts are scored, null as
    empty; without a network every score is 0."""
    bounded_batches(docs.sparkSession, rows=500, mb=4)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.zeros(len(texts)) if net is None else net.scores(list(texts)))

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    s = docs.select(*keep, toxic(F.col(text_col)).alias("_score"))
    return s.select(*keep, F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
