"""Secret scans: fixed patterns, extended by a linear-chain conditional random
field that tags tokens as secret begin, inside or outside.

The patterns' spans always stay. The field is trained on a bounded sample of
documents whose tokens the patterns label, from features that do not see the
token itself but its shape, its neighbouring words, the separators around it
and features of the file; it finds secrets in contexts and of shapes that the
patterns miss. Texts are decoded whole by Viterbi, as max-plus products over
blocks of tokens, which keeps memory and Python steps bounded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches, bounded_windows, sample_ids, sampled_texts, spread_windows

# The patterns, and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so the least length can stand in the pattern
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")  # one is in every text that ASSIGN matches

B, I, O = 0, 1, 2
PER_LABEL = 200       # training documents with and without a pattern's match, at most
WINDOW = 2_000        # characters of a training window, or around a match
PER_DOCUMENT = 8      # windows of a training document, at most
SEQUENCE = 64         # tokens of a training sequence
STEPS = 35
WORDS = 1 << 14       # buckets of neighbouring words
BLOCK = 128           # tokens per block of the decoder
GROUP_BYTES = 1 << 20  # bytes of text decoded at a time

# Bytes by class: 0 none of the others, 1 lower, 2 upper, 3 digit, 4 one of + / _ . -, 5 beyond ASCII
CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    CLASS[_c] = (5 if _c >= 128 else 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit()
                 else 4 if chr(_c) in "+/_.-" else 0)
GAP = np.zeros(256, np.uint8)  # separators: 1 '=' or ':', 2 quote, 4 line break
for _c, _v in (("=", 1), (":", 1), ('"', 2), ("'", 2), ("`", 2), ("\n", 4), ("\r", 4)):
    GAP[ord(_c)] = _v
FEATURES = {"shape": 7 * 16, "mix": 5 * 5 * 2, "head": 1 << 10, "before": WORDS, "before2": WORDS, "after": WORDS,
            "gap_before": 8, "gap_after": 8, "gap_shape": 8 * 7, "file": 5 * 5 * 2}


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret part) of the patterns' matches,
    leftmost non-overlapping per kind, by start, then kind; in code points."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    out.sort()
    return out


def spans_text(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


@dataclass
class Tokens:
    """Tokens of some texts laid end to end as bytes: maximal runs of classed bytes."""
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray               # number of the text
    ids: dict[str, np.ndarray]     # feature values


def _bucket(x: np.ndarray, edges: list) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def tokenise(texts: list[bytes]) -> Tokens:
    """Tokens and features of ``texts``, without a Python step per token."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bound = np.concatenate(([0], np.cumsum(size)))
    cls = CLASS[raw]
    on = np.concatenate(([False], cls > 0, [False]))
    edge = np.flatnonzero(on[1:] != on[:-1])
    start, end = edge[::2], edge[1::2]
    owner = np.searchsorted(bound, start, side="right") - 1
    n = len(start)
    length = end - start
    ids: dict[str, np.ndarray] = {}
    if not n:
        return Tokens(start, end, owner, {k: np.zeros(0, np.int64) for k in FEATURES})
    counts = {}
    for c in (1, 2, 3, 4):
        total = np.concatenate(([0], np.cumsum(cls == c, dtype=np.int32)))
        counts[c] = total[end] - total[start]
    change = np.concatenate(([0], np.cumsum(np.concatenate(([False], cls[1:] != cls[:-1])), dtype=np.int32)))
    changes = change[end] - change[start + 1]
    hexes = np.concatenate(([0], np.cumsum(((raw >= 97) & (raw <= 102)) | ((raw >= 48) & (raw <= 57)), dtype=np.int32)))
    all_hex = (hexes[end] - hexes[start]) == length
    size_class = _bucket(length, [4, 6, 9, 16, 24, 36])
    ids["shape"] = size_class * 16 + (counts[1] > 0) * 8 + (counts[2] > 0) * 4 + (counts[3] > 0) * 2 + (counts[4] > 0)
    ids["mix"] = (_bucket(changes, [1, 3, 6, 12]) * 5 + _bucket(counts[3] / length, [0.01, 0.3, 0.6, 0.999])) * 2 + all_hex
    # a hash of the whole token, lower-cased, and of its first bytes
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    place = np.arange(len(raw), dtype=np.int64)
    inside = on[1:-1]
    at = np.repeat(start, length)
    power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    value = _mix(low[inside] + np.uint64(1)) * power[(place[inside] - at) & 63]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    word = (_mix(np.add.reduceat(value, first)) % np.uint64(WORDS)).astype(np.int64)
    head = np.zeros(n, np.uint64)
    for i in range(4):
        head = head * np.uint64(131) + np.where(i < length, raw[np.minimum(start + i, len(raw) - 1)], 0).astype(np.uint64)
    ids["head"] = (_mix(head) % np.uint64(FEATURES["head"])).astype(np.int64)
    # neighbours, not across texts (bucket 0: none)
    same = np.concatenate(([False], owner[1:] == owner[:-1]))
    ids["before"] = np.where(same, np.concatenate(([0], word[:-1])), 0)
    ids["before2"] = np.where(same & np.concatenate(([False], same[:-1])), np.concatenate(([0, 0], word[:-2]))[:n], 0)
    ids["after"] = np.where(np.append(same[1:], False), np.append(word[1:], 0), 0)
    gap = np.bitwise_or.reduceat(np.concatenate((np.zeros(1, np.uint8), GAP[raw])),
                                 np.stack([np.concatenate(([0], end[:-1] + 1)), start + 1], 1).ravel())[::2]
    gap = np.where(np.concatenate(([True], end[:-1] < start[1:])), gap, 0)
    gap = np.where(same, gap, 4).astype(np.int64)
    ids["gap_before"] = gap
    ids["gap_after"] = np.append(gap[1:], 4)
    ids["gap_shape"] = gap * 7 + size_class
    # the file: share of tokens with digits, of separators, and whether an assignment is in it
    m = len(texts)
    tokens = np.maximum(1, np.bincount(owner, minlength=m))
    digits = np.bincount(owner, weights=counts[3] > 0, minlength=m) / tokens
    seps = np.bincount(owner, weights=(gap & 3) > 0, minlength=m) / tokens
    assigns = np.bincount(owner, weights=(gap & 1) > 0, minlength=m) > 0
    ids["file"] = ((_bucket(digits, [0.001, 0.01, 0.05, 0.2]) * 5 + _bucket(seps, [0.001, 0.01, 0.05, 0.2])) * 2 + assigns)[owner]
    return Tokens(start - bound[owner], end - bound[owner], owner, ids)


@dataclass
class Field:
    weights: dict[str, np.ndarray]   # feature value x state
    trans: np.ndarray                # from x to
    first: np.ndarray

    def emissions(self, t: Tokens) -> np.ndarray:
        e = np.zeros((len(t.start), 3), np.float32)
        for k, ids in t.ids.items():
            e += self.weights[k][ids]
        return e

    def decode(self, t: Tokens) -> np.ndarray:
        """Most likely states of all tokens, each text a sequence of its own."""
        e = self.emissions(t)
        n = len(e)
        if not n:
            return np.zeros(0, np.int8)
        begins = np.concatenate(([True], t.text[1:] != t.text[:-1]))
        blocks = -(-n // BLOCK)
        pad = blocks * BLOCK - n
        # place in the block first and the block last: every step runs along all blocks
        e = np.vstack([e, np.zeros((pad, 3), np.float32)]).reshape(blocks, BLOCK, 3).transpose(1, 2, 0)
        begins = np.append(begins, np.zeros(pad, bool)).reshape(blocks, BLOCK).T
        # Step scores (place, from, to, block): a text's first token forgets the state before it.
        step = np.where(begins[:, None, None], self.first[:, None], self.trans[:, :, None]) + e[:, None]
        total = step[0]  # best scores from the state before the block to each state in it
        for s in step[1:]:
            by = [total[:, x, None] + s[x] for x in range(3)]
            total = np.maximum(np.maximum(by[0], by[1]), by[2])
        alpha = np.zeros((blocks + 1, 3), np.float32)
        for b, block in enumerate(np.ascontiguousarray(total.transpose(2, 0, 1))):
            alpha[b + 1] = (alpha[b][:, None] + block).max(0)
            alpha[b + 1] -= alpha[b + 1].max()
        # inside the blocks again, now with the scores at their start
        score, back = alpha[:-1].T, np.zeros((BLOCK, 3, blocks), np.int8)
        for at, s in enumerate(step):
            by = [score[x] + s[x] for x in range(3)]
            best = np.maximum(by[0], by[1])
            back[at] = np.where(by[2] > best, 2, by[1] > by[0])
            score = np.maximum(best, by[2])
        # the state at the end of each block: from the last block backwards
        every = np.arange(blocks)
        into = back[-1]
        for at in range(BLOCK - 2, -1, -1):  # state before the block for each state at its end
            into = back[at][into, every]
        into = into.T.tolist()
        last = [0] * blocks
        last[-1] = int(score[:, -1].argmax())
        for b in range(blocks - 1, 0, -1):
            last[b - 1] = into[b][last[b]]
        out, s = np.zeros((BLOCK, blocks), np.int8), np.array(last)
        for at in range(BLOCK - 1, -1, -1):
            out[at] = s
            s = back[at][s, every]
        return out.T.reshape(-1)[:n]


def _code_points(raw: bytes) -> np.ndarray:
    """Number of code points before every byte of ``raw``, and of all of them."""
    return np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))


def tagged_runs(t: Tokens, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of every run begin-inside; a run ends with its line."""
    begin = np.flatnonzero(state == B)
    goes_on = (state == I) & (t.ids["gap_before"] & 4 == 0)  # a text's first token counts as on a new line
    stops = np.flatnonzero(np.append(~goes_on, True))
    return begin, stops[np.searchsorted(stops, begin, side="right")] - 1


def train(texts: list[str], steps: int = STEPS, rate: float = 0.1, l2: float = 1e-4) -> Field:
    """Maximum conditional likelihood by Adam over all sequences of the sample
    (forward-backward in numpy), with an L2 penalty."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    t = tokenise(raws)
    y = np.full(len(t.start), O)
    low = np.searchsorted(t.text, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        for _, _, end, secret in base_spans(text):
            a, b = len(text[:secret].encode("utf-8", "surrogatepass")), len(text[:end].encode("utf-8", "surrogatepass"))
            s, e = t.start[low[i]:low[i + 1]], t.end[low[i]:low[i + 1]]
            hit = low[i] + np.flatnonzero((s < b) & (e > a))
            y[hit] = I
            y[hit[:1]] = B
    # sequences: runs of SEQUENCE tokens inside a text, padded
    place = np.arange(len(y)) - low[t.text] if len(y) else np.zeros(0, int)
    seq = np.cumsum((place % SEQUENCE) == 0) - 1
    n_seq = int(seq[-1]) + 1 if len(seq) else 0
    col = place % SEQUENCE
    mask = np.zeros((n_seq, SEQUENCE), bool)
    mask[seq, col] = True
    w = {k: np.zeros((size, 3), np.float32) for k, size in FEATURES.items()}
    w |= {"trans": np.zeros((3, 3), np.float32), "first": np.zeros((1, 3), np.float32)}
    banned = np.zeros((3, 3), np.float32)
    banned[O, I] = -30
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    one = np.eye(3, dtype=np.float32)
    for k in range(1, steps + 1):
        field = Field({f: w[f] for f in FEATURES}, w["trans"] + banned, w["first"][0] + np.array([0, -30, 0], np.float32))
        e = np.zeros((n_seq, SEQUENCE, 3), np.float32)
        e[seq, col] = field.emissions(t)
        a = np.zeros_like(e)
        a[:, 0] = field.first + e[:, 0]
        lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
        for i in range(1, SEQUENCE):
            a[:, i] = np.where(mask[:, i, None], lse(a[:, i - 1, :, None] + field.trans, 1) + e[:, i], a[:, i - 1])
        z = lse(a[:, -1], 1)
        b = np.zeros((n_seq, 3), np.float32)
        post = np.zeros_like(e)
        g = {"trans": np.zeros((3, 3), np.float32)}
        yy = np.full((n_seq, SEQUENCE), O)
        yy[seq, col] = y
        for i in range(SEQUENCE - 1, -1, -1):
            post[:, i] = np.exp(a[:, i] + b - z[:, None]) * mask[:, i, None]
            if i:
                nb = e[:, i] + b
                pair = np.exp(a[:, i - 1, :, None] + field.trans + nb[:, None, :] - z[:, None, None]) * mask[:, i, None, None]
                real = one[yy[:, i - 1]][:, :, None] * one[yy[:, i]][:, None, :] * mask[:, i, None, None]
                g["trans"] += (pair - real).sum(0)
                b = np.where(mask[:, i, None], lse(field.trans[None] + nb[:, None, :], 2), b)
        diff = post - one[yy] * mask[:, :, None]
        g["first"] = diff[:, 0].sum(0, keepdims=True)
        flat = diff[seq, col]
        for f, ids in t.ids.items():
            g[f] = np.stack([np.bincount(ids, weights=flat[:, s], minlength=FEATURES[f]) for s in range(3)], 1)
        for f in w:
            grad = g[f] / max(1, n_seq) + l2 * w[f]
            m[f] = 0.9 * m[f] + 0.1 * grad
            v[f] = 0.99 * v[f] + 0.01 * grad * grad
            w[f] = (w[f] - rate * (m[f] / (1 - 0.9 ** k)) / (np.sqrt(v[f] / (1 - 0.99 ** k)) + 1e-8)).astype(np.float32)
    return Field({f: w[f] for f in FEATURES}, w["trans"] + banned, w["first"][0] + np.array([0, -30, 0], np.float32))


def scan(texts: list[str], field: Field | None) -> list[list[tuple[int, int, int, int]]]:
    """All spans per text, ``base_spans`` and those that the field adds (kind
    crf): runs begin-inside, which end with their line, less the base spans.
    By start, then kind."""
    out = [base_spans(t) for t in texts]
    if field is None:
        return out
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) <= GROUP_BYTES):
            size += len(raws[end])
            end += 1
        t = tokenise(raws[at:end])
        state = field.decode(t)
        begin, last = tagged_runs(t, state)
        for part in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(t.text[begin])) + 1) if len(begin) else ():
            d = at + int(t.text[begin[part[0]]])
            points = _code_points(raws[d])
            out[d] += _parts(texts[d], points, t, begin[part], last[part], out[d])
        at = end
    for spans in out:
        spans.sort()
    return out


def _parts(text: str, points: np.ndarray, t: Tokens, begin: np.ndarray, last: np.ndarray,
           base: list[tuple]) -> list[tuple]:
    """Spans of one text's runs (first and last token), less the base spans. Of
    a run that meets base spans, those parts stay that hold some of a token and
    go on from a base span without white space: the rest of a secret in which a
    pattern stops or begins."""
    lo, hi = points[t.start[begin]], points[t.end[last]]
    if not base:
        return [(s, 3, e, s) for s, e in zip(lo.tolist(), hi.tolist())]
    # the union of the base spans, as disjoint stretches in order
    start, end = np.array([s[0] for s in base]), np.maximum.accumulate([s[2] for s in base])
    opens = np.concatenate(([True], start[1:] > end[:-1]))
    start, end = start[opens], end[np.append(opens[1:], True)]
    out = []
    first, stop = np.searchsorted(end, lo, side="right"), np.searchsorted(start, hi)
    for s, e, i, j, b, z in zip(*(x.tolist() for x in (lo, hi, first, stop, begin, last))):
        if i >= j:
            out.append((s, 3, e, s))
            continue
        opened, closed = points[t.start[b:z + 1]], points[t.end[b:z + 1]]
        lows, highs = [s, *end[i:j].tolist()], [*start[i:j].tolist(), e]
        for k, (x, y) in enumerate(zip(lows, highs)):
            if x < y and np.searchsorted(closed, x, side="right") < np.searchsorted(opened, y) \
                    and (k > 0 and not text[x].isspace() or k < j - i and not text[y - 1].isspace()):
                x, y = y - len(text[x:y].lstrip()), x + len(text[x:y].rstrip())
                out.append((x, 3, y, x))
    return out


def training_windows(text: str) -> list[str]:
    """Windows of a training text: one around every match of a pattern, in an
    order drawn from their contents, or, without a match, some of the text."""
    spans = base_spans(text)
    if not spans:
        return spread_windows(text, WINDOW, 1)
    cuts: list[list[int]] = []
    for start, _, end, _ in spans:
        lo, hi = max(0, start - WINDOW // 2), min(len(text), end + WINDOW // 2)
        if cuts and lo <= cuts[-1][1] and hi - cuts[-1][0] <= 4 * WINDOW:
            cuts[-1][1] = max(cuts[-1][1], hi)
        else:
            cuts.append([lo, hi])
    windows = [text[lo:hi] for lo, hi in cuts]
    return sorted(windows, key=lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")))[:PER_DOCUMENT]


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", per_label: int = PER_LABEL) -> Field | None:
    """Field from a bounded sample: the ``per_label`` documents with the
    smallest hashes in which a pattern may match, and as many others, whatever
    their length. Of the former, windows around all matches are learned from
    (at most PER_DOCUMENT of one), of the others a window. The driver gets
    windows only."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") >= 1)
    may = r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:passw(or)?d|secret|token|api_?key)[\"']? *[:=]"
    ids = sample_ids(rows.select("doc_id", F.col("text").rlike(may).cast("int").alias("hot")), "doc_id", "hot", per_label)
    # ids has at most 2 * per_label rows
    sample = sampled_texts(rows, ids, "doc_id", "hot", "text")
    got = [r["text"] for r in bounded_windows(sample, training_windows, 2 * per_label)]
    return train(got) if any(base_spans(t) for t in got) else None


def find_secrets(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_assign, n_access, n_hex`` (long), ``base_sha256``,
    ``spans`` and ``redacted`` (the text with every secret replaced by
    ``[SECRET]``; null stays null). A null text has no spans. Columns of these
    names are replaced."""
    bounded_batches(docs.sparkSession, rows=1000, mb=4)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            given = [t if t is not None else "" for t in texts]
            rows = []
            for text, given_text, spans in zip(texts, given, scan(given, field)):
                base = [s for s in spans if s[1] < 3]
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)),
                             hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans),
                             None if text is None else redact(given_text, spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    new = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    r = docs.select(*keep, find(F.col(text_col)).alias("_found"))
    return r.select(*keep, *[F.col(f"_found.{c}") for c in new])


def redact(text: str, spans: list[tuple]) -> str:
    """``text`` with the union of the spans' secret parts replaced."""
    out, at = [], 0
    for secret, end in sorted((s[3], s[2]) for s in spans):
        if end <= at:
            continue
        if secret >= at:
            out += [text[at:secret], "[SECRET]"]
        at = end
    return "".join(out) + text[at:]
