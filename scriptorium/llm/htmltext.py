"""Main text of HTML pages by a recurrent block labeller.

A page is the sequence of its blocks (``htmlblocks``). A block is read as the
mean embedding of the words on its tag path, the mean embedding of its hashed
words and some measures of its shape; a bidirectional LSTM reads all blocks
of the page, so that every block is classified in the context of the whole
document. Network and training are numpy.

No table labels blocks. The network learns from a bounded sample: windows of
pages whose markup names the article (``article``, ``main`` and the like), and
pages laid out here at random with words of these windows, which have menus,
notices, adverts, forms and comments under many names or none at all.

Rules. Blocks the network takes for main text are joined by a blank line, in
page order, whole. A null or empty page, or one without such a block, has an
empty text. Every row is kept, with its other columns.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.htmlblocks import Block, Node, page_blocks
from scriptorium.llm.ngrams import LOWER, Prefixes, class_table, runs

PAGES = 300           # sampled pages, at most
WINDOWS = 400         # windows of them that are learned from, at most
WINDOW = 64           # blocks of a window
LAYOUTS = 900         # pages laid out at random
POOL = 400            # texts that these take their words from, at most
EPOCHS = 8
BATCH = 16            # pages of a training step
TAGS, WORDS = 1 << 12, 1 << 12
TAG_DIM, WORD_DIM, HIDDEN = 12, 8, 16
SHAPE = 8
CELLS = 1 << 14       # blocks read at a time
SPACE = class_table((0x00, 0x20))

# Names that pages give to their parts.
INSIDE = frozenset(("article", "main", ".main", ".articlebody", ".article"))
OUTSIDE = frozenset("""nav header footer aside form button select dialog menu .nav .navigation .menu .navbar .breadcrumb .breadcrumbs
    .footer .sidebar .widget .ad .ads .advert .advertisement .sponsored .promo .banner .cookie .cookies .consent .notice .alert .popup
    .modal .newsletter .subscribe .share .social .related .recommended .comments .comment .replies .respond .search .login""".split())


# --- features -------------------------------------------------------------------------------------------

@dataclass
class Features:
    """Blocks of some pages laid end to end."""
    tags: np.ndarray       # buckets of the path words
    tag_from: np.ndarray   # first of each block (and the end)
    words: np.ndarray
    word_from: np.ndarray
    shape: np.ndarray
    sizes: np.ndarray      # blocks of each page

    def page_starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def tag_buckets(node: Node, memo: dict[frozenset, np.ndarray]) -> np.ndarray:
    got = memo.get(node.path)
    if got is None:
        names = sorted(node.path) + [f"leaf {node.tag}"]
        got = memo[node.path] = np.unique([zlib.crc32(n.encode("utf-8", "surrogatepass")) % TAGS for n in names])
    return got


def features(pages: list[list[Block]]) -> Features:
    blocks = [b for p in pages for b in p]
    sizes = np.fromiter(map(len, pages), np.int64, len(pages))
    n = len(blocks)
    memo: dict[frozenset, np.ndarray] = {}
    tags = [tag_buckets(b.node, memo) for b in blocks]
    texts = [b.text.encode("utf-8", "surrogatepass") for b in blocks]
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, n) + 1
    begin = np.cumsum(size) - size
    start, end = runs(SPACE[raw])
    words = (Prefixes(LOWER[raw]).fingerprints(start, end) % np.uint64(WORDS)).astype(np.int64)
    word_from = np.append(np.searchsorted(start, begin), len(start))
    count = np.diff(word_from)

    def share(of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(of)))
        return (total[begin + size - 1] - total[begin]) / np.maximum(size - 1, 1)

    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of = np.repeat(sizes, sizes)
    links = np.array([b.links / len(b.text) for b in blocks], np.float32) if n else np.zeros(0, np.float32)
    stops = np.isin(raw, np.frombuffer(b".,;!?", np.uint8))
    shape = np.stack([np.log1p(size) / 5, np.log1p(count) / 4, links, 10 * share(stops), 5 * share((raw >= 48) & (raw <= 57)),
                      5 * share((raw >= 65) & (raw <= 90)), place / np.maximum(of - 1, 1), np.log1p(of) / 5], 1).astype(np.float32)
    lengths = np.fromiter(map(len, tags), np.int64, n)
    return Features(np.concatenate([np.zeros(0, np.int64), *tags]), np.concatenate(([0], np.cumsum(lengths))), words, word_from, shape, sizes)


def _means(ids: np.ndarray, bound: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over each stretch of ``ids`` (none: 0)."""
    n = np.diff(bound)
    out = np.zeros((len(n), table.shape[1]), table.dtype)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(table[ids], bound[:-1][some], axis=0) / n[some, None]
    return out


# --- network --------------------------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _order(sizes: np.ndarray, back: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pages by falling size, and per step the blocks read in that order
    (``back``: from the last block to the first)."""
    by = np.argsort(-sizes, kind="stable")
    starts, s = (np.cumsum(sizes) - sizes)[by], sizes[by]
    longest = int(s[0]) if len(s) else 0
    active = np.searchsorted(-s, -np.arange(longest), side="left")
    return by, [starts[:k] + (s[:k] - 1 - t if back else t) for t, k in enumerate(active)]


class Labeller:
    """Parameters by name; gates are input, forget, output, candidate."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        inputs = TAG_DIM + WORD_DIM + SHAPE
        glorot = lambda a, b: rng.normal(0, (2 / (a + b)) ** 0.5, (a, b)).astype(np.float32)
        self.p = {"tag": rng.normal(0, 0.3, (TAGS, TAG_DIM)).astype(np.float32), "word": rng.normal(0, 0.3, (WORDS, WORD_DIM)).astype(np.float32),
                  "out": glorot(2 * HIDDEN + inputs, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"{d}x"], self.p[f"{d}h"] = glorot(inputs, 4 * HIDDEN), glorot(HIDDEN, 4 * HIDDEN)
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN:2 * HIDDEN] = 1
            self.p[f"{d}b"] = b

    def _inputs(self, f: Features) -> np.ndarray:
        return np.concatenate([_means(f.tags, f.tag_from, self.p["tag"]), _means(f.words, f.word_from, self.p["word"]), f.shape], 1)

    def _direction(self, d: str, x: np.ndarray, sizes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; ``keep`` collects what training needs."""
        wx = x @ self.p[f"{d}x"] + self.p[f"{d}b"]
        out = np.zeros((len(x), HIDDEN), np.float32)
        _, steps = _order(sizes, d == "b")
        h = c = np.zeros((len(sizes), HIDDEN), np.float32)
        for at in steps:
            before_h, before_c = h[:len(at)], c[:len(at)]
            z = wx[at] + before_h @ self.p[f"{d}h"]
            gate = _sigmoid(z[:, :3 * HIDDEN])
            i, fo, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            c = fo * before_c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[at] = h
            if keep is not None:
                keep.append((at, before_h, before_c, i, fo, o, g, tc))
        return out

    def scores(self, f: Features) -> np.ndarray:
        """Probability of main text, per block."""
        if not int(f.sizes.sum()):
            return np.zeros(0, np.float32)
        x = self._inputs(f)
        h = np.concatenate([self._direction("f", x, f.sizes), self._direction("b", x, f.sizes), x], 1)
        return _sigmoid((h @ self.p["out"])[:, 0] + self.p["bias"][0])

    def gradients(self, f: Features, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy and its gradients."""
        x, kept = self._inputs(f), {"f": [], "b": []}
        h = np.concatenate([self._direction(d, x, f.sizes, kept[d]) for d in "fb"] + [x], 1)
        p = _sigmoid((h @ self.p["out"])[:, 0] + self.p["bias"][0])
        loss = float(-np.mean(np.log(np.maximum(np.where(y > 0, p, 1 - p), 1e-7))))
        dz = ((p - y) / len(y))[:, None].astype(np.float32)
        g = {"out": h.T @ dz, "bias": dz.sum(0)}
        dh = dz @ self.p["out"].T
        dx = dh[:, 2 * HIDDEN:].copy()
        for k, d in enumerate("fb"):
            from_out = dh[:, k * HIDDEN:(k + 1) * HIDDEN]
            dwx = np.zeros((len(x), 4 * HIDDEN), np.float32)
            g[f"{d}h"] = np.zeros_like(self.p[f"{d}h"])
            next_h, next_c = np.zeros((0, HIDDEN), np.float32), np.zeros((0, HIDDEN), np.float32)
            for at, before_h, before_c, i, fo, o, cand, tc in reversed(kept[d]):
                to_h = from_out[at].copy()
                to_h[:len(next_h)] += next_h
                to_c = to_h * o * (1 - tc * tc)
                to_c[:len(next_c)] += next_c
                z = np.concatenate([to_c * cand * i * (1 - i), to_c * before_c * fo * (1 - fo), to_h * tc * o * (1 - o),
                                    to_c * i * (1 - cand * cand)], 1)
                dwx[at] = z
                g[f"{d}h"] += before_h.T @ z
                next_h, next_c = z @ self.p[f"{d}h"].T, to_c * fo
            g[f"{d}x"], g[f"{d}b"] = x.T @ dwx, dwx.sum(0)
            dx += dwx @ self.p[f"{d}x"].T
        for name, ids, bound, part in (("tag", f.tags, f.tag_from, dx[:, :TAG_DIM]),
                                       ("word", f.words, f.word_from, dx[:, TAG_DIM:TAG_DIM + WORD_DIM])):
            n = np.diff(bound)
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], ids, np.repeat(part / np.maximum(n, 1)[:, None], n, axis=0))
        return loss, g


def train(samples: list[tuple[Features, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> Labeller:
    """Adam over batches of pages; some path words are hidden at random, so
    that no block hangs on a single name."""
    net, rng = Labeller(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(samples) // BATCH)
    for _ in range(epochs):
        by = rng.permutation(len(samples))
        for lo in range(0, len(by), BATCH):
            f, y = _join([samples[i] for i in by[lo:lo + BATCH]], rng)
            _, g = net.gradients(f, y)
            step += 1
            now = rate * (1 - 0.9 * step / steps)
            norm = sum(float((x * x).sum()) for x in g.values()) ** 0.5
            for k, x in g.items():
                x = x * min(1.0, 5 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                net.p[k] -= (now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def _join(samples: list[tuple[Features, np.ndarray]], rng) -> tuple[Features, np.ndarray]:
    tags, lengths = [], []
    for f, _ in samples:
        stay = rng.random(len(f.tags)) >= (0.1 if rng.random() < 0.8 else 0.4)
        tags.append(f.tags[stay])
        total = np.concatenate(([0], np.cumsum(stay)))
        lengths.append(np.diff(total[f.tag_from]))
    n = np.concatenate(lengths)
    words = np.concatenate([np.diff(f.word_from) for f, _ in samples])
    cat = lambda k: np.concatenate([getattr(f, k) for f, _ in samples])
    return (Features(np.concatenate(tags), np.concatenate(([0], np.cumsum(n))), cat("words"), np.concatenate(([0], np.cumsum(words))),
                     cat("shape"), cat("sizes")), np.concatenate([y for _, y in samples]).astype(np.float32))


# --- what it learns from --------------------------------------------------------------------------------

def marked_blocks(blocks: list[Block]) -> np.ndarray | None:
    """Labels by the page's own markup: inside an article or main element and
    not in a part that is named otherwise. None if nothing is inside one."""
    y = np.array([bool(b.node.path & INSIDE) and not b.node.path & OUTSIDE for b in blocks], bool)
    return y if y.any() else None


# Names of parts of invented layouts, and what stands in them.
PARTS = {
    "nav": ("<nav>|</nav>", "<div class=\"menu\">|</div>", "<ul id=\"navbar\">|</ul>", "<div class=\"breadcrumbs\">|</div>",
            "<div role=\"navigation\">|</div>", "<header><nav>|</nav></header>", "<div>|</div>"),
    "header": ("<header>|</header>", "<div id=\"header\">|</div>", "<div class=\"site-header masthead\">|</div>", "<div class=\"topbar\">|</div>"),
    "notice": ("<div class=\"cookie-banner\">|</div>", "<div class=\"notice\">|</div>", "<div id=\"consent\">|</div>",
               "<div role=\"alert\">|</div>", "<dialog>|</dialog>", "<div class=\"popup modal\">|</div>", "<section class=\"alert\">|</section>"),
    "ad": ("<div class=\"ad\">|</div>", "<div class=\"ads\"><p>|</p></div>", "<div class=\"advert\">|</div>", "<section class=\"sponsored\">|</section>",
           "<aside class=\"promo\">|</aside>", "<div id=\"advertisement\">|</div>"),
    "aside": ("<aside>|</aside>", "<div class=\"sidebar\">|</div>", "<div id=\"sidebar\" class=\"widget\">|</div>", "<div class=\"related\">|</div>",
              "<section class=\"recommended\">|</section>", "<div class=\"share social\">|</div>"),
    "form": ("<form>|</form>", "<form class=\"newsletter\">|</form>", "<div class=\"subscribe\"><form>|</form></div>", "<form id=\"search\">|</form>",
             "<form class=\"login\">|</form>"),
    "comments": ("<div class=\"comments\">|</div>", "<section id=\"comments\">|</section>", "<div id=\"respond\" class=\"comment-list\">|</div>",
                 "<ol class=\"comments\">|</ol>", "<div class=\"replies\">|</div>"),
    "footer": ("<footer>|</footer>", "<div id=\"footer\">|</div>", "<div class=\"site-footer\">|</div>", "<div class=\"copyright\">|</div>", "<footer><div>|</div></footer>"),
}
MAIN = ("<article>|</article>", "<main>|</main>", "<main><article>|</article></main>", "<div class=\"content\">|</div>", "<div id=\"main\">|</div>",
        "<div class=\"post entry-content\">|</div>", "<section class=\"story\">|</section>", "<div class=\"article-body\">|</div>",
        "<div itemprop=\"articleBody\">|</div>", "<table><tr><td>|</td></tr></table>", "<div><div>|</div></div>", "<article class=\"post\"><div class=\"text\">|</div></article>")
PHRASES = {"notice": ("We use cookies to improve this site", "Accept all cookies", "This site uses cookies. Accept or decline", "Please enable notifications"),
           "form": ("Subscribe to our newsletter", "Your email address", "Search", "Sign up", "Log in", "Send"),
           "footer": ("&copy; All rights reserved", "Privacy policy", "Terms of use", "Contact", "Imprint &middot; Privacy"),
           "comments": ("3 comments", "Reply", "Leave a comment", "Anonymous says:", "Posted by a reader"),
           "ad": ("Advertisement", "Sponsored", "Buy now"), "header": ("Home", "Menu", "Welcome"), "nav": ("Home", "About", "Contact"),
           "aside": ("Related articles", "Most read", "Share this", "Follow us")}
MARK = ""  # set before every block of the main text, taken off again


def invented_page(rng: random.Random, pool: list[list[str]]) -> str:
    """A page laid out at random; blocks of main text begin with MARK."""
    def prose(lo: int, hi: int) -> str:
        out: list[str] = []
        n = rng.randint(lo, hi)
        while len(out) < n:
            got = rng.choice(pool)
            at = rng.randrange(len(got))
            out += got[at:at + rng.randint(3, 12)]
        return " ".join(out[:n])

    def item(kind: str) -> str:
        if kind == "nav" or rng.random() < 0.25:
            few = [f"<a href=\"#\">{prose(1, 2) if rng.random() < 0.8 else rng.choice(PHRASES[kind])}</a>" for _ in range(rng.randint(2, 7))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in few) + "</ul>" if rng.random() < 0.7 else "".join(f"<div>{x}</div>" for x in few)
        if kind == "comments":
            return "".join(f"<{w}>{prose(3, 40)}</{w}>" for w in [rng.choice(["p", "li", "div"])] * rng.randint(1, 5)) + rng.choice(PHRASES[kind])
        text = rng.choice(PHRASES[kind]) if rng.random() < 0.4 else prose(3, 20)
        return rng.choice(["{}", "<p>{}</p>", "<h3>{}</h3><p>{}</p>"]).replace("{}", text)

    def part(kind: str) -> str:
        names = PARTS[kind]
        # one in ten goes without a name: shape and place must tell
        wrap = "<div>|</div>" if kind in ("nav", "footer") and rng.random() < 0.1 else rng.choice(names)
        return wrap.replace("|", item(kind))

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{MARK}{prose(1, rng.choice([3, 12, 50, 120]))}</p>" if rng.random() < 0.85 else f"<p>{MARK}<b>{prose(2, 40)}<br>"
        if kind < 0.8:
            return f"<h{rng.randint(2, 4)}>{MARK}{prose(1, 8)}</h2>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{MARK}{prose(2, 20)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote>{MARK}{prose(5, 50)}</blockquote>"
        return f"<p>{MARK}{prose(3, 30)} <a href=\"#\">{prose(1, 3)}</a> {prose(3, 30)}</p>"

    body = [f"<h1>{MARK}{prose(2, 12)}</h1>"] + [block() for _ in range(rng.choice([1, 2, 4, 8, 16, 30]))]
    for kind in ("ad", "aside", "form", "notice"):  # parts may stand in the middle of an article
        if rng.random() < 0.2:
            body.insert(rng.randint(1, len(body)), part(kind))
    if rng.random() < 0.15:
        body.append(part("comments"))
    has = lambda kind, p: [part(kind)] if rng.random() < p else []
    top = has("header", 0.4) + has("nav", 0.8) + has("notice", 0.3) + has("ad", 0.4)
    low = has("comments", 0.3) + has("aside", 0.4) + has("form", 0.3) + has("ad", 0.2) + has("notice", 0.2) + has("footer", 0.8)
    side = has("aside", 0.2)
    wrap = rng.choice(["{}", "<div id=\"page\">{}</div>", "<div class=\"wrapper\"><div class=\"container\">{}</div></div>"])
    return "<html><head><title>x</title></head><body>" + wrap.replace(
        "{}", "".join(top + side) + rng.choice(MAIN).replace("|", "".join(body)) + "".join(low)) + "</body></html>"


def invented(pool: list[list[str]], n: int = LAYOUTS, seed: int = 9) -> list[tuple[Features, np.ndarray]]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        blocks = page_blocks(invented_page(rng, pool))
        y = np.array([MARK in b.text for b in blocks])
        for b in blocks:
            b.text = b.text.replace(MARK, "").strip() or "-"
            b.links = min(b.links, len(b.text))
        if blocks:
            out.append((features([blocks]), y))
    return out


_WINDOWS = ("w long, tags array<array<int>>, words array<array<int>>, shape array<array<float>>, y array<boolean>, some array<string>")


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of pages whose markup names the article, as features. Words of
    a block are its distinct buckets, so a window is bounded whatever the text."""
    for batch in batches:
        out = []
        for page in batch["html"]:
            blocks = page_blocks(page)
            y = marked_blocks(blocks)
            if y is None:
                continue
            f = features([blocks])
            for lo in range(0, len(blocks), WINDOW):
                hi = min(len(blocks), lo + WINDOW)
                words = [np.unique(f.words[f.word_from[i]:f.word_from[i + 1]]).tolist() for i in range(lo, hi)]
                tags = [f.tags[f.tag_from[i]:f.tag_from[i + 1]].tolist() for i in range(lo, hi)]
                key = zlib.crc32(repr((lo, tags, words)).encode()) << 20 | lo // WINDOW & 0xFFFFF
                some = [" ".join(b.text[:400].split()[:40]) for b in blocks[lo:hi] if len(b.text) > 40]
                out.append((key, tags, words, f.shape[lo:hi].tolist(), y[lo:hi].tolist(), some[:4]))
        yield pd.DataFrame(out, columns=["w", "tags", "words", "shape", "y", "some"])


def _lists(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([x for r in rows for x in r], np.int64), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64))


def fit(pages: DataFrame, html_col: str = "html", key_cols: tuple[str, ...] = ("page_id", "url")) -> Labeller:
    """Labeller from a bounded sample: of the PAGES pages whose keys have the
    smallest hashes, the WINDOWS windows with the smallest hashes. Pages are
    read and cut on the executors; the driver gets windows only."""
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    rows = pages.select(key.alias("key"), F.col(html_col).alias("html"))
    ids = rows.select("key").distinct().orderBy("key").limit(PAGES)  # at most PAGES numbers
    got = (rows.join(F.broadcast(ids), "key", "left_semi").select("html").mapInPandas(_windows, _WINDOWS)
               .dropDuplicates(["w"]).orderBy("w").limit(WINDOWS).collect())
    samples, pool = [], []
    for r in got:
        tags, tag_from = _lists(r["tags"])
        words, word_from = _lists(r["words"])
        samples.append((Features(tags, tag_from, words, word_from, np.array(r["shape"], np.float32), np.array([len(r["y"])])),
                        np.array(r["y"])))
        pool += [s.split() for s in r["some"] if s.split()]
    pool = pool[:POOL] or [["the", "page", "of", "a", "site"]]
    return train(samples + invented(pool))


# --- extraction -----------------------------------------------------------------------------------------

def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    """Main text of every page."""
    out: list[str] = []
    held: list[list[Block]] = []
    cells = 0

    def label() -> None:
        nonlocal cells
        p = net.scores(features(held)) >= 0.5
        at = 0
        for blocks in held:
            out.append("\n\n".join(b.text for b, take in zip(blocks, p[at:at + len(blocks)]) if take))
            at += len(blocks)
        held.clear()
        cells = 0

    for page in pages:
        held.append(page_blocks(page))
        cells += len(held[-1]) + sum(len(b.text) for b in held[-1]) // 100
        if cells >= CELLS:
            label()
    label()
    return out


def extract_text(pages: DataFrame, net: Labeller, html_col: str = "html") -> DataFrame:
    """``pages`` plus ``text`` (its main text, empty if none) and ``n_chars``
    (its code points). Columns of these names are replaced."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series(main_texts(pages.tolist(), net), dtype="object")

    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    return (pages.select(*keep, text_of(F.col(html_col)).alias("text"))
                 .select(*keep, "text", F.length("text").cast("long").alias("n_chars")))
