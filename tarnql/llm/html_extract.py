"""Main text of web pages: a bidirectional LSTM labels every block in the context of its whole page."""

from __future__ import annotations

import io
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick
from .hashing import word_hashes
from .html_blocks import Block, Path, blocks

PATH, LEAF, WORDS, PLAIN = 128, 24, 64, 8
SIZE = PATH + LEAF + WORDS + PLAIN
HIDDEN = 24
#: In training pages, marks the blocks that are main text.
_MARK = ""


@lru_cache(maxsize=50_000)
def _token(token: str) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % PATH, 1.0 if h >> 16 & 1 else -1.0


def _path(path: Path) -> np.ndarray:
    """The hashed tokens of a path, added up once for every element."""
    open_ = []
    while path is not None and path.total is None:
        open_.append(path)
        path = path.parent
    total = path.total if path is not None else np.zeros(PATH, np.float32)
    for link in reversed(open_):
        if link.own:
            total = total.copy()
        for token in link.own:
            i, sign = _token(token)
            total[i] += sign
        link.total = total
    return np.clip(total, -2, 2)


def features(page: list[Block]) -> np.ndarray:
    """A row per block: its hashed path, its innermost element, its hashed words, and a few plain numbers."""
    out = np.zeros((len(page), SIZE), np.float32)
    if not page:
        return out
    for i, b in enumerate(page):
        out[i, :PATH] = _path(b.path)
        out[i, PATH + zlib.crc32(b.leaf.encode()) % LEAF] = 1
    n = np.zeros(len(page))
    for first, offsets, words in word_hashes(pa.array([b.text for b in page], pa.string()), lower=True):
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        bag = np.bincount(row * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=len(size) * WORDS).reshape(len(size), WORDS)
        out[first : first + len(size), PATH + LEAF : PATH + LEAF + WORDS] = bag / np.sqrt(np.maximum(size, 1))[:, None] * (size < 60)[:, None]
        n[first : first + len(size)] = size
    at = PATH + LEAF + WORDS
    length = np.array([len(b.text) for b in page])
    out[:, at] = np.log1p(n) / 4
    out[:, at + 1] = [min(b.linked / max(len(b.text), 1), 1.0) for b in page]
    out[:, at + 2] = [sum(map(b.text.count, ".,;:!?")) / max(len(b.text), 1) * 10 for b in page]
    out[:, at + 3] = length / np.maximum(n, 1) / 10
    out[:, at + 4] = ["\xa9" in b.text or "(c)" in b.text for b in page]
    out[:, at + 5] = [b.text[-1] in ".!?" for b in page]
    out[:, at + 6] = [b.path.size / 10 for b in page]
    out[:, at + 7] = np.arange(len(page)) / max(len(page), 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """One LSTM each way over the blocks, and a logistic output that also sees the block itself."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {}
        for way in "fb":
            self.p[f"w{way}"] = (rng.normal(size=(SIZE, 4 * HIDDEN)) / np.sqrt(SIZE)).astype(np.float32)
            self.p[f"u{way}"] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.p[f"b{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["o"] = (rng.normal(size=2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.p["x"] = np.zeros(SIZE, np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    @staticmethod
    def _turn(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence back to front, padding still behind."""
        t = np.arange(x.shape[1])
        at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
        return np.take_along_axis(x, at.reshape(*at.shape, *[1] * (x.ndim - 2)), axis=1)

    def _run(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        ahead, out, kept = x @ self.p[f"w{way}"] + self.p[f"b{way}"], np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps):
            a = ahead[:, t] + h @ self.p[f"u{way}"]
            i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            kept.append((i, f, o, g, before, last, tc))
        return out, kept

    def forward(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits (pages, blocks)."""
        back = self._turn(x, lengths)
        hf, kf = self._run(x, "f")
        hb, kb = self._run(back, "b")
        both = np.concatenate([hf, self._turn(hb, lengths)], axis=2)
        return both @ self.p["o"] + x @ self.p["x"] + self.p["c"][0], (back, kf, kb, both)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (back, kf, kb, both) = self.forward(x, lengths)
        real = np.arange(x.shape[1]) < lengths[:, None]
        d = ((_sigmoid(z) - y) * real / real.sum()).astype(np.float32)
        g = {"o": np.einsum("nt,nth->h", d, both), "x": np.einsum("nt,nth->h", d, x), "c": d.sum(keepdims=True)[0, :1]}
        dh = d[:, :, None] * self.p["o"]
        for way, inputs, kept, up in (("f", x, kf, dh[:, :, :HIDDEN]), ("b", back, kb, self._turn(dh[:, :, HIDDEN:], lengths))):
            gu, ga = np.zeros_like(self.p[f"u{way}"]), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            hn = cn = np.zeros((len(x), HIDDEN), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                i, f, o, gg, before, last, tc = kept[t]
                hn = hn + up[:, t]
                cn = cn + hn * o * (1 - tc * tc)
                ga[:, t] = np.concatenate([cn * gg * i * (1 - i), cn * before * f * (1 - f), hn * tc * o * (1 - o), cn * i * (1 - gg * gg)], axis=1)
                gu += last.T @ ga[:, t]
                hn, cn = ga[:, t] @ self.p[f"u{way}"].T, cn * f
            g |= {f"u{way}": gu, f"w{way}": np.einsum("nti,ntj->ij", inputs, ga, optimize=True), f"b{way}": ga.sum(axis=(0, 1))}
        return g

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        net = cls()
        with np.load(io.BytesIO(data)) as f:
            net.p = {k: f[k] for k in f.files}
        return net


# Names and words with which training pages are made.
MAIN_NAMES = "content post entry article story body main text page blog single detail".split()
NEUTRAL_NAMES = "container wrapper row col inner layout site grid box block section wrap outer".split()
SIDE_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pager pagination topnav".split(),
    "head": "header masthead logo topbar branding banner site-header hero tagline".split(),
    "foot": "footer copyright legal bottom colophon site-footer credits".split(),
    "side": "sidebar aside widget related recommended popular trending archive tags more-stories".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo adsbox commercial".split(),
    "note": "cookie notice consent gdpr popup modal alert newsletter subscribe banner message".split(),
    "form": "form login search signup contact-form register searchform".split(),
    "talk": "comment comments discussion reply respond commentlist thread disqus reactions".split(),
    "share": "share social sharing buttons follow".split(),
}
SIDE_WORDS = {
    "nav": "Home About Contact News Archive Menu Sport Start Kontakt Accueil Inicio Blog Next Previous".split(),
    "head": "Welcome Magazine Daily Portal Journal Willkommen Bienvenue Bienvenido".split(),
    "foot": "Copyright \xa9 rights reserved Privacy Terms Impressum Datenschutz Mentions Aviso Legal 2024".split(),
    "side": "Related Popular Trending Tags Categories Recent Read more Mehr Plus".split(),
    "ad": "Sponsored Advertisement Buy now Sale Offer Anzeige Angebot Publicit\xe9 Oferta Rabatt".split(),
    "note": "We use cookies Accept Consent Subscribe newsletter Wir verwenden Cookies Nous utilisons Usamos".split(),
    "form": "Search Name Email Password Submit Login Sign up Send Suche Recherche Buscar Anmelden".split(),
    "talk": "Comments says Reply posted ago Kommentare Antworten R\xe9pondre Comentarios Responder wrote".split(),
    "share": "Share Tweet Facebook Email Print Like Teilen Partager Compartir".split(),
}
SIDE_TAGS = {"nav": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div"], "ad": ["div", "aside", "p"], "note": ["div", "section", "p"], "form": ["form", "div"], "talk": ["section", "div", "ol"], "share": ["div", "ul", "p"]}


class PageMaker:
    """Pages with known main text, in many layouts, from one seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r, out = self.r, []
        for i in range(n):
            w = "".join(r.choice("aeiou\xe9\xfc") + r.choice("bcdfglmnprstvz") * r.randint(0, 2) for _ in range(r.randint(1, 4)))
            out.append(w.capitalize() if i == 0 or (out and out[-1].endswith(".")) else w)
            if r.random() < 0.1:
                out[-1] += r.choice(".,.,;")
        return " ".join(out)

    def named(self, tag: str, names: list[str] | None, inside: str) -> str:
        r = self.r
        if not names or r.random() < 0.25:
            return f"<{tag}>{inside}</{tag}>"
        name = r.choice(names)
        if r.random() < 0.3:
            name = f"{r.choice(NEUTRAL_NAMES)}-{name}" if r.random() < 0.5 else f"{name} {r.choice(NEUTRAL_NAMES)}"
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{inside}</{tag}>'

    def side(self, kind: str) -> str:
        r = self.r
        tag, names = r.choice(SIDE_TAGS[kind]), SIDE_NAMES[kind]
        plain = tag in ("div", "p", "ul", "section", "ol")

        def bit() -> str:
            own = " ".join(r.choice(SIDE_WORDS[kind]) for _ in range(r.randint(1, 3)))
            return own if r.random() < 0.4 else self.words(r.randint(1, 4)) if r.random() < 0.6 else f"{own} {self.words(r.randint(1, 3))}"

        if kind in ("nav", "share") or (kind == "side" and r.random() < 0.5):
            inside = "".join(f'<li><a href="/{i}">{bit()}</a></li>' for i in range(r.randint(2, 7)))
            inside = inside if tag == "ul" else f"<ul>{inside}</ul>" if r.random() < 0.7 else inside.replace("<li>", "").replace("</li>", " | ")
        elif kind == "talk":
            each = lambda: f"<p>{self.words(r.randint(4, 40))}</p>" if r.random() < 0.7 else self.words(r.randint(4, 30))
            item = "li" if tag == "ol" else "div"
            inside = "".join(self.named(item, ["comment", "reply", "comment-body"], (f"<b>{self.words(1)}</b> {bit()}" if r.random() < 0.5 else "") + each()) for _ in range(r.randint(1, 4)))
            inside = f"<h3>{bit()}</h3>{inside}" if r.random() < 0.6 and tag != "ol" else inside
        elif kind == "form":
            inside = f"<label>{bit()}</label><input name=q><button>{bit()}</button>" + (f"<p>{bit()}</p>" if r.random() < 0.4 else "")
        elif kind == "foot":
            inside = f"&copy; {self.words(r.randint(1, 3))} &middot; {bit()} {self.words(r.randint(0, 12))}"
            inside = inside if r.random() < 0.5 else f"<p>{inside}</p><ul><li><a href=/>{bit()}</a></li></ul>"
        elif kind == "head":
            inside = f"<{r.choice(['h1', 'h2', 'p', 'div'])}>{bit()}</{'div'}>" if r.random() < 0.2 else f"<h1>{bit()}</h1><p>{self.words(r.randint(2, 8))}</p>"
        else:
            body = self.words(r.randint(3, 30)) if r.random() < 0.8 else bit()
            inside = body if tag == "p" or r.random() < 0.6 else f"<p>{body}</p>" if r.random() < 0.6 else f"<h4>{bit()}</h4><p>{body}</p>"
        must = plain and kind in ("talk", "note", "side", "ad")
        out = self.named(tag, names, inside)
        while must and "=" not in out.split(">")[0]:
            out = self.named(tag, names, inside)
        return out

    def main(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.8:
            parts.append(f"<h1>{_MARK}{self.words(r.randint(2, 10))}</h1>")
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            n = r.choice([1, 3, 8, 20, 40, 80, 150])
            kind = r.random()
            if kind < 0.68:
                inner = self.words(n)
                if r.random() < 0.2:
                    inner = f"<b>{inner}"
                parts.append(f"<p>{_MARK}{inner}" + r.choice(["</p>", "</p>", "</p>", "<br>", "</b></p>"]))
            elif kind < 0.76:
                parts.append(f"<h2>{_MARK}{self.words(min(n, 8))}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{_MARK}{self.words(r.randint(1, 15))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{_MARK}{self.words(n)}</p></blockquote>")
            elif kind < 0.94:
                parts.append(f"<pre>{_MARK}{self.words(n)}</pre>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>{_MARK}{self.words(2)}</td><td>{_MARK}{self.words(3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<div>{_MARK}{self.words(n)}</div>")
            if r.random() < 0.06:
                parts.append(self.side(r.choice(["ad", "share", "side", "note", "form"])))
        return "".join(parts) or f"<p>{_MARK}{self.words(5)}</p>"

    def page(self) -> str:
        r = self.r
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        names = None if tag in ("article", "main") and r.random() < 0.7 else MAIN_NAMES
        core = self.named(tag, names, self.main())
        while tag in ("div", "section") and "=" not in core.split(">")[0]:
            core = self.named(tag, names, self.main())
        if tag == "td":
            core = f"<table><tr><td>{self.side('nav')}</td>{core}</tr></table>"
        if r.random() < 0.15:
            core = core[: core.rfind("</")] + self.side("talk") + core[core.rfind("</") :]
        before = [self.side(k) for k in ("note", "head", "nav", "form", "ad", "side") if r.random() < 0.4]
        after = [self.side(k) for k in ("share", "talk", "side", "ad", "form", "foot", "note") if r.random() < 0.4]
        r.shuffle(before)
        body = "".join(before) + core + "".join(after)
        for _ in range(r.randint(0, 2)):
            body = self.named("div", NEUTRAL_NAMES, body)
        return f"<html><head><title>{self.words(3)}</title></head><body>{body}</body></html>"


def train(pages: int = 3000, epochs: int = 6, batch: int = 30, seed: int = 11) -> bytes:
    """A network trained on made pages by Adam; always the same."""
    maker, rng, net = PageMaker(seed), np.random.default_rng(seed), Network()
    made = []
    for _ in range(pages):
        page = blocks(maker.page())
        y = np.array([_MARK in b.text for b in page], np.float32)
        made.append((features([Block(b.text.replace(_MARK, ""), b.path, b.leaf, b.linked) for b in page]), y))
    made.sort(key=lambda m: len(m[1]))
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for epoch in range(epochs):
        for start in rng.permutation(np.arange(0, pages, batch)):
            some = made[start : start + batch]
            lengths = np.array([len(y) for _, y in some])
            x, y = np.zeros((len(some), lengths.max(), SIZE), np.float32), np.zeros((len(some), lengths.max()), np.float32)
            for i, (a, b) in enumerate(some):
                x[i, : len(b)], y[i, : len(b)] = a, b
            step += 1
            rate = 0.01 * (0.5 ** max(0, epoch - epochs // 2))
            for k, g in net.gradients(x, lengths, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net.dump()


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([train()], pa.binary())], ["model"])
        break


def trained(spark: SparkSession) -> bytes:
    """The network, trained in a task, away from the driver."""
    return bytes(spark.range(1).coalesce(1).mapInArrow(_trained, "model binary").first()["model"])


def label(net: Network, pages: list[list[Block]], cells: int = 20_000) -> list[np.ndarray]:
    """For each page, which blocks are main text. Pages of like length run together, ``cells`` blocks at a time at most,
    or one page alone."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        longest = len(pages[order[-1]])
        group = order[-max(1, cells // longest) :]
        del order[-len(group) :]
        lengths = np.array([len(pages[i]) for i in group])
        x = np.zeros((len(group), longest, SIZE), np.float32)
        for k, i in enumerate(group):
            x[k, : lengths[k]] = features(pages[i])
        z, _ = net.forward(x, lengths)
        for k, i in enumerate(group):
            out[i] = z[k, : lengths[k]] > 0
    return out


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                pages = [blocks(t.as_py() or "") for t in part.column(2)]
                texts = [" ".join(b.text for b, y in zip(p, keep, strict=True) if y) for p, keep in zip(pages, label(net, pages), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: bytes) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The whole page is parsed into blocks (see ``html_blocks``) and the network keeps those of the main text, joined by one
    blank in page order. A null or empty page, and one without main text, gives an empty text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    return pick(pages, "page_id", "url", "html").mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")
