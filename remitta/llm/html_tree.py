"""Main text of web pages by a graphical model over the DOM tree.

Every element has a hidden label, content or not. Its own potential comes from its tag, the words of its class, id
and role, how much text and how many links it holds, its depth and place; parent-child potentials tie it to its
parent, a table for each kind of child. Messages go from the leaves to the root and back (sum-product), which gives
exact marginals on a tree; text whose nearest element has a marginal over one half is content.

Trained on labelled pages by gradient ascent of the likelihood: pages generated from varied templates, where each
part is known to be article, menu, header, footer, sidebar, notice, advert, form or reader comments; and a sample of
at most `sample_pages` of the given pages (of at most `sample_chars` characters) that mark their article with the article or main element, labelled by the
elements' meaning (nav, aside, footer and so on are not content).

Defined cases: null and empty pages, and pages without content, give an empty text. Scripts, what stands in their place
where they don't run, styles, templates, the head and comments of the markup never count as text. Unclosed and misnested tags are closed where the next block or
an ancestor's end implies it. Inside a block all white space becomes one space; blocks are joined by a newline.
Repeated rows give equal texts, of rows that repeat an id one is learned from, an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm.common import hashed_sample, one_text

SAMPLE_PAGES = 150
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?|[^<]+|<""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script noscript style template head title iframe noembed noframes".split())
_MATH = "math maction maligngroup malignmark menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml"
INLINE = frozenset(f"a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr {_MATH}".split())
#: An open p ends where one of these begins.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An open element of the key ends where one of these begins, unless one of the last ones is between.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}


class Page:
    """Elements in page order (0 is the root), and the pieces: an element's number and a text, or None for a block border."""

    def __init__(self, source: str):
        self.tags, self.attrs, self.parent, self.depth, self.hidden = ["#root"], [""], [-1], [0], [False]
        self.pieces: list[tuple[int, str | None]] = []
        stack, raw = [0], None
        tags, place, blocks = self.tags, defaultdict(list), [0]  # where in the stack the elements of a tag, and those that aren't inline, are

        def cut(k: int) -> None:
            for i in stack[k:]:
                place[tags[i]].pop()
            del stack[k:]
            while blocks[-1] >= k:
                blocks.pop()

        at, n = 0, len(source)
        while at < n:
            if raw:
                end = re.compile(rf"</{raw}\b[^>]*>?", re.I).search(source, at)
                if raw == "textarea":
                    self._text(stack[-1], source[at : end.start() if end else n])
                at = end.end() if end else n
                if raw == tags[stack[-1]]:
                    cut(len(stack) - 1)
                raw = None
                continue
            m = _TOKEN.match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                if (text := m[0])[0] != "<" or text == "<":
                    self._text(stack[-1], text)
                continue
            name = name.lower()
            if m[1]:
                if place[name]:
                    k = place[name][-1]
                    if any(tags[i] not in INLINE for i in stack[k:]):
                        self.pieces.append((stack[k], None))
                    cut(k)
                continue
            if name in _ENDS_P and tags[stack[blocks[-1]]] == "p":
                cut(blocks[-1])
            if name in _SIBLINGS:
                ended, within = _SIBLINGS[name]
                last = max((place[t][-1] for t in within if place[t]), default=0)
                k = min((place[t][i] for t in ended if (i := bisect_right(place[t], last)) < len(place[t])), default=None)
                if k:
                    cut(k)
            up = stack[-1]
            number = len(tags)
            tags.append(name)
            self.attrs.append(m[3])
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1)
            self.hidden.append(self.hidden[up] or name in HIDDEN)
            if name == "br":
                self._text(up, " ")
            elif name not in INLINE:
                self.pieces.append((number, None))
            if name not in VOID and not m[0].endswith("/>"):
                place[name].append(len(stack))
                if name not in INLINE:
                    blocks.append(len(stack))
                stack.append(number)
                if name in RAW:
                    raw = name

    def _text(self, at: int, text: str) -> None:
        if not self.hidden[at]:
            self.pieces.append((at, html.unescape(text) if "&" in text else text))

    def text(self, content: list[bool]) -> str:
        blocks, now = [], []
        for at, piece in self.pieces:
            if piece is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif content[at]:
                now.append(piece)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return "\n".join(b for b in blocks if b)


def _bucket(n: int) -> int:
    return min(9, n.bit_length())


def _kind(tag: str) -> str:
    return "inline" if tag in INLINE else tag if tag in ("p", "li", "div", "section") else "block"


class TreeModel:
    """Weights of features for the label content, and for each kind of child a table of (parent, child) potentials."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.pair: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
        self.static: dict[tuple[str, str], tuple[list[str], float]] = {}

    def _of_tag(self, tag: str, attrs: str) -> tuple[list[str], float]:
        key = (tag, attrs)
        got = self.static.get(key)
        if got is None:
            names = [f"t:{tag}"]
            for m in _ATTR.finditer(attrs):
                names += {f"c:{w.lower()}" for w in _WORD.findall(m[2] or m[3] or m[4] or "")}
            if len(self.static) > 20_000:
                self.static.clear()
            got = self.static[key] = (names, sum(self.w.get(x, 0.0) for x in names))
        return got

    def features(self, page: Page) -> tuple[list[list[str]], list[float]]:
        """Names of what depends on the text, and the potential of all features, for each element."""
        n = len(page.tags)
        own, linked, total, links = [0] * n, [0] * n, [0] * n, [0] * n
        stops = [0] * n
        for at, piece in page.pieces:
            if piece is not None:
                k = len(piece.strip())
                own[at] += k
                stops[at] += piece.count(". ") + piece.endswith(".")
                if page.tags[at] == "a":
                    linked[at] += k
        for i in range(n - 1, -1, -1):
            total[i] += own[i]
            links[i] += linked[i] if page.tags[i] != "a" else total[i]
            if (p := page.parent[i]) >= 0:
                total[p] += total[i]
                links[p] += links[i]
                if page.tags[i] in INLINE:
                    own[p] += own[i]
                    stops[p] += stops[i]
        names, score, get = [], [], self.w.get
        for i in range(n):
            density = min(4, 5 * links[i] // total[i]) if total[i] else 5
            tag, b = page.tags[i], _bucket(own[i])
            f = [f"own:{b}", f"sub:{_bucket(total[i])}", f"ld:{density}", f"t:{tag}|ld:{density}", f"t:{tag}|own:{b}", f"stop:{min(3, stops[i])}", f"dep:{min(6, page.depth[i])}", f"pos:{5 * i // n}"]
            names.append(f)
            score.append(self._of_tag(tag, page.attrs[i])[1] + sum(get(x, 0.0) for x in f))
        return names, score

    def marginals(self, page: Page, score: list[float]) -> tuple[list[float], list[list[float]]]:
        """P(content) of each element, and the joint of (parent, child) labels: 00, 01, 10, 11."""
        n = len(score)
        exp, log = math.exp, math.log
        table = {}
        up, message, own = list(score), [0.0] * n, [None] * n
        for i in range(n):
            k = _kind(page.tags[i])
            t = table.get(k)
            if t is None:
                t = table[k] = [exp(x) for x in self.pair[k]]
            own[i] = t
        for i in range(n - 1, 0, -1):
            t, e = own[i], exp(max(-30.0, min(30.0, up[i])))
            message[i] = m = log((t[2] + t[3] * e) / (t[0] + t[1] * e))
            up[page.parent[i]] += m
        full = list(up)  # with what comes from above
        joint = [[0.0] * 4 for _ in range(n)]
        for i in range(1, n):
            t = own[i]
            above = max(-30.0, min(30.0, full[page.parent[i]] - message[i]))
            a, e = exp(above), exp(max(-30.0, min(30.0, up[i])))
            j = [t[0], t[1] * e, t[2] * a, t[3] * a * e]
            s = sum(j)
            joint[i] = [x / s for x in j]
            full[i] = max(-30.0, min(30.0, log((j[1] + j[3]) / (j[0] + j[2]))))
        return [1 / (1 + exp(-max(-30.0, min(30.0, x)))) for x in full], joint

    def extract(self, source: str) -> tuple[str, float]:
        """The main text, and the mean marginal of its characters."""
        if not source:
            return "", 0.0
        page = Page(source)
        p, _ = self.marginals(page, self.features(page)[1])
        text = page.text([x > 0.5 for x in p])
        sizes = [(len(t), p[i]) for i, t in page.pieces if t is not None and p[i] > 0.5]
        return text, sum(a * b for a, b in sizes) / max(1, sum(a for a, _ in sizes))


def fit(labelled: list[tuple[Page, list[bool]]], epochs: int = 30, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> TreeModel:
    """Stochastic gradient ascent, one page at a time, with steps that shrink by feature."""
    model, rng = TreeModel(), random.Random(seed)
    grown: dict[str, float] = defaultdict(lambda: 1e-2)
    order = list(labelled)
    for epoch in range(epochs):
        rng.shuffle(order)
        for page, truth in order:
            model.static.clear()
            names, score = model.features(page)
            p, joint = model.marginals(page, score)
            g: dict[str, float] = defaultdict(float)
            gp: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
            for i in range(len(p)):
                if abs(d := truth[i] - p[i]) > 1e-3:
                    for f in names[i]:
                        g[f] += d
                    for f in model._of_tag(page.tags[i], page.attrs[i])[0]:
                        g[f] += d
                if i:
                    t = gp[_kind(page.tags[i])]
                    t[2 * truth[page.parent[i]] + truth[i]] += 1
                    for k in range(4):
                        t[k] -= joint[i][k]
            size = len(p) ** 0.5
            for f, d in g.items():
                d /= size
                grown[f] += d * d
                model.w[f] = model.w.get(f, 0.0) * (1 - decay) + rate * d / grown[f] ** 0.5
            for k, t in gp.items():
                for j in range(4):
                    d = t[j] / size
                    name = f"pair:{k}:{j}"
                    grown[name] += d * d
                    model.pair[k][j] = max(-5.0, min(5.0, model.pair[k][j] + rate * d / grown[name] ** 0.5))
    model.static.clear()
    model.pair = {k: list(v) for k, v in model.pair.items()}
    for k in ("inline", "p", "li", "div", "section", "block"):
        model.pair.setdefault(k, [0.0] * 4)
    return model


#: Names that pages commonly give to their parts.
NAMES = {
    "content": "content main article post entry story body text page-content post-body entry-content article-body main-content story-body blog-post".split(),
    "nav": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination pager tabs".split(),
    "header": "header site-header masthead banner topbar top-bar logo branding page-header".split(),
    "footer": "footer site-footer bottom colophon copyright legal page-footer".split(),
    "aside": "sidebar aside side-bar widget related recommended popular right-col left-col rail more-stories tags".split(),
    "notice": "notice cookie cookie-banner alert gdpr consent popup modal newsletter subscribe notification paywall".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion ad-slot adsense banner-ad".split(),
    "form": "form search search-form login signup contact-form comment-form".split(),
    "comments": "comments comment-list responses discussion reader-comments replies comment-thread disqus".split(),
}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside", "p"], "ad": ["div", "aside", "section", "ins"], "form": ["form"], "comments": ["section", "div", "ol"]}


def generated(n: int, seed: int = 3) -> list[tuple[str, str]]:
    """Labelled pages: the html with `data-y="1"` on content elements, and the main text."""
    rng = random.Random(seed)
    letters = "etaoinshrdlu"

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    stop = "."

    def sentences(a: int, b: int) -> str:
        return " ".join(words(4, 18).capitalize() + stop for _ in range(rng.randint(a, b)))

    def name(kind: str) -> str:
        if rng.random() < 0.15:
            return ""
        x = rng.choice(NAMES[kind])
        x = rng.choice([x, x, x, f"{x}-wrapper", f"site-{x}", f"{x} clearfix", f"{x}{rng.randint(1, 9)}", f"{x}_inner"])
        return f' {rng.choice(["class", "class", "id"])}="{x}"'

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def part(kind: str) -> str:
        tag = rng.choice(_TAGS[kind])
        at = name(kind)
        if not at and tag in ("div", "p", "section", "ul", "ol"):
            at = f' class="{rng.choice(NAMES[kind])}"'
        if kind == "nav":
            inner = f"<ul>{links(rng.randint(3, 9))}</ul>" if tag != "ul" else links(rng.randint(3, 9))
        elif kind == "header":
            inner = rng.choice([f"<a href='/'>{words(1, 3)}</a>", f"<h1>{words(1, 4)}</h1><p>{words(3, 8)}</p>", f"<div>{words(1, 3)}</div><ul>{links(4)}</ul>"])
        elif kind == "footer":
            inner = rng.choice([f"&copy; 2024 {words(2, 4)} &middot; {sentences(1, 1)}", f"<p>&copy; {words(2, 6)}</p><ul>{links(4)}</ul>", f"<p>{sentences(1, 3)}</p>"])
        elif kind == "aside":
            inner = rng.choice([f"<h3>{words(1, 3)}</h3><ul>{links(rng.randint(3, 7))}</ul>", f"<h4>{words(1, 3)}</h4><p>{sentences(1, 3)}</p>", f"<p>{sentences(1, 2)} <a href='/x'>{words(1, 2)}</a></p>"])
        elif kind == "notice":
            inner = rng.choice([sentences(1, 2), f"{sentences(1, 2)}<button>{words(1, 1)}</button>"]) if tag == "p" else rng.choice([f"<p>{sentences(1, 3)}</p>", f"{sentences(1, 2)}<button>{words(1, 1)}</button>"])
        elif kind == "ad":
            inner = rng.choice([sentences(1, 1), f"<a href='/b'>{words(3, 8)}</a>", f"<p>{sentences(1, 2)}</p>", f"<span>{words(2, 6)}</span>"])
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name='q'><select><option>{words(1, 2)}</option></select><button>{words(1, 2)}</button>" + rng.choice(["", f"<p>{sentences(1, 1)}</p>", f"<textarea>{words(2, 5)}</textarea>"])
        else:
            item = "li" if tag == "ol" else "div"
            inner = "".join(f"<{item} class='comment'><b>{words(1, 2)}</b><p>{sentences(1, 5)}</p></{item}>" for _ in range(rng.randint(1, 5)))
            inner = rng.choice(["", f"<h3>{words(1, 2)}</h3>"]) * (tag != "ol") + inner
        return f"<{tag}{at}>{inner}</{tag}>"

    out = []
    for _ in range(n):
        text: list[str] = []
        stop = rng.choice([".", ".", ".", ""])  # some pages have no sentences

        def block(tag: str, inner: str, mark: str = ' data-y="1"') -> str:
            text.append(inner)
            return f"<{tag}{mark}>{inner}</{tag}>"

        def data_table() -> str:
            wide, y = rng.randint(2, 5), ' data-y="1"'
            cell = lambda tag: block(tag, rng.choice([words(1, 3), str(rng.randint(1, 9999)), f"{rng.random():.2f}"]))
            head = f"<tr{y}>" + "".join(cell("th") for _ in range(wide)) + "</tr>"
            rows = "".join(f"<tr{y}>" + "".join(cell("td") for _ in range(wide)) + "</tr>" for _ in range(rng.randint(1, 6)))
            return rng.choice([f"<table{y}>{head}{rows}</table>", f"<table{y}><thead{y}>{head}</thead><tbody{y}>{rows}</tbody></table>"])

        body = [block(rng.choice(["h1", "h1", "h2"]), words(3, 9).capitalize())] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 12)):
            r = rng.random()
            if r < 0.68:
                body.append(block("p", sentences(1, 6)))
            elif r < 0.74:
                body.append(block(rng.choice(["h2", "h3"]), words(2, 6)))
            elif r < 0.80:
                items = "".join(block("li", words(3, 12)) for _ in range(rng.randint(2, 5)))
                body.append(f'<ul data-y="1">{items}</ul>')
            elif r < 0.84:
                body.append(block("blockquote", sentences(1, 3)))
            elif r < 0.88:
                a, b = sentences(1, 1), sentences(1, 1)
                text.append(f"{a} {b}")
                body.append(f'<p data-y="1"><b data-y="1">{a}</b> {b}')
            elif r < 0.91:
                a, b, c = words(2, 5), words(1, 3), sentences(1, 2)
                text.append(f"{a} {b} {c}")
                body.append(f'<p data-y="1">{a} <a data-y="1" href="/l">{b}</a> {c}</p>')
            elif r < 0.93:
                body.append(block("pre", words(4, 20)))
            elif r < 0.95:
                body.append(data_table())
            else:
                body.append(part(rng.choice(["ad", "aside", "notice", "form"])))
        wrap = rng.choice(["article", "article", "div", "div", "main", "section", "td"])
        at = name("content") if wrap not in ("article", "main") or rng.random() < 0.5 else ""
        if not at and wrap in ("div", "section", "td"):
            at = f' class="{rng.choice(NAMES["content"])}"'
        core = f'<{wrap}{at} data-y="1">{"".join(body)}</{wrap}>'
        if wrap == "td":
            core = f'<table data-y="1"><tr data-y="1"><td>{part("aside")}</td>{core}</tr></table>'
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.5:
                core = f'<{(t := rng.choice(["div", "main", "section"]))}{rng.choice(["", name("content")])} data-y="1">{core}{rng.choice(["", part("aside"), part("comments")])}</{t}>'
        before = [part(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.55]
        after = [part(k) for k in ("comments", "aside", "form", "ad", "nav", "footer", "notice") if rng.random() < 0.45]
        rng.shuffle(before)
        scripts = rng.choice(["", "<script>var a = '<p>x</p>';</script>", "<style>p{}</style>"])
        out.append((f'<!DOCTYPE html><html data-y="1"><head><title>{words(2, 6)}</title>{scripts}</head><body data-y="1">{"".join(before)}{scripts}{core}{"".join(after)}</body></html>', "\n".join(text)))
    return out


def labelled(source: str) -> tuple[Page, list[bool]]:
    page = Page(source)
    return page, [i == 0 or "data-y" in a for i, a in enumerate(page.attrs)]


_NOT_CONTENT = frozenset("nav aside footer header form script style head button select".split())
_NOT_WORDS = frozenset(w for k in ("nav", "aside", "notice", "ad", "form", "comments") for x in NAMES[k] for w in [x] if "-" not in x)


def by_meaning(source: str) -> tuple[Page, list[bool]] | None:
    """Labels from the elements' meaning, for pages that mark their article."""
    page = Page(source)
    mark = next((t for t in ("article", "main") if t in page.tags), None)
    if mark is None:
        return None
    n = len(page.tags)
    inside, out = [False] * n, [False] * n
    for i in range(1, n):
        names = {w.lower() for m in _ATTR.finditer(page.attrs[i]) for w in (m[2] or m[3] or m[4] or "").split()}
        out[i] = out[page.parent[i]] or page.tags[i] in _NOT_CONTENT or bool(names & _NOT_WORDS)
        inside[i] = inside[page.parent[i]] or page.tags[i] == mark
    truth = [a and not b for a, b in zip(inside, out)]
    for i in range(n - 1, 0, -1):
        if truth[i]:
            truth[page.parent[i]] = True
    truth[0] = True
    return page, truth


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = 100_000, made: int = 250) -> TreeModel:
    got = pages.filter(F.col(html_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).filter(F.length("h") <= sample_chars)
    ids = F.broadcast(hashed_sample(got.select("i").filter("i is not null"), "i", sample_pages).distinct())
    sources = sorted(r.h for r in one_text(got.join(ids, "i"), ["i"], "h").collect())
    known = [x for x in map(by_meaning, sources) if x]
    return fit([labelled(h) for h, _ in generated(made)] + known)


def main_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars, confidence (mean marginal of the text's characters); one row per row of pages."""
    shared = spark.sparkContext.broadcast(_plain(model or train(pages, id_col, html_col)))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches):
        model = _model(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [model.extract(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([c for _, c in found], pa.float64())],
                    ["page_id", "url", "text", "n_chars", "confidence"],
                )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, confidence double")


def _plain(model: TreeModel) -> tuple[dict, dict]:
    return dict(model.w), dict(model.pair)


def _model(plain: tuple[dict, dict]) -> TreeModel:
    model = TreeModel()
    model.w, model.pair = plain
    return model
