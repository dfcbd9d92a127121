"""Secret scans: fixed patterns, and a character convolutional network over every candidate with its context.

Patterns find assignments (a password, secret, token or key and its value), access key ids and long hexadecimal
runs; what they find always stays. A candidate is what a pattern found, and any run of at least LEAST characters of
[A-Za-z0-9+/_=.-] that mixes letters and digits, or lower and upper case inside (words in one case and plain numbers
can't be told from text). The network sees every part of every candidate: 40 characters, 20 further on each time up to
its end, with 24 characters before and after. A candidate's probability is the highest of its parts; runs that reach
the threshold are added, and for the patterns' finds it is counted how many do. What a pattern has found is cut out of
a run first, and what remains of it is a candidate if it is long and mixed enough by itself.

Training: every document teaches, with every part of what it holds. Findings of the patterns and generated secrets
count as secrets; candidates that no pattern finds (but for those parts that the first network, fitted on the generated
examples alone, takes for secrets), words of at least eight letters outside both, and generated harmless look-alikes
(numbers, addresses, paths, version and date strings, names joined by case or underscore) as harmless. Long runs are
generated too, with and without a secret at any place; their parts that hold the secret, or 16 characters of it, count
as secrets, those that hold nothing of it as harmless. A quarter of the generated examples is kept out of the training.

The documents are dealt to shards by a hash of id and text, about SHARD_BYTES of text each. In every shard the first
network goes on learning: STEP parts of documents at a time in the order of the hash, each once, beside REPLAY generated
ones. The shards' changes are averaged by the number of parts, in steps of at most FAN messages. Before a part is learned
from, its output goes into a histogram (SCALE bins a unit), so every part of every document is judged by a network that
has not seen it. The histograms' sums and the generated examples kept out scale the outputs to probabilities and set the
threshold: the highest one at which at least `RECALL` of these secrets are found. (There the documents' secrets, and what
is harmless in them, weigh no more together than the generated ones.) The network depends on the rows alone, up to
rounding, not on how they are partitioned.

Defined cases: null and empty texts have no spans; offsets are in code points, ends exclusive. Repeated rows get equal
results, and each is learned from; rows that repeat both id and text meet in one shard, which reads them as a stream.
With no documents the network learns from the generated examples alone. A text of any length is read whole. Other columns are not read.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm.common import id_text, release, slices

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same as runs of any length without those shorter than 32
LEAST = 12
RUN = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
WORDS = re.compile(r"[^\W\d_]{8,}")
RECALL = 0.98
SHARD_BYTES = 4_000_000
MOST_TASKS = 2000  # shards are learned one after another in a task if they are more
STEP, REPLAY, RATE = 224, 32, 0.001  # parts of documents and generated parts of a gradient step, and its rate
SCALE, BINS = 16, 2048  # of the histograms of outputs, from -BINS / 2 / SCALE
FAN = 32  # messages that are averaged at a time
BEFORE, INSIDE, AFTER, STRIDE = 24, 40, 24, 20
WIDTH = BEFORE + INSIDE + AFTER
_SPECIAL = "+/_=.-:\"' \n@#<>(){}[],;|&?!%$*\\"
CHANNELS = 26 + 1 + len(_SPECIAL) + 1 + 3


_KEYWORDS = ("passw", "secret", "token", "api")  # lower() of what ASSIGN finds holds one
_LETTER, _RUN = 1, 2


def _classes() -> np.ndarray:
    """Of each code point, whether it is in a word of WORDS, and in a RUN."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for m in re.finditer(r"[^\W\d_]+", every):
        out[m.start() : m.end()] |= _LETTER
    for m in re.finditer(r"[A-Za-z0-9+/_=.-]+", every[:128]):
        out[m.start() : m.end()] |= _RUN
    return out


_class_of: list[np.ndarray] = []


class Scan:
    """Codes of a text, and where its runs and words are."""

    def __init__(self, text: str):
        if not _class_of:
            _class_of.append(_classes())
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.classes = np.zeros(len(self.codes) + 2, np.uint8)
        _class_of[0].take(self.codes, out=self.classes[1:-1], mode="clip")

    def of(self, kind: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest stretches of a class, of at least so many characters."""
        on = self.classes & kind
        edges = np.flatnonzero(on[1:] != on[:-1])
        begin, end = edges[::2], edges[1::2]
        enough = np.flatnonzero(end - begin >= least)
        return begin[enough], end[enough]

    def runs(self) -> list[tuple[int, int]]:
        begin, end = self.of(_RUN, LEAST)
        return list(zip(begin.tolist(), end.tolist()))


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """Start, end and kind of what the patterns find, in order. runs: those of the text, if known."""
    found = []
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(map(lower.__contains__, _KEYWORDS)):
            found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for begin, end in [(0, len(text))] if runs is None else runs:
        if end - begin >= 32:
            found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, begin, end)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def mixed(run: str) -> bool:
    if run.islower() and run.isalpha():
        return False
    letters, digits = any(map(str.isalpha, run)), any(map(str.isdigit, run))
    return letters and digits or sum(a.islower() and b.isupper() for a, b in zip(run, run[1:])) >= 2


def candidates(text: str, spans: list[tuple[int, int, str]] = (), runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Runs (those given, if known), or what the spans (by start) leave of them."""
    out, at, reach = [], 0, 0  # the spans before `at` end at `reach`
    for begin, end in (m.span() for m in RUN.finditer(text)) if runs is None else runs:
        while begin < end:
            while at < len(spans) and spans[at][0] <= begin:
                reach = max(reach, spans[at][1])
                at += 1
            begin = max(begin, reach)
            stop = min(end, spans[at][0]) if at < len(spans) else end
            if stop - begin >= LEAST and mixed(text[begin:stop]):
                out.append((begin, stop))
            begin = max(begin, stop)
    return out


def _table() -> np.ndarray:
    out = np.zeros((129, CHANNELS), np.float32)
    for c in range(128):
        s = chr(c)
        if s.isalpha():
            out[c, ord(s.lower()) - 97] = 1
            out[c, -3] = s.isupper()
        elif s.isdigit():
            out[c, 26] = 1
        elif s in _SPECIAL:
            out[c, 27 + _SPECIAL.index(s)] = 1
        else:
            out[c, 27 + len(_SPECIAL)] = 1
        out[c, -2] = s in "0123456789abcdefABCDEF"
    out[128, 27 + len(_SPECIAL)] = 1
    return out


_ONE_HOT = _table()


def parts(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping parts of a candidate that cover it to its end."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(i, i + INSIDE) for i in [*range(start, end - INSIDE, STRIDE), end - INSIDE]]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Code of each character before, inside and after a part; 129 more inside, -1 beyond the text."""
    end = min(end, start + INSIDE)
    first = max(0, start - BEFORE)
    out = np.full(WIDTH, -1, np.int16)
    at = BEFORE - (start - first)
    codes = [min(ord(c), 128) for c in text[first : end + AFTER]]
    out[at : at + len(codes)] = codes
    out[BEFORE : BEFORE + end - start] += 129
    return out


_AT, _SIZES = np.arange(WIDTH), np.arange(INSIDE + 1)[:, None]
_INSIDE = np.where((_AT >= BEFORE) & (_AT < BEFORE + _SIZES), 129, 0).astype(np.int16)
_BEYOND = _AT >= BEFORE + _SIZES + AFTER


def windows_of(text: str, found: list[tuple[int, int]], codes: np.ndarray | None = None) -> np.ndarray:
    """As window() of each of the parts, which are near each other in the text. codes: those of the text, if known."""
    span = np.array(found)
    begin, end = max(0, int(span[:, 0].min()) - BEFORE), int(span[:, 1].max()) + AFTER
    piece = np.frombuffer(text[begin:end].encode("utf-32-le", "surrogatepass"), np.uint32) if codes is None else codes[begin:end]
    padded = np.full(BEFORE + len(piece) + WIDTH, -1, np.int16)
    np.minimum(piece, 128, out=padded[BEFORE : BEFORE + len(piece)], casting="unsafe")
    size = span[:, 1] - span[:, 0]
    out = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[span[:, 0] - begin]
    out += _INSIDE.take(size, 0)
    np.putmask(out, _BEYOND.take(size, 0), -1)
    return out


def _input(windows: np.ndarray) -> np.ndarray:
    x = _ONE_HOT[windows % 129] * (windows >= 0)[..., None]
    x[..., -1] = windows >= 129
    return x


@dataclasses.dataclass
class Network:
    """One convolution over five characters, its maximum and mean over the positions, one layer to a logit."""

    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        x = _input(windows)
        view = np.lib.stride_tricks.sliding_window_view(x, 5, axis=1)
        return view.transpose(0, 1, 3, 2).reshape(len(x), -1, 5 * CHANNELS)

    def _forward(self, cols: np.ndarray) -> tuple:
        a = np.maximum(cols @ self.kernel + self.bias, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(1)], 1)
        return a, top, pooled, pooled @ self.out + self.out_bias

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """As _forward; the inputs are codes, so the convolution is a sum of looked-up rows."""
        of = _INPUTS @ self.kernel.reshape(5, CHANNELS, -1)
        n, out = WIDTH - 4, []
        for i in range(0, len(windows), 256):
            codes = windows[i : i + 256].astype(np.int64) + 1
            a = of[0][codes[:, :n]]
            for k in range(1, 5):
                a += of[k][codes[:, k : k + n]]
            a += self.bias
            np.maximum(a, 0, out=a)
            out.append(np.concatenate([a.max(1), a.mean(1)], 1) @ self.out + self.out_bias)
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, windows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(windows) + self.shift, -40, 40)))

    def highest(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Of each candidate (text, start, end) the probability of its most likely part; windows are made a few at a time."""
        out = np.zeros(len(found))
        which, windows = [], []

        def flush():
            np.maximum.at(out, which, self.probability(np.array(windows, np.int16).reshape(-1, WIDTH)))
            which.clear(), windows.clear()

        for i, (text, start, end) in enumerate(found):
            for s, e in parts(start, end):
                which.append(i)
                windows.append(window(text, s, e))
                if len(windows) == 2048:
                    flush()
        if windows:
            flush()
        return out


_INPUTS = _input(np.arange(-1, 258)).astype(np.float32)
_HUGE = np.float32(1e30)
CACHED = 64  # windows that are worked on at a time
TOGETHER, BUNDLES = 32, 8  # rows of gradients that are added up at once, and how many times that are fetched


class Descent:
    """Adam on a network's weights."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.state: dict[str, list] = {}

    def learn(self, windows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """One step; returns the outputs before it."""
        z, grads = gradients(self.net, windows, y)
        self.step += 1
        for name, grad in grads.items():
            m = self.state.setdefault(name, [0, 0])
            m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * (grad * grad)
            setattr(self.net, name, getattr(self.net, name) - self.rate * (m[0] / (1 - 0.9**self.step)) / (np.sqrt(m[1] / (1 - 0.99**self.step)) + 1e-6))
        return z


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, rows: int, columns: int) -> np.ndarray:
    """Memory that is kept: what is freed after each step goes back to the system, and is slow to get again."""
    if len(_rooms.get(name, ())) < rows * columns:
        _rooms[name] = np.empty(rows * columns * 5 // 4, np.float32)
    return _rooms[name][: rows * columns].reshape(rows, columns)


def gradients(net: Network, windows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict]:
    """Outputs, and the gradients of the mean loss. Windows go by the size of their parts, CACHED at a time, cut where nothing but padding follows.

    A line holds the same place of CACHED windows, so that what is done for all places runs over whole lines.
    """
    size = (windows[:, BEFORE : BEFORE + INSIDE] >= 129).view(np.uint8).sum(1, dtype=np.uint8)
    by_size = size.argsort(kind="stable")
    n, filters, places = len(y), len(net.bias), WIDTH - 4
    full = -(-n // CACHED) * CACHED
    windows, size = windows[by_size], size[by_size]
    if full > n:  # windows of padding fill the last lines, with no gradient
        windows = np.concatenate([windows, np.full((full - n, WIDTH), -1, windows.dtype)])
    goal = np.zeros(full)
    goal[:n] = y[by_size]
    table = _INPUTS @ net.kernel.reshape(5, CHANNELS, filters)
    table[0] += net.bias
    idle, out, bias = np.maximum(net.bias, 0), net.out.astype(np.float32), np.zeros(filters, np.float32)
    z, pooled, g = np.zeros(full), np.zeros((full, 2 * filters), np.float32), np.zeros(full, np.float32)
    cuts = range(0, full, CACHED)
    widths = [min(WIDTH, BEFORE + int(size[min(n, i + CACHED) - 1]) + AFTER + 5) for i in cuts]
    rows = 5 + sum(widths) * CACHED  # five of zeros, and four after the places of each window
    back = _room("back", rows, filters)
    back[:5] = 0
    short = np.empty(rows - 5, np.uint16)
    one = np.ones(max(WIDTH, TOGETHER), np.float32)
    a, more = _room("active", places * CACHED, filters), _room("more", places * CACHED, filters)
    row = 5
    for i, width in zip(cuts, widths):
        some, rest, held = slice(i, i + CACHED), WIDTH - width, width - 4  # rest: positions cut off, where the input is zero
        until = row + width * CACHED
        codes = short[row - 5 : until - 5].reshape(CACHED, width)
        np.add(windows[some, :width], 1, out=codes, casting="unsafe")
        at = codes.T.astype(np.intp, order="C").ravel()
        act, term = a[: held * CACHED], more[: held * CACHED]
        table[0].take(at[: held * CACHED], 0, out=act, mode="clip")
        for k in range(1, 5):
            table[k].take(at[k * CACHED : (k + held) * CACHED], 0, out=term, mode="clip")
            act += term
        act = act.reshape(held, CACHED * filters)
        np.maximum(act, 0, out=act)
        top = act.max(0)
        pooled[some, :filters] = top.reshape(CACHED, filters)
        pooled[some, filters:] = ((one[:held] @ act).reshape(CACHED, filters) + rest * idle) / np.float32(places)
        z[some] = pooled[some] @ out + net.out_bias
        g[some] = ((1 / (1 + np.exp(-np.clip(z[some], -30, 30)))) - goal[some]) / n
        if i + CACHED > n:
            g[n:] = 0
        g_pool = g[some, None] * out
        top[top <= 0] = np.inf  # nothing there to learn from
        equal = (act == top).reshape(-1, 8)  # eight at a time, of which few hold any
        hits = np.flatnonzero(equal.view(np.uint64).ravel() != 0)
        one_of = np.flatnonzero(equal[hits])
        highest = hits[one_of >> 3] * 8 + (one_of & 7)
        which = highest % top.size
        ties = np.bincount(which, minlength=top.size)
        # 1 where anything is, else 0: in floats, which is faster than by comparing
        act *= _HUGE
        np.minimum(act, 1, out=act)
        act *= g_pool[:, filters:].ravel() / np.float32(places)
        act.reshape(-1)[highest] += (g_pool[:, :filters].ravel() / np.maximum(ties, 1).astype(np.float32))[which]
        bias += (one[:held] @ act).reshape(CACHED, filters).sum(0) + rest / np.float32(places) * (g[some].sum() * out[filters:]) * (net.bias > 0)
        own = back[row:until].reshape(CACHED, width, filters)
        own[:, :held] = act.reshape(held, CACHED, filters).transpose(1, 0, 2)
        own[:, held:] = 0
        row = until
    # What meets a code at any of the five places lies side by side. Equal codes are added up, TOGETHER at a time; zeros fill the last ones. Padding has no input.
    beside = np.ndarray(rows - 4, f"V{20 * filters}", back, 0, (4 * filters,))
    order = short.argsort(kind="stable")
    counts = np.bincount(short, minlength=len(_INPUTS))
    order, counts[0] = order[counts[0] :], 0
    bundles = -(-counts // TOGETHER)
    ends = np.cumsum(bundles)
    at = np.zeros(ends[-1] * TOGETHER, np.intp)
    at[np.arange(len(order)) + np.repeat((ends - bundles) * TOGETHER - (np.cumsum(counts) - counts), counts)] = order + 1
    at = at.reshape(-1, TOGETHER)
    sums = _room("sums", len(at), 5 * filters)
    for i in range(0, len(at), BUNDLES):
        equal = beside[at[i : i + BUNDLES].T.ravel()].view(np.float32).reshape(TOGETHER, -1)
        sums[i : i + BUNDLES] = (one[:TOGETHER] @ equal).reshape(-1, 5 * filters)
    seen = counts.nonzero()[0]
    by_code = np.add.reduceat(sums, (ends - bundles)[seen], axis=0)
    kernel = (_INPUTS[seen].T @ by_code).reshape(CHANNELS, 5, filters).transpose(1, 0, 2)[::-1]
    outputs = np.empty(n)
    outputs[by_size] = z[:n]
    return outputs, {"kernel": kernel.reshape(5 * CHANNELS, filters), "bias": bias, "out": pooled.T @ g, "out_bias": g.sum()}


def kept_out(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a quarter of n examples, and of those to learn from."""
    order = np.random.default_rng(7).permutation(n)
    return order[: n // 4], order[n // 4 :]


def fit(windows: np.ndarray, y: np.ndarray, filters: int = 24, epochs: int = 10, rate: float = 0.01) -> Network:
    rng = np.random.default_rng(7)
    held, used = kept_out(len(y))
    net = Network((rng.standard_normal((5 * CHANNELS, filters)) * 0.1).astype(np.float32), np.zeros(filters, np.float32), (rng.standard_normal(2 * filters) * 0.1).astype(np.float32), 0.0)
    descent = Descent(net, rate)
    for _ in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), 64):
            descent.learn(windows[used[i : i + 64]], y[used[i : i + 64]])
    scaled(net, net.logits(windows[held]), y[held], np.ones(len(held)))
    return net


def scaled(net: Network, z: np.ndarray, t: np.ndarray, weight: np.ndarray) -> None:
    """Sets scale, shift and threshold by outputs of examples that were not learned from, and what they are."""
    net.scale, net.shift, net.threshold = 1.0, 0.0, 0.5
    if not weight.sum():
        return
    weight = weight / weight.sum()
    spread = max(1.0, float(weight @ z**2) ** 0.5)
    for _ in range(300):  # logistic calibration
        error = weight * (1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30))) - t)
        net.scale -= 0.1 * float(error @ z) / spread
        net.shift -= 0.5 * float(error.sum())
    own = np.flatnonzero((t == 1) & (weight > 0))
    if len(own):
        own = own[np.argsort(z[own], kind="stable")]
        below = np.cumsum(weight[own]) / weight[own].sum()
        least = z[own[np.searchsorted(below, 1 - RECALL + 1e-9, "right")]]
        net.threshold = float(1 / (1 + np.exp(-np.clip(net.scale * least + net.shift, -40, 40))))


def _kinds(rng: np.random.Generator) -> tuple:
    """Makers of secrets and of harmless look-alikes, of a number within bounds, of a word."""
    pick = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    size = lambda a, b: int(rng.integers(a, b))
    word = lambda: pick(low, size(2, 9))
    secret = [
        lambda: pick("0123456789abcdef", size(16, 65)),
        lambda: pick(low + up + dig + "+/", size(24, 65)),
        lambda: pick(low + up + dig + "-_", size(20, 50)),
        lambda: "AKIA" + pick(up + dig, 16),
        lambda: pick(up + dig, size(20, 41)),
        lambda: ("ghp_", "sk_live_", "xoxb-", "glpat-", "key-")[size(0, 5)] + pick(low + up + dig, size(20, 40)),
        lambda: "eyJ" + pick(low + up + dig, 30) + "." + pick(low + up + dig + "-_", 40),
    ]
    harmless = [
        lambda: pick(dig, size(16, 20)) + word(),
        lambda: "-".join(word() for _ in range(size(3, 6))) + "-" + pick(dig, size(1, 5)),
        lambda: "/".join(["", *(word() for _ in range(size(3, 6)))]) + "/" + pick(dig, size(1, 4)),
        lambda: "".join(word().title() for _ in range(size(3, 6))),
        lambda: word() + "".join(word().title() for _ in range(size(3, 5))) + pick(dig, size(0, 3)),
        lambda: "_".join(word() for _ in range(size(3, 6))) + pick(dig, size(1, 3)),
        lambda: f"20{pick(dig, 2)}-{pick(dig, 2)}-{pick(dig, 2)}T{pick(dig, 2)}.{pick(dig, 2)}.{pick(dig, 2)}Z",
        lambda: f"{word()}-{pick(dig, 1)}.{pick(dig, 2)}.{pick(dig, 1)}-{word()}.{word()}",
        lambda: ".".join([word(), word(), "example" + pick(dig, 1), ("com", "org", "net")[size(0, 3)]]) + "/" + word(),
        lambda: f"{word()}{word()}{word()}.{pick(dig, size(1, 4))}",
        lambda: f"{word()}{pick(dig, 1)}.{word()}.{('com', 'org', 'net')[size(0, 3)]}",
        lambda: f"{word().title()}_{pick(dig, 8)}_{pick(dig, 6)}.{word()[:3]}",
        lambda: "-".join([pick(dig, 3), pick(dig, 1), pick(dig, 2), pick(dig, 6), pick(dig, 1)]) + word(),
    ]
    return secret, harmless, size, word


def generated(n: int) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Texts with a candidate each, and whether it is a secret."""
    secret, harmless, size, word = _kinds(np.random.default_rng(11))
    out, y = [], []
    for i in range(n):
        kind = i % 2
        value = (secret if kind else harmless)[size(0, 99) % (len(secret) if kind else len(harmless))]()
        before = " ".join(word() for _ in range(size(0, 6)))
        tie = ("", " ", " key=", ' "', ": ", "=", " id ")[size(0, 7)] if kind else ("", " ", " see ", ' "', ": ", " at ", " id ")[size(0, 7)]
        text = f"{before}{tie}{value} {word()}"
        out.append((text, len(before) + len(tie), len(before) + len(tie) + len(value)))
        y.append(kind)
    return out, y


def generated_runs(n: int, seed: int = 13) -> list[tuple[str, int, int, int, int]]:
    """Texts with a long run each: its start and end, and those of the secret in it (both 0: none)."""
    secret, harmless, size, word = _kinds(np.random.default_rng(seed))
    code = [secret[2], secret[4]]  # account numbers and the like, cut short

    def chain(least: int, most: int) -> str:
        out, long = "", size(least, most)
        while len(out) < long:
            kind = size(0, 6)
            out += harmless[size(0, len(harmless))]().strip("/") if kind < 2 else code[size(0, 2)]()[: size(4, 11)] if kind == 2 else word()
            out += "/.-_=/"[size(0, 6)]
        return out

    out = []
    for i in range(n):
        tie = "".join(("https://", " ", "", '"', "path: ")[size(0, 5)])
        before = " ".join(word() for _ in range(size(0, 4))) + " " + tie
        first = chain(0 if i % 6 == 0 else 20, 120)
        value = secret[size(0, len(secret))]() if i % 2 else word()
        last = "/.-_="[size(0, 5)] + chain(1, 80).rstrip("/.-_=") if size(0, 3) == 0 else ""
        at = len(before) + len(first)
        text = f"{before}{first}{value}{last} {word()}"
        out.append((text, len(before), at + len(value) + len(last), *((at, at + len(value)) if i % 2 else (0, 0))))
    return out


def labelled_parts(runs: list[tuple[str, int, int, int, int]]) -> tuple[list[np.ndarray], list[int]]:
    """Windows of the runs' parts; a part that holds only a little of a secret is neither."""
    windows, y = [], []
    for text, start, end, a, b in runs:
        for s, e in parts(start, end):
            shared = min(e, b) - max(s, a)
            if shared <= 0 or shared >= min(16, b - a):
                windows.append(window(text, s, e))
                y.append(int(shared > 0))
    return windows, y


def lessons(text: str) -> Iterator[tuple[int, int, int]]:
    """Every part to learn from: start, end, and 1 for what the patterns find, 0 for other candidates, -1 for words outside both."""
    return map(tuple, _lessons(text, Scan(text)).tolist())


def _lessons(text: str, scan: Scan) -> np.ndarray:
    runs = scan.runs()
    spans = base_spans(text, runs)
    others = candidates(text, spans, runs)
    found = [(*part, 1) for s, e, _ in spans for part in parts(s, e)] + [(*part, 0) for s, e in others for part in parts(s, e)]
    begin, end = scan.of(_LETTER, 8)
    if found:
        taken = np.array(sorted([*((s, e) for s, e, _ in spans), *others]))
        reach = np.r_[0, np.maximum.accumulate(taken[:, 1])]
        free = reach[np.searchsorted(taken[:, 0], end)] <= begin
        begin, end = begin[free], end[free]
    if len(begin) and (end - begin).max() > INSIDE:
        words = np.array([part for word in zip(begin.tolist(), end.tolist()) for part in parts(*word)])
        begin, end = words[:, 0], words[:, 1]
    words = np.full((len(begin), 3), -1)
    words[:, 0], words[:, 1] = begin, end
    return np.concatenate([np.array(found), words]) if found else words


def taught(text: str, first: Network) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of the parts, some thousands at a time, and whether they count as secrets."""
    scan = Scan(text)
    every = _lessons(text, scan)
    at = 0
    while at < len(every):
        some = every[at : at + 4096]
        far = np.flatnonzero(np.abs(some[:, 0] - some[0, 0]) >= 1 << 20)
        if len(far):
            some = some[: far[0]]
        at += len(some)
        windows, kind = windows_of(text, some[:, :2], scan.codes), some[:, 2]
        # no pattern found them, but they may well be secrets: they teach nothing
        unsure = np.flatnonzero(kind == 0)
        if len(unsure):
            unsure = unsure[first.probability(windows[unsure]) >= first.threshold]
            windows, kind = np.delete(windows, unsure, 0), np.delete(kind, unsure)
        yield windows, kind == 1


class Shard:
    """Learns from the parts that it is given, in their order."""

    def __init__(self, unit: int, first: Network, made: np.ndarray, y: np.ndarray):
        self.unit, self.first, self.made, self.y = unit, first, made, y
        self.descent = Descent(dataclasses.replace(first), RATE)
        self.order = np.random.default_rng(unit).permutation(len(y))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = self.n_waiting = self.at = 0
        self.seen = np.zeros((2, BINS), np.int64)

    def add(self, text: str) -> None:
        for lesson in taught(text, self.first):
            self.waiting.append(lesson)
            self.n_waiting += len(lesson[1])
            if self.n_waiting >= STEP:
                self._learn(self.n_waiting // STEP * STEP)

    def _learn(self, n: int) -> None:
        windows, y = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.n_waiting = [(windows[n:], y[n:])], len(y) - n
        for i in range(0, n, STEP):
            again = self.order.take(range(self.at, self.at + REPLAY), mode="wrap")
            self.at += REPLAY
            own = y[i : min(n, i + STEP)]
            z = self.descent.learn(np.concatenate([windows[i : i + len(own)], self.made[again]]), np.concatenate([own, self.y[again]]).astype(np.float32))
            bins = np.clip(np.floor(z[: len(own)] * SCALE).astype(np.int64) + BINS // 2, 0, BINS - 1)
            np.add.at(self.seen.reshape(-1), own * BINS + bins, 1)
            self.n += len(own)

    def message(self) -> pa.RecordBatch:
        if self.n_waiting:
            self._learn(self.n_waiting)
        return _message(self.unit, _flat(self.descent.net) - _flat(self.first), self.n, self.seen)


_WEIGHTS = ("kernel", "bias", "out", "out_bias")
_MESSAGE = "unit int, change binary, n bigint, seen binary"


def _flat(net: Network) -> np.ndarray:
    return np.concatenate([np.ravel(getattr(net, name)) for name in _WEIGHTS]).astype(np.float64)


def _moved(net: Network, change: np.ndarray) -> Network:
    out = dataclasses.replace(net)
    for name in _WEIGHTS:
        old = np.asarray(getattr(net, name))
        part, change = change[: old.size], change[old.size :]
        setattr(out, name, (old + part.reshape(old.shape)).astype(np.float32) if old.ndim else float(old + part[0]))
    return out


def _message(unit: int, change: np.ndarray, n: int, seen: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"unit": pa.array([unit], pa.int32()), "change": [change.tobytes()], "n": pa.array([n], pa.int64()), "seen": [seen.tobytes()]})


def _averaged(key: tuple, rows: pa.Table) -> pa.Table:
    total, n, seen = 0.0, 0, 0
    for r in rows.sort_by("unit").to_pylist():
        total = total + np.frombuffer(r["change"]) * r["n"]
        n += r["n"]
        seen = seen + np.frombuffer(r["seen"], np.int64)
    return pa.Table.from_batches([_message(key[0].as_py(), total / max(1, n), n, seen)])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Network:
    """Only the shards' changes of the weights and their histograms leave the executors."""
    made, y = (np.array(x) for x in examples())
    made, y = made.astype(np.int16), y.astype(np.float32)
    first = fit(made, y)
    held, used = kept_out(len(y))
    rows = id_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return first
    units = max(1, size // shard_bytes)
    tasks = min(units, MOST_TASKS)
    hashed = rows.select(F.xxhash64("doc_id", "text", F.lit(10)).alias("h"), "text").withColumn("unit", F.pmod(F.shiftright("h", 8), F.lit(units)).cast("int"))
    dealt = hashed.withColumn("task", F.col("unit") % tasks).repartitionById(tasks, "task").sortWithinPartitions("unit", "h", "text").select("unit", "text")
    shared = docs.sparkSession.sparkContext.broadcast((first, made[used], y[used]))

    def run(batches):
        shard = None
        for batch in slices(batches):
            for unit, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard is None or shard.unit != unit:
                    if shard is not None:
                        yield shard.message()
                    shard = Shard(unit, *shared.value)
                shard.add(text.as_py())
        if shard is not None:
            yield shard.message()

    changes = dealt.mapInArrow(run, _MESSAGE)
    while units > 1:
        units = -(-units // FAN)
        changes = changes.withColumn("into", F.col("unit") % units).groupBy("into").applyInArrow(_averaged, _MESSAGE)
    got = changes.first()
    shared.destroy()
    if got is None or not got.n:
        return first
    net = _moved(first, np.frombuffer(got.change))
    seen = np.frombuffer(got.seen, np.int64).reshape(2, BINS)
    z, t = net.logits(made[held]), y[held]
    few = [min(1.0, (t == label).sum() / max(1, seen[label].sum())) for label in (0, 1)]
    lower = (np.arange(BINS) - BINS // 2) / SCALE
    scaled(net, np.concatenate([z, lower, lower]), np.concatenate([t, np.zeros(BINS), np.ones(BINS)]), np.concatenate([np.ones(len(t)), seen[0] * few[0], seen[1] * few[1]]))
    return net


def examples() -> tuple[list[np.ndarray], list[int]]:
    """Windows of all generated examples."""
    made, y = generated(2400)
    runs, runs_y = labelled_parts(generated_runs(1200))
    return [window(*part) for text, s, e in made for part in [(text, *p) for p in parts(s, e)]] + runs, [label for (_, s, e), label in zip(made, y) for _ in parts(s, e)] + runs_y


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network, n_confirmed (finds of the patterns that the network takes for secrets too), max_probability (of the candidates); one row per row of docs."""
    shared = spark.sparkContext.broadcast(model or train(docs, id_col, text_col))
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        net = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                base, extra, found = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    runs = Scan(text).runs()
                    spans = base_spans(text, runs)
                    base.append(spans)
                    for s, e, of_base in [*((s, e, True) for s, e, _ in spans), *((s, e, False) for s, e in candidates(text, spans, runs))]:
                        extra.append((i, s, e, of_base))
                        found.append((text, s, e))
                p = net.highest(found)
                added: list[list] = [[] for _ in base]
                most, confirmed = [None] * len(base), [0] * len(base)
                for (i, s, e, of_base), q in zip(extra, p.tolist()):
                    most[i] = max(most[i] or 0.0, q)
                    if q >= net.threshold:
                        if of_base:
                            confirmed[i] += 1
                        else:
                            added[i].append((s, e, "network"))
                every = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[2]))) for b, a in zip(base, added)]
                count = lambda kind, of: pa.array([sum(k == kind for _, _, k in x) for x in of], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(count(k, base) for k in KINDS[:3]), pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]), pa.array([_joined(x) for x in every], pa.string()), count("network", every), pa.array(confirmed, pa.int64()), pa.array(most, pa.float64())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network", "n_confirmed", "max_probability"],
                )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_network bigint, n_confirmed bigint, max_probability double")
