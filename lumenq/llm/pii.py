"""Operator 10: personal data by fixed patterns and a character-level BiLSTM with CRF transitions.

Base kinds (email, ip, card, phone) come from patterns and are always kept. The model, written and trained in numpy,
tags characters with B and I of each kind and O; it adds spans that touch no base span: the same kinds written
otherwise, and keys (credentials). It is trained on labelled spans which a seeded generator puts into pseudo-prose, on
the driver, once in a process; its weights (some thousand numbers) go along with the task. The workers run the LSTM as a
graph of onnxruntime (in numpy where that isn't installed), the Viterbi search in numpy.

A text is cut into windows of WINDOW characters at steps of half of that, and all of them are decoded. Windows overlap,
and each decides on the characters nearest to its own middle; the tags of the whole text are joined before spans are read
from them, so spans may cross windows. A check of the spans follows: one must hold a digit or an at-sign, an e-mail
address else a written-out at and dot, a key else the name of a credential.

Defined results: a null text is empty and has no spans; repeated rows repeat theirs; overlapping spans of different
base kinds are all kept; an empty table gives no rows; no input columns are carried along by `find`, all by `redact`.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.common import returning, text_of
from lumenq.llm.onnx_graph import model, node

try:
    import onnxruntime
except ImportError:
    onnxruntime = None

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "key")
WINDOW = 96
STEP = WINDOW // 2
PIECE = 1 << 20  #: characters that are worked on together, and of a longer text are numbered at once
LEAST = 6  #: characters of an added span
TRIGGER = re.compile(r"[0-9@]")
#: What a span without a digit or at-sign must hold; a host name has at most 253 characters.
WRITTEN = {
    "email": re.compile(r"\bat\b(?=.{1,255}?\bdot\b)", re.I | re.S),
    "key": re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private|secret)[ _-]?key|credentials?)[\"']?\s*[:=]|\b(?:sk-|ghp_|AKIA)", re.I),
}
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
BAD = -1e4

# ---- patterns ----------------------------------------------------------------------------------------------------

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASCII_DIGIT = re.compile(r"[0-9]")


def luhn(digits: list[int]) -> bool:
    doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; leftmost and without overlap in each kind."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        begin = at
        while domain and begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if domain and begin < at:
            last = domain.end()
            out.append((begin, last, "email"))
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:] if not p.strip("0") else p.lstrip("0")) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c not in " -"] if m.end() - m.start() <= 40 else []
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


# ---- labelled spans ----------------------------------------------------------------------------------------------

VOWELS, CONSONANTS = "aeiouáéíóúäöüèê", "bcdfghjklmnpqrstvwxyzßñç"


class Labelled:
    """Pseudo-prose with spans of each kind, from a seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.pool = [self._new_word() for _ in range(4000)]

    def _word(self) -> str:
        return self.pool[int(self.r.random() * len(self.pool))]

    def _new_word(self) -> str:
        r = self.r
        w = "".join(r.choice(CONSONANTS[: 20 + 4 * (r.random() < 0.3)]) * (r.random() < 0.8) + r.choice(VOWELS[: 5 + 10 * (r.random() < 0.2)]) for _ in range(r.randint(1, 4)))
        return w.capitalize() if r.random() < 0.15 else w

    def _digits(self, n: int) -> str:
        return "".join(self.r.choice(string.digits) for _ in range(n))

    def _plain(self) -> str:
        """What is no personal data though it holds digits or at-signs."""
        r = self.r
        year, n = r.randint(1900, 2030), r.randint(0, 999)
        return r.choice([
            f"{n}", f"{n}.", f"version {r.randint(1, 9)}", f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.", f"{year}", f"{n},{r.randint(100, 999)}", f"{r.randint(0, 99)}.{r.randint(0, 99)}",
            f"{r.randint(1, 12)}:{r.randint(10, 59)}", f"{year}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"${n}", f"#{n}", f"{n}%", f"@{self._word()}", f"{self._word()}{n}", f"({n})", f"{self._digits(6)}",
            f"https://{self._word()}.com/{self._word()}/{n}", f"{n}***", f"{n}&&&", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"@ {n}", f"{r.randint(1, 9)}x{r.randint(1, 9)}", f"{self._word()} @ {self._word()}",
        ])

    def _item(self) -> tuple[str, str]:
        r, d = self.r, self._digits
        kind = r.choice(KINDS)
        low = "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 9)))
        host = "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 8)))
        end = r.choice(["com", "org", "net", "example.com", "de", "co.uk"])
        if kind == "email":
            return kind, r.choice([f"{low}.{d(2)}@{host}{d(1)}.{end}", f"{low}@{host}.{end}", f"{low}{d(2)} (at) {host} dot com", f"{low}.{d(2)} [at] {host}{d(1)} [dot] org", f"{low} @ {host}.{end}"])
        if kind == "ip":
            return kind, ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            return kind, r.choice([f"4{d(15)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"])
        if kind == "phone":
            return kind, r.choice([f"+1 ({d(3)}) 555-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(200, 999)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(6)}"])
        hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
        upper = lambda n: "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(n))
        mixed = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
        if r.random() < 0.4:  # without a digit
            mixed = lambda n: "".join(r.choice(string.ascii_letters if n % 2 else string.ascii_lowercase) for _ in range(n + r.randint(0, 4)))
        return kind, r.choice([f"AKIA{upper(16)}", f"password={hexa(16)}", f'token = "{hexa(32)}"', f"api_key={mixed(20)}", f"sk-{mixed(32)}", f'secret: "{mixed(20)}"', f"ghp_{mixed(36)}", f"pwd: {mixed(12)}", f"password={mixed(14)}", f"pwd: {mixed(15)}", f"token: {mixed(19)}"])

    def window(self) -> tuple[str, np.ndarray]:
        """WINDOW characters (padded with NUL) and their tags."""
        parts, marks, n = [], [], 0
        items = self.r.choice([0, 1, 1, 1, 2, 2])
        while n < 2 * WINDOW:
            x = self.r.random()
            if x < 0.06 * items:
                kind, s = self._item()
                tag = 1 + 2 * KINDS.index(kind)
                marks += [tag] + [tag + 1] * (len(s) - 1)
            else:
                s = self._plain() if x > 0.93 else self._word()
                marks += [0] * len(s)
            gap = self.r.choice([" ", " ", " ", " ", " ", ", ", ". ", ".\n", "; ", "\n"])
            parts += [s, gap]
            marks += [0] * len(gap)
            n += len(s) + len(gap)
        text = "".join(parts)
        a = self.r.randint(0, len(text) - WINDOW)
        size = WINDOW if self.r.random() < 0.85 else self.r.randint(20, WINDOW)
        text, marks = text[a : a + size], marks[a : a + size]
        return text + "\0" * (WINDOW - size), np.array(marks + [0] * (WINDOW - size))


SYMBOLS = string.ascii_letters + string.digits + string.punctuation + " \n\0"
CODE = np.full(256, 0, np.int64)  # 0: any other character
for _i, _c in enumerate(SYMBOLS):
    CODE[ord(_c)] = _i + 2


def codes(text: str) -> np.ndarray:
    """Numbers of characters: printable ASCII its own, other white space a blank, other letters one, the rest another."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(x < 256, CODE[np.minimum(x, 255)], 0)
    out[(x >= 0xC0) & (x < 0x2000)] = 1
    out[(x == 9) | (x == 13) | (x == 0xA0)] = CODE[32]
    return out


# ---- the network -------------------------------------------------------------------------------------------------

VOCABULARY, EMBED, HIDDEN = len(SYMBOLS) + 2, 14, 20


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """What may follow a tag: I of a kind only its B or I. A window may begin inside a span."""
    k = len(TAGS)
    step = np.zeros((k, k))
    for b in range(1, k, 2):
        step[:, b + 1] = BAD
        step[b, b + 1] = step[b + 1, b + 1] = 0.0
    return np.zeros(k), step


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Both directions of the LSTM are one array of shape (2, ...)."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        g = np.random.default_rng(seed)
        k = len(TAGS)
        p = {
            "e": g.normal(0, 0.3, (VOCABULARY, EMBED)),
            "w": g.normal(0, EMBED**-0.5, (2, EMBED, 4 * HIDDEN)),
            "u": g.normal(0, 0.5 * HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)),
            "b": np.zeros((2, 1, 4 * HIDDEN)),
            "o": g.normal(0, 0.3, (2 * HIDDEN, k)),
            "c": np.zeros(k),
            "a": np.zeros((k, k)),
        }
        p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open
        return cls({n: v.astype(np.float32) for n, v in p.items()})

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: (windows, WINDOW) character numbers. Emissions (windows, WINDOW, tags), and what backward() needs."""
        p, (n, t) = self.p, x.shape
        e = p["e"][np.stack((x, x[:, ::-1]))]  # (2, n, t, EMBED)
        pre = np.matmul(e.reshape(2, n * t, EMBED), p["w"]).reshape(2, n, t, -1) + p["b"][:, :, None]
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        hs, kept = np.empty((2, n, t, HIDDEN), np.float32), []
        for s in range(t):
            z = pre[:, :, s] + np.matmul(h, p["u"])
            gates = _sigmoid(z[..., : 3 * HIDDEN])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            g = np.tanh(z[..., 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                kept.append((i, f, o, g, before, tc, h))
            h = o * tc
            hs[:, :, s] = h
        both = np.concatenate((hs[0], hs[1][:, ::-1]), axis=2)
        return both @ p["o"] + p["c"], (x, e, both, kept)

    def backward(self, d: np.ndarray, held) -> dict[str, np.ndarray]:
        """Gradients of all weights but the transitions, from those of the emissions."""
        p, (x, e, both, kept) = self.p, held
        n, t, k = d.shape
        out = {"o": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, k), "c": d.sum((0, 1))}
        db = d @ p["o"].T
        dh_out = np.stack((db[..., :HIDDEN], db[..., HIDDEN:][:, ::-1]))
        dz = np.empty((2, n, t, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        du = np.zeros_like(p["u"])
        ut = p["u"].transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            i, f, o, g, before, tc, h = kept[s]
            dh = dh + dh_out[:, :, s]
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[:, :, s]
            z[..., :HIDDEN] = dc * g * i * (1 - i)
            z[..., HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
            z[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            z[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
            du += np.matmul(h.transpose(0, 2, 1), z)
            dc = dc * f
            dh = np.matmul(z, ut)
        flat = dz.reshape(2, n * t, -1)
        out["u"], out["b"] = du, flat.sum(1, keepdims=True)
        out["w"] = np.matmul(e.reshape(2, n * t, EMBED).transpose(0, 2, 1), flat)
        de = np.matmul(flat, p["w"].transpose(0, 2, 1)).reshape(2, n, t, EMBED)
        out["e"] = np.zeros_like(p["e"])
        np.add.at(out["e"], x, de[0] + de[1][:, ::-1])
        return out

    def crf(self, emit: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss, and gradients of emissions and transitions, by the forward and backward sums."""
        n, t, k = emit.shape
        begin, rules = _rules()
        step = self.p["a"] + rules
        alpha, beta = np.empty((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = emit[:, 0] + begin
        top = lambda v, axis: (m := v.max(axis, keepdims=True), np.log(np.exp(v - m).sum(axis)) + m.squeeze(axis))[1]
        for s in range(1, t):
            alpha[:, s] = top(alpha[:, s - 1][:, :, None] + step, 1) + emit[:, s]
        for s in range(t - 2, -1, -1):
            beta[:, s] = top(step + (emit[:, s + 1] + beta[:, s + 1])[:, None], 2)
        z = top(alpha[:, -1], 1)
        unary = np.exp(alpha + beta - z[:, None, None])
        pair = np.zeros((k, k))
        for s in range(1, t):
            pair += np.exp(alpha[:, s - 1][:, :, None] + step + (emit[:, s] + beta[:, s])[:, None] - z[:, None, None]).sum(0)
        rows = np.arange(n)[:, None]
        score = emit[rows, np.arange(t), tags].sum(1) + step[tags[:, :-1], tags[:, 1:]].sum(1)
        np.add.at(unary, (rows, np.arange(t), tags), -1.0)
        np.add.at(pair, (tags[:, :-1], tags[:, 1:]), -1.0)
        return float((z - score).mean()), (unary / n).astype(np.float32), (pair / n).astype(np.float32)

    def emissions(self, blocks: np.ndarray, apart: int = 1) -> np.ndarray:
        """forward() without what training needs, as (WINDOW, tags, windows). Window j is blocks apart * j and the one behind it."""
        p, (m, t) = self.p, blocks.shape
        n, span = (m - 2) // apart + 1, apart * ((m - 2) // apart) + 1
        session = network({k: v.astype(np.float32) for k, v in p.items()})
        if session is None:
            return self.forward(np.concatenate((blocks[:span:apart], blocks[1 : 1 + span : apart]), axis=1))[0].transpose(1, 2, 0)
        letters = np.take(np.ascontiguousarray(p["e"].T), blocks.T, axis=1).transpose(1, 0, 2)  # (t, EMBED, m)
        x = np.ones((2 * t, 2, EMBED + 1, n), np.float32)
        x[:t, 0, :-1], x[t:, 0, :-1] = letters[:, :, :span:apart], letters[:, :, 1 : 1 + span : apart]
        x[:, 1, :-1] = x[::-1, 0, :-1]
        both = session.run(None, {"x": x, "start": np.zeros((1, 2, HIDDEN, n), np.float32)})[0]
        emit = both[:, 0] + both[::-1, 1]
        emit += p["c"][:, None].astype(np.float32)
        return emit

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window."""
        return self.decode_blocks(x.reshape(-1, STEP), 2)

    def decode_blocks(self, blocks: np.ndarray, apart: int = 1) -> np.ndarray:
        """The best tags of each window (Viterbi); window j is blocks apart * j and the one behind it."""
        best = self.emissions(blocks, apart)  # becomes the score of the best path to each tag
        t, k, n = best.shape
        begin, rules = _rules()
        step = (self.p["a"] + rules).astype(np.float32)
        free = np.array([0, *range(1, k, 2)])  # O and B follow any tag, I its B or I
        any_, b_i, i_i = np.ascontiguousarray(step[:, free, None]), step[range(1, k, 2), range(2, k, 2)][:, None], step[range(2, k, 2), range(2, k, 2)][:, None]
        ways = np.empty((k, len(free), n), np.float32)
        best[0] += begin[:, None].astype(np.float32)
        plain = best[0, 0].copy()  # the score of O alone
        for s in range(1, t):
            last, now = best[s - 1], best[s]
            plain += step[0, 0]
            plain += now[0]
            np.add(last[:, None], any_, out=ways)
            top = ways.max(0)
            now[0] += top[0]
            now[1::2] += top[1:]
            now[2::2] += np.maximum(last[1::2] + b_i, last[2::2] + i_i)
        out = np.zeros((n, t), np.int8)
        rest = np.flatnonzero(best[-1].max(0) > plain)  # for the others O alone is best
        if len(rest) < n // 2:
            best = best[:, :, rest]
        else:
            rest = np.arange(n)
        ways, tags = np.empty((k, len(rest)), np.float32), np.empty((t, len(rest)), np.int8)
        tags[-1] = now = best[-1].argmax(0)
        for s in range(t - 1, 0, -1):
            np.take(step, now, axis=1, out=ways, mode="clip")
            ways += best[s - 1]
            tags[s - 1] = now = ways.argmax(0)
        out[rest] = tags.T
        return out


_NETWORKS: dict[bytes, object] = {}


def network(p: dict[str, np.ndarray]):
    """Both directions of the LSTM as a graph of onnxruntime, kept in the process; None where it isn't installed.

    "x" (WINDOW, 2, EMBED + 1, windows) holds for each step and direction the letters and a one, "start" zeros, "emit"
    (WINDOW, 2, tags, windows) what a direction adds to the emissions after each of its steps.
    """
    if onnxruntime is None:
        return None
    key = hashlib.sha256(b"".join(p[k].tobytes() for k in sorted(p))).digest()
    if key not in _NETWORKS:
        turned = lambda w: np.ascontiguousarray(w.transpose(0, 2, 1))[None]
        constants = {"into": turned(np.concatenate((p["u"], p["w"], p["b"]), axis=1)), "out": turned(p["o"].reshape(2, HIDDEN, -1)), "sizes": np.full(4, HIDDEN)}
        nodes, h, c = [node("Split", ["x"], [f"x{s}" for s in range(WINDOW)], axis=0)], "start", "start"
        for s in range(WINDOW):
            nodes += [
                node("Concat", [h, f"x{s}"], [f"v{s}"], axis=2),
                node("MatMul", ["into", f"v{s}"], [f"z{s}"]),
                node("Split", [f"z{s}", "sizes"], [f"z{gate}{s}" for gate in "ifog"], axis=2),
                *[node("Tanh" if gate == "g" else "Sigmoid", [f"z{gate}{s}"], [f"{gate}{s}"]) for gate in "ifog"],
                node("Mul", [f"f{s}", c], [f"kept{s}"]),
                node("Mul", [f"i{s}", f"g{s}"], [f"new{s}"]),
                node("Add", [f"kept{s}", f"new{s}"], [f"c{s}"]),
                node("Tanh", [f"c{s}"], [f"tc{s}"]),
                node("Mul", [f"o{s}", f"tc{s}"], [f"h{s}"]),
                node("MatMul", ["out", f"h{s}"], [f"emit{s}"]),
            ]
            h, c = f"h{s}", f"c{s}"
        nodes.append(node("Concat", [f"emit{s}" for s in range(WINDOW)], ["emit"], axis=0))
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
        options.enable_mem_pattern = False  # it would be kept for each number of windows
        options.log_severity_level = 3
        graph = model(nodes, constants, {"x": (WINDOW, 2, EMBED + 1, "n"), "start": (1, 2, HIDDEN, "n")}, {"emit": (WINDOW, 2, len(TAGS), "n")})
        _NETWORKS.clear()
        _NETWORKS[key] = onnxruntime.InferenceSession(graph, options, providers=["CPUExecutionProvider"])
    return _NETWORKS[key]


def forget_networks() -> None:
    """At the end of a task: what onnxruntime holds would stay with the worker in tasks that don't need it."""
    _NETWORKS.clear()


def train(seed: int = 7, steps: int = 360, size: int = 40, rate: float = 0.02) -> Tagger:
    """Adam on fresh labelled windows."""
    source, tagger = Labelled(seed), Tagger.fresh(seed)
    m = {n: np.zeros_like(v) for n, v in tagger.p.items()}
    v = {n: np.zeros_like(w) for n, w in tagger.p.items()}
    for t in range(1, steps + 1):
        windows = [source.window() for _ in range(size)]
        x, y = np.array([codes(w) for w, _ in windows]), np.array([z for _, z in windows])
        emit, held = tagger.forward(x, keep=True)
        _, d, pair = tagger.crf(emit.astype(np.float64), y)
        grads = tagger.backward(d, held) | {"a": pair}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink, now = min(1.0, 5.0 / (norm + 1e-9)), rate * min(1.0, 2.0 * (1 - t / (steps + 1)))
        for n, g in grads.items():
            g = g * shrink
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.999 * v[n] + 0.001 * g * g
            tagger.p[n] -= (now * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return tagger


_TRAINED: dict[tuple, Tagger] = {}


def trained(seed: int = 7, steps: int = 360) -> Tagger:
    if (seed, steps) not in _TRAINED:
        _TRAINED[seed, steps] = train(seed, steps)
    return _TRAINED[seed, steps]


# ---- whole texts -------------------------------------------------------------------------------------------------


def window_starts(text: str) -> range:
    """Where windows begin: all of the text is looked at, but for its ends twice."""
    return range(0, len(text), STEP)


def stream_of(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """Character numbers of all texts in blocks of STEP, each text with a block of NUL behind it; the block where each begins."""
    parts, begins, n = [], [], 0
    for text in texts:
        begins.append(n)
        size = (len(window_starts(text)) + 1) * STEP
        for a in range(0, len(text), PIECE):
            parts.append(codes(text[a : a + PIECE]).astype(np.uint8))
        parts.append(np.full(size - len(text), CODE[0], np.uint8))
        n += size // STEP
    return np.concatenate(parts).reshape(-1, STEP), begins


def tags_of(texts: list[str], blocks: np.ndarray, begins: list[int], tagger: Tagger, most: int) -> np.ndarray:
    """The tag of each place in the blocks.

    Each window decides on the half of it around its middle, the first on its beginning as well. The end belongs to the
    last two: what the one before the last leaves untagged, the last decides.
    """
    out, edge = np.zeros((len(blocks) + 1) * STEP, np.int8), STEP // 2
    counts = [len(window_starts(t)) for t in texts]
    first, before_last = {b for b, n in zip(begins, counts) if n}, {b + n - 2 for b, n in zip(begins, counts) if n > 1}
    late = []
    for a in range(0, len(blocks) - 1, most):
        tags = tagger.decode_blocks(blocks[a : a + most + 1])
        out[a * STEP + edge : (a + len(tags)) * STEP + edge] = tags[:, edge : edge + STEP].ravel()
        late += [(k, tags[k - a].copy()) for k in range(a, a + len(tags)) if k in first or k in before_last]
    for k, own in late:
        if k in first:
            out[k * STEP : k * STEP + edge] = own[:edge]
    for k, own in late:
        if k in before_last:
            end = out[k * STEP + edge + STEP : k * STEP + WINDOW]
            end[:] = np.where(own[edge + STEP :], own[edge + STEP :], end)
    for b, n, text in zip(begins, counts, texts):
        out[b * STEP + len(text) : (b + n + 1) * STEP] = 0
    return out[: blocks.size]


def runs_of(tags: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings, ends and kinds of neighbouring places of one kind, from a B on, but for those that can't be spans."""
    kind = (tags + 1) // 2
    bounds = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1), [True])))
    a, b = bounds[:-1], bounds[1:]
    held = np.concatenate(([0], np.cumsum(np.isin(blocks.ravel(), CODE[[ord(c) for c in string.digits + "@"]]))))
    kinds = kind[a] - 1
    keep = (kinds >= 0) & (b - a >= LEAST) & ((held[b] > held[a]) | np.isin(kinds, [KINDS.index(k) for k in WRITTEN]))
    return a[keep], b[keep], kinds[keep]


def spans_of(text: str, runs: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of one kind that hold what they must, ends trimmed of white space, closing marks and words before a name."""
    out = []
    for a, b, kind in runs:
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:!?"):
            b -= 1
        if kind == "key" and (named := WRITTEN["key"].search(text, a, b)):  # words before the credential's name are none of it
            a = next((k + 1 for k in range(named.start() - 1, a - 1, -1) if text[k].isspace()), a)
        while a < b and text[a].isspace():
            a += 1
        if b - a >= LEAST and (TRIGGER.search(text, a, b) or kind in WRITTEN and WRITTEN[kind].search(text, a, b)):
            out.append((a, b, kind))
    return out


def find_all(texts: list[str], tagger: Tagger, most: int = 352) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; all windows are decoded, `most` at a time."""
    out, a = [], 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= PIECE):
            size += len(texts[b])
            b += 1
        out += _find_some(texts[a:b], tagger, most)
        a = b
    return out


def _find_some(texts: list[str], tagger: Tagger, most: int) -> list[tuple[list, list]]:
    blocks, begins = stream_of(texts)
    starts, ends, kinds = runs_of(tags_of(texts, blocks, begins, tagger, most), blocks)
    cuts = np.searchsorted(starts, np.array(begins) * STEP).tolist() + [len(starts)]
    out = []
    for text, at, a, b in zip(texts, begins, cuts, cuts[1:]):
        runs = [(s - at * STEP, e - at * STEP, KINDS[k]) for s, e, k in zip(starts[a:b].tolist(), ends[a:b].tolist(), kinds[a:b].tolist())]
        base = base_spans(text)
        added = [s for s in spans_of(text, runs) if all(s[1] <= x[0] or s[0] >= x[1] for x in base)]
        out.append((base, added))
    return out


def said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def find(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row."""
    tagger = trained()

    def run(batches):
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    part = batch.slice(a, 1000)
                    found = find_all(part.column(1).to_pylist(), tagger)
                    counts = [[sum(s[2] == k for s in base) for base, _ in found] for k in BASE_KINDS]
                    sha = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found]
                    every = [said(base + added) for base, added in found]
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(every, pa.string())], names=[id_column, *names])
        finally:
            forget_networks()

    names = [*[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"]
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), *[T.StructField(n, T.LongType()) for n in names[:4]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return df.select(F.col(id_column), text_of(df, text_column).alias("_text")).mapInArrow(returning(run), schema)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span (of overlapping ones their union) replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_column: str = "text") -> DataFrame:
    """All rows and columns, personal data in the text replaced; a null text stays null."""
    tagger = trained()
    place = df.columns.index(text_column)

    def run(batches):
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    part = batch.slice(a, 1000)
                    texts = part.column(place).to_pylist()
                    found = find_all([t or "" for t in texts], tagger)
                    changed = [None if t is None else masked(t, base + added) if base or added else t for t, (base, added) in zip(texts, found)]
                    columns = [pa.array(changed, pa.string()) if k == place else c for k, c in enumerate(part.columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
        finally:
            forget_networks()

    return df.mapInArrow(returning(run), df.schema)
