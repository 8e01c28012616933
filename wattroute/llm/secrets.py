"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

Base spans come from three patterns. Further candidates are tokens of 8 or more characters that mix letters with digits,
cases or signs (but no parts of data URLs), whatever value follows a word such as "key", "pwd" or "Bearer", and the password of an address. A small network (byte
embedding, one convolution, maximum over all positions and mean over the candidate's, one hidden layer; all in numpy) reads
windows that together cover the whole candidate with BEFORE characters ahead of it and AFTER behind it; a further bit
of each character tells whether it belongs to the candidate. A candidate's score is the largest of its windows'.

It is trained on labelled findings that are drawn from rules (keys, tokens, passwords and digests in the places where they leak,
against identifiers, surnames, article and flight numbers, paths, addresses, dates, numbers and words), a bounded number of them; the logits are calibrated on a
validation set (Platt), and the threshold is the highest that keeps RECALL of its secrets.

One pass, no shuffle; memory bounded by a batch of rows, the windows of one candidate and WINDOWS at once.

Defined cases: null texts count as empty and have no span; a candidate inside a base span is not asked, one that reaches
beyond a base span is; repeated rows give repeated result rows; other columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.llm.common import slices, table, texts

# The base patterns.
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
}
KINDS = ["assign", "access", "hex", "model"]
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
SIGN = re.compile(r"[:=]")
NAME = re.compile(r"""(?:key|pass(?:word|wd|phrase|code)?|pwd|secret|token|auth(?:orization)?|cred(?:ential)?s?|login|jwt|signature|access|license)\w{0,24}["']?\s{0,3}$""", re.I)
VALUE = re.compile(r"""[:=>]?\s{0,3}(?:[Bb]earer\s|[Bb]asic\s)?["'`]?([^\s"'`<>,;(){}\[\]]{8,})""")
BEARER = re.compile(r"""\b(?:[Bb]earer|BEARER|[Bb]asic|BASIC)\s{1,3}["']?([^\s"'`<>,;(){}\[\]]{8,})""")
ADDRESS = re.compile(r"://[^\s:/@]{1,64}:([^\s@/]{4,})@")
INLINE = re.compile(r"data:[\w/+.-]{1,64};base64,[A-Za-z0-9+/=]+")  # a file within a text
NAME_REACH = 48  # characters before a sign in which the naming word is looked for
BEFORE, BODY, AFTER, WINDOWS = 32, 48, 16, 1024
WIDTH = BEFORE + BODY + AFTER
EMBED, SPAN, FILTERS, HIDDEN, EPOCHS, EXAMPLES, RECALL = 8, 5, 32, 16, 10, 9000, 0.96
SCHEMA = "doc_id bigint, kinds array<string>, starts array<int>, ends array<int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in BASE["assign"].finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in BASE["access"].finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in BASE["hex"].finditer(text)]


def mixed(token: str) -> bool:
    """Whether a token mixes letters with digits, cases or signs other than dots and dashes."""
    if token.isalpha() and (token.islower() or token[1:].islower()):
        return False
    core = token.replace(".", "").replace("-", "")
    plain = core.isalpha() and (core.islower() or core.isupper() or core[1:].islower())
    return len(token) >= 8 and not plain and core.lower() != core.upper()


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans to ask the network about: overlapping ones joined, those inside a base span left out; one sweep over sorted spans."""
    found = [(m.start(), m.start() + len(t)) for m in TOKEN.finditer(text) if mixed(t := m[0].rstrip(".-"))]
    for m in SIGN.finditer(text):  # signs are rare: look at what stands before and behind each
        if NAME.search(text, max(0, m.start() - NAME_REACH), m.start()) and (v := VALUE.match(text, m.end())):
            found.append(v.span(1))
    found += [m.span(1) for m in BEARER.finditer(text)]
    if ";base64," in text:  # files, not keys
        files = [m.span() for m in INLINE.finditer(text)]
        begins = [s for s, _ in files]
        found = [(s, e) for s, e in found if not (k := bisect_right(begins, s)) or files[k - 1][1] < e]
    found = sorted(found + ([m.span(1) for m in ADDRESS.finditer(text)] if "://" in text else []))
    joined: list[tuple[int, int]] = []
    for s, e in found:
        if joined and s < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    if not taken:
        return joined
    base = sorted((s, e) for s, _, e in taken)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    return [(s, e) for s, e in joined if not (k := bisect_right(starts, s)) or reach[k - 1] < e]


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Codes (rows of WIDTH) over a candidate and its surroundings: ASCII, others "?", outside the text 0, and 128 more inside the candidate."""
    rows = max(1, -(-(end - start) // BODY))
    a, b = start - BEFORE, start - BEFORE + (rows - 1) * BODY + WIDTH
    codes = np.zeros(b - a, dtype=np.uint8)
    part = text[max(0, a) : b].encode("ascii", "replace")
    codes[max(0, -a) : max(0, -a) + len(part)] = np.frombuffer(part, dtype=np.uint8)
    codes[BEFORE : BEFORE + end - start] |= 128
    return codes[np.arange(rows)[:, None] * BODY + np.arange(WIDTH)[None, :]]


# Heads of well-known tokens, words that lead to secrets or to harmless values.
HEADS = "ghp_ gho_ github_pat_ xoxb- xoxp- sk_live_ rk_live_ sk- pk- glpat- npm_ pypi- AIza ya29. SG. hf_ dop_v1_ shpat_ key- EAAC AKIA lin_api_ sq0atp-".split()
LEADS = "key api-key access_key auth AUTH_TOKEN pwd pass PASSPHRASE passcode credential creds DB_PASS SECRET_KEY client_secret signing-key login jwt license".split()
PLAIN = "id name file path version see at url host ref class order item page user module import function type label".split()
TERMS = (
    "user account order item page list view data file name type service client server request response handler manager factory builder controller model cache queue event stream buffer index table "
    "column record session customer invoice payment product report status update delete create load save parse format value number total count date time start end first last new old get set find is has by "
    "node tree graph path link word text line image color size width height north south river stone wood hill field green white black brown young king hart well ford land worth mark donald kenzie lean"
).split()
SOUNDS = ("b c ch d f g h j k l m n p qu r s st t th tr v w pl gr sch".split(), "a e i o u ai ea ou ie".split(), ["", "", "n", "r", "s", "l", "nd", "st", "t", "ng"])


class Draw:
    """Labelled findings drawn from rules."""

    def __init__(self, seed):
        self.r = np.random.default_rng(seed)

    def one(self, of):
        return of[int(self.r.integers(len(of)))]

    def pick(self, chars: str, low: int, high: int | None = None) -> str:
        n = int(self.r.integers(low, high + 1)) if high else low
        return "".join(chars[i] for i in self.r.integers(0, len(chars), n))

    def word(self, low: int = 1, high: int = 3) -> str:
        return "".join(self.one(part) for _ in range(int(self.r.integers(low, high + 1))) for part in SOUNDS)

    def secret(self) -> tuple[str, str, str]:
        """(text before, secret, text after)."""
        lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
        mixed = lower + lower.upper() + digits
        quote = self.one(["", "", '"', "'", "`"])
        named = self.one(LEADS) + self.one([": ", "=", " = ", ":", " is ", ' => ', '": "']) + quote
        if self.r.random() < 0.4:
            named = self.word().upper() + "_" + named
        free = self.one(["", "", f"{self.word()} ", f"({self.word()} ", '"', "> ", "- ", f"{self.word()}: "])
        bearer = self.one(["Authorization: Bearer ", "bearer ", "Bearer ", "Basic ", '-H "Authorization: Bearer '])
        kind = int(self.r.integers(10))
        if kind == 0:
            return self.one([named, free, bearer]), self.pick(mixed, 20, 64), quote
        if kind == 1:
            return self.one([named, free, bearer]), self.pick(mixed + "+/", 22, 90) + self.one(["", "=", "=="]), quote
        if kind == 2:
            return self.one([named, free, bearer]), self.one(HEADS) + self.pick(mixed + "_-", 16, 48), quote
        if kind == 3:
            return self.one([named, free, bearer]), "eyJ" + self.pick(mixed, 15, 40) + ".eyJ" + self.pick(mixed, 20, 120) + "." + self.pick(mixed + "-_", 30, 50), quote
        if kind == 4:
            return self.one([named, free]), self.pick(self.one(["0123456789ABCDEF", lower.upper() + "234567"]), 24, 64), quote
        if kind == 5:
            scheme = self.one(["postgres", "mysql", "mongodb+srv", "redis", "https", "amqp", "ftp", "smtp"])
            value = self.one([self.pick(mixed, 8, 30), self.pick(mixed + "!$%^&*-_", 8, 24), self.human()])
            return f"{scheme}://{self.word()}:", value, f"@{self.word()}.{self.word()}.com:{self.pick(digits, 4)}/{self.word()}"
        if kind == 6:
            return self.one([named, bearer]), self.pick(mixed + "!$%&*-_.", 8, 19), quote
        if kind == 7:
            return named, self.pick(self.one([lower, lower + lower.upper(), lower.upper()]), 12, 40), quote
        if kind == 8:
            return named, self.one(["-", "_", "."]).join(self.word(1, 2) for _ in range(int(self.r.integers(4, 7)))), quote
        return named, self.human(), quote

    def human(self) -> str:
        return self.word(2, 3).title() + self.one(["", "_", "-", "@"]) + self.pick("0123456789", 2, 4) + self.one(["", "!", "!!", "#", "$"])

    def common(self) -> tuple[str, str, str]:
        """What ordinary texts are full of: surnames, names in code, article and flight numbers, tags."""
        digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        term = lambda: self.one(TERMS) if self.r.random() < 0.7 else self.word(1, 2)
        camel = lambda low, high: "".join(term().title() for _ in range(int(self.r.integers(low, high + 1))))
        person = lambda: self.one(["Mc", "Mac", "Mc", "Mac", "Fitz", "Van", "De", "Di", "La"]) + self.word(1, 2).title() if self.r.random() < 0.5 else self.one(["Mc", "Mac"]) + term().title()
        prose = lambda: self.one(["", f"{term()} ", f"{term()} {term()} ", f"{term().title()} ", "the ", "and ", "of ", "see "])
        code = lambda: self.pick(upper, 1, 3) + self.one(["", "-", "."]) + self.pick(digits, 3, 6) + self.one(["", "-" + self.pick(digits, 1, 4), "-" + self.pick(upper, 1, 2), "/" + self.pick(digits, 1, 3), self.pick(upper, 1, 2)])
        flight = lambda: self.pick(upper, 2) + self.pick(digits, 3, 4)
        kind = int(self.r.integers(9))
        if kind <= 1:
            return f"{term().title()} ", person(), self.one(["", f" and {term().title()} {person()}", f" and {person()}", ", " + term(), "'s"])
        if kind == 2:
            return prose(), camel(2, 4), self.one(["", " class", f" and {camel(2, 3)}", "()", f" or the {camel(2, 4)} class", ".java"])
        if kind == 3:
            return prose(), term() + camel(1, 4), self.one(["", "()", f" and {term()}{camel(1, 3)}", "(x)", " method"])
        if kind == 4:
            return prose(), "_".join(term() for _ in range(int(self.r.integers(2, 5)))) + self.one(["", "_" + self.pick(digits, 1, 3)]), self.one(["", " table", "()", ","])
        if kind == 5:
            return self.one(["article ", "article number ", "Art. ", "no. ", "part ", "item ", "SKU ", "ref. ", "model ", "order ", "Artikel "]), code() + self.one(["", self.pick(digits, 2, 4)]), self.one(["", " in stock", f" ({term()})"])
        if kind == 6:
            return self.one(["flight ", "Flight ", "on ", "train ", "via "]), flight() + self.one(["/", "-", "_", ".", "+"]) + self.one([flight(), self.pick(upper, 1) + self.pick(digits, 1, 3), self.pick(upper, 3)]), self.one(["", f" at gate {self.pick(upper, 1)}{self.pick(digits, 1, 2)}", " on time"])
        if kind == 7:
            return self.one(["#", "@", "# ", "tagged #"]), camel(2, 4) + self.one(["", "20" + self.pick(digits, 2)]), ""
        return prose(), self.one([lambda: self.pick(digits, 1, 4) + "x" + self.pick(digits, 2, 4) + self.one(["px", "mm", "cm"]), lambda: "/".join(term().title() for _ in range(int(self.r.integers(2, 4)))), lambda: term().title() + "-" + term().title() + self.pick(digits, 0, 2)])(), ""

    def harmless(self) -> tuple[str, str, str]:
        if self.r.random() < 0.45:
            return self.common()
        digits, word = "0123456789", self.word
        named = self.one(PLAIN) + self.one([": ", "=", " = ", ":", " "])
        free = self.one(["", f"{word()} ", f"{word()}, ", "(", '"', f"{word()}\n", "https://", "http://www."])
        some = lambda low, high: [word() for _ in range(int(self.r.integers(low, high + 1)))]
        kind = int(self.r.integers(20))
        lead = self.one([named, free])
        if kind >= 16:  # what stands around secrets and addresses
            host = f"{word()}{self.pick(digits, 0, 2)}.{word()}{self.one(['.com', '.org', '.net/' + word(), '.io:' + self.pick(digits, 4) + '/' + word()])}"
            return [
                lambda: (free, f"{word()}{self.one(['.', '_', ''])}{self.pick(digits, 2, 4)}", "@" + host), lambda: (f"{free}{word()}.{self.pick(digits, 2)}@", host, ""),
                lambda: (f"{free}{word()}://{word()}:{self.human()}@", host, ""), lambda: (free, f"{word().upper()}_{self.one(LEADS).upper()}", self.one(["=", ": "]) + self.pick(digits + word(), 20)),
            ][kind - 16]()
        value = [
            lambda: word() + "".join(w.title() for w in some(1, 4)) + self.one(["", self.pick(digits, 1, 2)]),
            lambda: "".join(w.title() for w in some(2, 5)) + self.one(["", self.pick(digits, 1, 2)]),
            lambda: "_".join(some(2, 5)) + self.one(["", "_" + self.pick(digits, 1, 4)]), lambda: "-".join(some(2, 6)) + self.one(["", "-" + self.pick(digits, 1, 4)]),
            lambda: "/".join(some(2, 6)) + self.one(["", "/" + self.pick(digits, 2, 6), ".html", ".py", "/"]), lambda: ".".join(some(2, 4)) + self.one([".com", ".org", ".net", ".de"]) + self.one(["", "/" + word() + self.pick(digits, 1, 3)]),
            lambda: "-".join(self.pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: f"20{self.pick(digits, 2)}-0{self.pick(digits, 1)}-1{self.pick(digits, 1)}T{self.pick('01', 2)}:{self.pick('012345', 2)}:00Z",
            lambda: "v" + ".".join(self.pick(digits, 1, 2) for _ in range(3)) + self.one(["-beta1", "-rc2", "+build5", "a1"]), lambda: word().upper() + "-20" + self.pick(digits, 2) + "-" + self.pick(digits, 4, 8),
            lambda: "_".join(some(2, 4)) + self.one([".pdf", ".tar.gz", ".csv", "_v2.docx", ".jpg"]), lambda: self.pick(digits, 6, 12) + self.one(["px", "km", "EUR", "th", "kWh", "ml"]),
            lambda: "=" * int(self.r.integers(6, 20)) + self.pick(digits, 1) + word(), lambda: "_".join(w.upper() for w in some(2, 4)), lambda: word().upper() + self.pick(digits, 3, 5) + word(),
            lambda: self.pick(word() + word(), 1) * int(self.r.integers(8, 20)) + self.pick(digits, 1),
        ][kind]()
        if self.r.random() < 0.2:  # a leading word with a harmless value: a type, a name, a variable
            lead = self.one(LEADS) + self.one([": ", "=", " = ", " is "])
            value = self.one([lambda: word(2, 4), lambda: word() + "".join(w.title() for w in some(1, 2)), lambda: "required", lambda: "undefined", lambda: "_".join(some(2, 2)), lambda: "${" + word().upper() + "_KEY}", lambda: "*" * 10])()
        return lead, value, self.one(["", '"', ")", ".", ","])

    def example(self) -> tuple[str, int, int, int]:
        """text, start, end, label."""
        label = int(self.r.random() < 0.5)
        before, value, after = self.secret() if label else self.harmless()
        lead = " ".join(self.word() for _ in range(int(self.r.integers(0, 6))))
        text = f"{lead}{self.one([' ', ' ', chr(10), '. '])}{before}" if lead else before
        tail = " ".join(self.word() for _ in range(int(self.r.integers(0, 5))))
        return text + value + after + self.one([" ", "\n", ". "]) + tail, len(text), len(text) + len(value), label


def asked(text: str, start: int, end: int) -> tuple[int, int]:
    """The candidate that a scan would find at a labelled finding (itself if the patterns find none there)."""
    return next(((s, e) for s, e in candidates(text, []) if s < end and start < e), (start, end))


class Network:
    def __init__(self, draw: np.random.Generator):
        size = lambda *s: draw.normal(0, np.sqrt(2 / s[0]), s).astype(np.float32)
        zero = lambda n: np.zeros(n, dtype=np.float32)
        self.p = {
            "embed": draw.normal(0, 0.5, (256, EMBED)).astype(np.float32), "conv": size(SPAN * EMBED, FILTERS), "bias": zero(FILTERS),
            "mix": size(2 * FILTERS, HIDDEN), "lift": zero(HIDDEN), "out": size(HIDDEN, 1)[:, 0], "shift": zero(1),
        }
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple:
        p, n = self.p, WIDTH - SPAN + 1
        e = p["embed"][x]
        u = np.concatenate([e[:, i : n + i] for i in range(SPAN)], axis=2)
        z = np.maximum(u @ p["conv"] + p["bias"], 0)
        inside = (x[:, SPAN // 2 : n + SPAN // 2] >= 128).astype(np.float32)
        inside /= np.maximum(inside.sum(axis=1, keepdims=True), 1)
        pooled = np.concatenate([z.max(axis=1), np.einsum("nl,nlf->nf", inside, z)], axis=1)
        h = np.maximum(pooled @ p["mix"] + p["lift"], 0)
        return h @ p["out"] + p["shift"][0], u, z, inside, pooled, h

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.float32), *(self.forward(x[at : at + WINDOWS])[0] for at in range(0, len(x), WINDOWS))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.offset, -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        out, u, z, inside, pooled, h = self.forward(x)
        d = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(x)).astype(np.float32)
        dh = d[:, None] * p["out"] * (h > 0)
        dp = dh @ p["mix"].T
        dz = inside[:, :, None] * dp[:, None, FILTERS:]
        at = z.argmax(axis=1)
        np.put_along_axis(dz, at[:, None], np.take_along_axis(dz, at[:, None], axis=1) + dp[:, None, :FILTERS], axis=1)
        dz *= z > 0
        du = dz @ p["conv"].T
        n = WIDTH - SPAN + 1
        codes = np.stack([x[:, i : n + i] for i in range(SPAN)], axis=2).ravel()
        embed = np.stack([np.bincount(codes, du.reshape(-1, EMBED)[:, k], minlength=256) for k in range(EMBED)], axis=1)
        conv = u.reshape(-1, SPAN * EMBED).T @ dz.reshape(-1, FILTERS)
        return {"embed": embed, "conv": conv, "bias": dz.sum(axis=(0, 1)), "mix": pooled.T @ dh, "lift": dh.sum(axis=0), "out": h.T @ d, "shift": d.sum(keepdims=True)}

    def train(self, x: np.ndarray, y: np.ndarray, draw: np.random.Generator) -> None:
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(EPOCHS):
            for rows in np.array_split(draw.permutation(len(x)), max(1, len(x) // 96)):
                t += 1
                for k, g in self.gradients(x[rows], y[rows]).items():  # Adam
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    step = 0.006 * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = (self.p[k] - step).astype(np.float32)

    def calibrate(self, out: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling of the candidates' logits, then the highest threshold that keeps RECALL of the labelled secrets."""
        a, b = 1.0, 0.0
        for _ in range(300):
            d = 1 / (1 + np.exp(-np.clip(a * out + b, -30, 30))) - y
            a, b = max(0.05, a - 0.05 * float(np.mean(d * out))), b - 0.05 * float(np.mean(d))
        self.scale, self.offset = a, b
        p = 1 / (1 + np.exp(-np.clip(a * out + b, -30, 30)))
        self.threshold = min(0.5, float(np.quantile(p[y == 1], 1 - RECALL)))


def highest(values: np.ndarray, rows: list[int]) -> np.ndarray:
    """Largest value of each candidate's windows; ``rows``: how many windows each has (at least one)."""
    return np.maximum.reduceat(values, np.concatenate([[0], np.cumsum(rows)[:-1]]).astype(int)) if rows else np.zeros(0)


def train(examples: int = EXAMPLES, seed: int = 7) -> Network:
    rules, draw = Draw(seed), np.random.default_rng(seed)
    found = [rules.example() for _ in range(examples)]
    x = [windows(t, *asked(t, s, e)) for t, s, e, _ in found]
    y = np.array([label for *_, label in found], dtype=np.float32)
    cut, net = examples * 4 // 5, Network(draw)
    rows = [len(w) for w in x]
    net.train(np.concatenate(x[:cut]).astype(np.int64), np.repeat(y[:cut], rows[:cut]), draw)
    net.calibrate(highest(net.logits(np.concatenate(x[cut:]).astype(np.int64)), rows[cut:]), y[cut:])
    return net


def find(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind number, end) of each text, sorted."""
    out = [base_spans(t) for t in texts]
    spans, held, size = [], [], 0

    def ask() -> None:
        if held:
            best = highest(net.probability(np.concatenate(held).astype(np.int64)), [len(w) for w in held])
            for (k, s, e), p in zip(spans, best, strict=True):
                if p >= net.threshold:
                    out[k].append((s, 3, e))
            spans.clear()
            held.clear()

    for k, t in enumerate(texts):
        for s, e in candidates(t, out[k]):
            spans.append((k, s, e))
            held.append(windows(t, s, e))
            size += len(held[-1])
            if size >= WINDOWS:
                ask()
                size = 0
    ask()
    return [sorted(x) for x in out]


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, kinds, starts, ends (code points, end exclusive) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = find(batch.column(1).to_pylist(), net)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[KINDS[k] for _, k, _ in x] for x in found], pa.list_(pa.string())), *(pa.array([[s[j] for s in x] for x in found], pa.list_(pa.int32())) for j in (0, 2))],
                ["doc_id", "kinds", "starts", "ends"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, net: Network, mark: str = "[secret]") -> DataFrame:
    """Every row and column of ``docs`` (documents), each span of the text replaced by ``mark``, n_chars counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.column(names.index("text")).to_pylist()
            done = []
            for text, spans in zip(rows, find([t or "" for t in rows], net), strict=True):
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                done.append("".join([*parts, text[at:]]) if spans else text)
            columns = {n: batch.column(i) for i, n in enumerate(names)} | {"text": pa.array(done, pa.string())}
            if "n_chars" in columns:
                changed = [n if a == b else len(a) for n, a, b in zip(columns["n_chars"].to_pylist(), done, rows, strict=True)]
                columns["n_chars"] = pa.array(changed, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], numbers)

    numbers = [f"c{i}" for i in range(len(names))]  # names with dots can't be passed on
    plain = docs.toDF(*numbers)
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train())
    each = F.arrays_zip("kinds", "starts", "ends")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")
    found = found.withColumn("all", each).withColumn("base", F.filter("all", lambda s: s["kinds"] != "model"))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(text("base"), 256).alias("base_sha256"), text("all").alias("spans"))
