"""Personal data: fixed formats, candidate generators and boosted trees.

Base spans follow fixed formats and always stay.  Beside them, generators with high
recall propose spans that may overlap (numbers in groups, addresses written around
their @ or their dots, in brackets or in words, network addresses of the long kind, key =
value secrets, long opaque strings with digits and without, numbers of persons and of
accounts).  Gradient-boosted trees judge each by its format and by the words around it;
the scores are calibrated by isotonic regression on rows made from other templates than
those that the trees have seen, and per kind the lowest threshold that reaches the wanted
precision there selects what is redacted.

The trees are fitted on the driver in about a second, on a bounded number of labelled
spans that the seeded generator `training_rows` makes (max_rows); the
fitted arrays go to the executors with the function.  Each text is read whole, where
it lies; there is no shuffle.
"""

from __future__ import annotations

import ipaddress
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import plain_columns
from loomgraph.session import ship

#: Kinds in the order of results; the first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# The base formats.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats, by kind, then start; leftmost and not overlapping within
    a kind, matches that fail their check are dropped. Linear in the text's length."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_DIGIT = re.compile("[0-9]")
_NUMBERS = re.compile(r"(?<![\w+.-])(?:\+[0-9]{1,3} ?)?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,23}(?![\w])")
_GROUP = re.compile(r"(?<![\w+.-])[0-9]{13,19}(?![\w])")
# an address is read from its run's beginning only, at any length
_AROUND_AT = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*+ ?[(\[] ?at ?[)\]] ?[\w-]++(?: ?[(\[] ?dot ?[)\]] ?[\w-]++|\.[\w-]++)++", re.I)
# a key is read from its run's beginning only, and runs are possessive: linear at any length
_ASSIGNED = re.compile(r"(?:(?<![\w-])|(?<=[^\WA-Za-z_])[A-Za-z_]*+-)([A-Za-z_-]{2,}+)[ ]?[=:][ ]?[\"']?([^\s\"',;]{6,}+)")
# an address in words, read from its run's beginning only
_SPOKEN = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*+ at [\w-]++(?: dot [\w-]++)++", re.I)
_AT = re.compile(" at ", re.I)
_PARTED_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|(?<= )dot(?= )) ?[0-9]{1,3}){3}(?![\w])", re.I)
_LONG_IP = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{6,39}+(?![\w:])")
_LETTERS = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])")
_RULE = re.compile(r"[_+/=-]+")
_PERSON = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_+/=-])")


def long_address(s: str) -> bool:
    """Whether s is a network address of the long kind."""
    try:
        return s.count(":") > 1 and ipaddress.ip_address(s).version == 6
    except ValueError:
        return False


def account(s: str) -> bool:
    """Whether an account number's check digits are right."""
    plain = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def candidates(text: str) -> list[Span]:
    """Proposed spans of all kinds; they may overlap each other and base spans."""
    out: list[Span] = []
    digits = _DIGIT.search(text) is not None
    if digits:
        for m in _NUMBERS.finditer(text):
            n = len(_digits(m[0]))
            if 7 <= n <= 15:
                out.append(("phone", *m.span()))
            if 13 <= n <= 19:
                out.append(("card", *m.span()))
        out += [("card", *m.span()) for m in _GROUP.finditer(text)]
        out += [("ip", *m.span()) for m in _PARTED_IP.finditer(text)]
        out += [("secret", *m.span()) for m in _PERSON.finditer(text)]
        out += [("secret", *m.span()) for m in _ACCOUNT.finditer(text)]
    if "::" in text or text.count(":") > 6:
        out += [("ip", *m.span()) for m in _LONG_IP.finditer(text) if long_address(m[0])]
    if _AT.search(text):
        out += [("email", *m.span()) for m in _SPOKEN.finditer(text)]
    out += [("secret", *m.span()) for m in _LETTERS.finditer(text) if not _RULE.fullmatch(m[0])]
    if "(" in text or "[" in text:
        out += [("email", *m.span()) for m in _AROUND_AT.finditer(text)]
    if "=" in text or ":" in text:
        out += [("secret", *m.span(2)) for m in _ASSIGNED.finditer(text)]
    if digits:
        out += [("secret", *m.span()) for m in _OPAQUE.finditer(text) if _DIGIT.search(m[0])]
    return sorted(set(out), key=lambda s: (s[1], s[2], s[0]))


#: Words near a span that speak for a kind.
CONTEXT = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "client", "from", "login", "peer"},
    "card": {"card", "visa", "credit", "payment", "paid", "mastercard"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "contact"},
    "secret": {"password", "passwd", "pwd", "secret", "token", "key", "apikey", "credential", "ssn", "social", "iban", "account", "bearer", "auth"},
}
#: Words near a span that speak against personal data.
AGAINST = {"order", "invoice", "version", "page", "isbn", "serial", "commit", "sha", "md5", "checksum", "part", "article", "build", "hash"}


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    s = text[start:end]
    before = text[max(0, start - 32) : start].lower()
    digits, words = _digits(s), set(re.findall("[a-z0-9]+", before))
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts)
    upper, lower = sum(c.isupper() for c in s), sum(c.islower() for c in s)
    letters = [c for c in s.lower() if c.isalpha()]
    vowels = sum(c in "aeiouy" for c in letters) / max(1, len(letters))
    turns = sum(a.islower() and b.isupper() for a, b in zip(s, s[1:])) / len(s)
    parts = sum(s.count(c) for c in "-_/") / len(s)
    hexa = float(bool(re.fullmatch(r"[0-9a-fA-F]+", s)))
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), len(digits) / len(s), float(upper), float(lower), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(s.count(" ")), float(s.count("-")), float(s.count(".")), float(s.count("(")), entropy, hexa, float(bool(digits) and luhn(digits)), float(upper > 0 and lower > 0 and bool(digits)),
        float(not words.isdisjoint(CONTEXT.get(kind, ()))), float(not words.isdisjoint(AGAINST)), float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(bool(re.match(r"(AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|AIza)", s))),
        float(bool(re.fullmatch(r"(19|20)[0-9]{2}[-. ]?[01][0-9][-. ]?[0-3][0-9].*", s))), float(text[start - 1 : start] in ("", " ", "\n", '"', "'", "=", ":")), float("dot" in s.lower()),
        vowels, float(max(map(len, re.findall("[bcdfghjklmnpqrstvwxz]+", s.lower())), default=0)), sum(c in "qxzjwvk" for c in letters) / max(1, len(letters)), turns, parts, float(s.count("[") + s.count("(")), float(s.count(":")), float(bool(re.search(r"[A-Z]{2}[0-9]{0,2} ?$", text[max(0, start - 5) : start]))), float(bool(_PERSON.fullmatch(s))),
        float(bool(_ACCOUNT.fullmatch(s)) and account(s)), float(s.lower().rsplit(" ", 1)[-1].rsplit(".", 1)[-1] in ("com", "org", "net", "edu", "io", "de", "gov")),
    ]


def training_rows(rows: int = 6000, seed: int = 11, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates (features, 0/1): spans of known nature in made-up sentences. The two
    families are made from templates, lead words and separators of their own."""
    r = random.Random(seed * 2 + family)
    letters, hexa, alnum = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    run = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    digits = lambda n: run("0123456789", n)
    consonants, vowels = "bcdfghklmnprstvw", "aeiou"
    spoken = lambda n: "".join(r.choice(consonants if k % 2 else vowels) + (r.choice(consonants) if r.random() < 0.3 else "") for k in range(n))
    word = lambda: run(letters, r.randint(2, 9)) if family == 0 and r.random() < 0.5 else spoken(r.randint(2, 7))
    of = lambda *two: r.choice(two[family])

    def card(n: int) -> str:
        body = digits(n - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(s: str, sizes: tuple[int, ...], sep: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(s[at : at + k])
            at += k
        return sep.join(x for x in [*out, s[at:]] if x)

    def iban() -> str:
        body = digits(r.choice((14, 16, 18)))
        country = r.choice(("DE", "FR", "NL", "GB", "ES"))
        plain = country + f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}" + body
        return plain if r.randint(0, 1) else " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))

    def six(n: int = 8) -> str:
        full = [run(hexa, r.randint(1, 4)) for _ in range(n)]
        return ":".join(full) if r.randint(0, 1) else ":".join(full[:3]) + "::" + ":".join(full[5:])

    def positive(kind: str) -> tuple[str, str]:
        if kind == "email":
            at, dot = r.choice(((" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" at ", " dot ")))
            name = of((f"{word()}.{word()}", word()), (f"{word()}_{digits(2)}", f"{word()}{word()}", word()))
            return of(("mail: ", "contact ", "", ""), ("write to ", "email ", "reach me: ", "")), f"{name}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'edu', 'io'))}"
        if kind == "ip":
            dot = of(("[.]", " [.] ", "(.)"), ("[dot]", " dot ", "(dot)"))
            return of(("from ", "host ", "", "server "), ("login: ", "peer ", "ip ", "")), dot.join(str(r.randint(0, 255)) for _ in range(4)) if r.randint(0, 1) else six()
        if kind == "card":
            return of(("card ", "visa: ", "credit card ", "", "paid with "), ("mastercard ", "payment: ", "card no. ", "")), grouped(card(r.choice((13, 15, 16, 16, 19))), of(((4, 4, 4), (4, 4, 4)), ((4, 4, 4), (4, 6))), r.choice((" ", "-", "", "")))
        if kind == "phone":
            s = digits(10)
            return of(("call ", "phone: ", "tel ", "mobile ", "", "fax "), ("contact ", "tel. ", "call me: ", "")), r.choice((f"({s[:3]}) {s[3:6]}-{s[6:]}", f"+1 ({s[:3]}) {s[3:6]}-{s[6:]}", f"+{r.randint(20, 99)} {s[:3]} {s[3:6]} {s[6:]}", f"{s[:3]}-{s[3:6]}-{s[6:]}", f"{s[:3]}.{s[3:6]}.{s[6:]}", f"0{s[:3]} {s[3:6]} {s[6:]}"))
        key = of(("password", "passwd", "secret", "token", "api_key", "apikey"), ("pwd", "credential", "auth_token", "secret_key", "bearer"))
        style = r.randint(0, 7)
        if style == 7:
            return of(("ssn ", "ssn: ", "social security "), ("social ", "SSN ")), f"{digits(3)}-{digits(2)}-{digits(4)}"
        if style == 6:
            return of(("iban ", "account ", ""), ("IBAN: ", "")), iban()
        if style == 5:  # keys without digits
            return of((f"my {key} is ", f"{key}: ", ""), (f"the {key} ", f"{key} = ", "")), run(of((letters, letters + letters.upper()), (letters.upper(), letters + letters.upper() + "_-")), r.randint(24, 60))
        if style == 4:
            long = run(alnum + letters + "0189" + r.choice(("", "", "_-", "+/")), r.choice((64, 150, 300, 5000)))
            return r.choice(("", f"{key}=", f"{key}: ", f"{word().upper()}_{word().upper()}_{word().upper()}_{key.upper()}=")), long
        if style == 0:
            return "", r.choice(("AKIA", "AKIA", "ASIA")) + run(alnum, 16)
        if style == 1:
            return r.choice(("", "use ")), r.choice(("ghp_", "sk-")) + run(alnum + letters, 32)
        return f"{key}{r.choice(('=', ' = ', ': '))}{r.choice(('', chr(34)))}", run(r.choice((hexa, hexa, alnum + letters + "0123456789")), r.randint(10, 40))

    def negative(kind: str) -> tuple[str, str]:
        if kind == "email":
            return of(("look ", ""), ("we met ", "they stay ")), r.choice((f"{word()} [at] {word()}.{digits(2)}", f"{word()} at {word()} dot {word()}", f"{word()} at {word()} dot {word()} dot {digits(1)}"))
        if kind == "ip":
            return of(("section ", "", "class "), ("use ", "namespace ", "chapter ")), r.choice((f"{run('abcdef', 3)}::{run('abcdef', 3)}", f"{r.choice('abcdef')}::{run('abcdef', 4)}", " dot ".join(digits(1) for _ in range(4)), "[.]".join(digits(3) for _ in range(4)).replace("[.]1", "[.]9")))
        if kind == "card":
            return of(("order ", "invoice ", "serial ", "isbn ", "", ""), ("tracking ", "article ", "part ", "")), r.choice((digits(14), digits(17), digits(16), f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", digits(16)))
        if kind == "phone":
            return of(("order ", "version ", "page ", "on ", "", "", "part no "), ("build ", "invoice ", "in ", "ssn ", "")), r.choice((digits(r.randint(7, 15)), f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)} {digits(2)}", f"{digits(1)}.{digits(2)}.{digits(3)}.{digits(4)}", f"{digits(4)} {digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}"))
        style = r.randint(0, 8)
        if style == 8:
            few = r.choice(letters) + r.choice(letters + "-_/")
            return r.choice(("", f"{word()}=")), run(r.choice((few, few[0], few[0] + "-")), r.choice((20, 30, 80, 400, 5000)))
        if style == 6:  # what the generators propose of prose
            return r.choice(("", f"{word()}: ", f"{word()}=")), of(("-", "_"), ("/", "-")).join(spoken(r.randint(2, 6)) for _ in range(r.randint(4, 12)))
        if style in (5, 7):
            joined = "".join(spoken(r.randint(3, 7)) + r.choice(("", "s", "ch", "ff", "st", "schn", "gs", "rts")) for _ in range(r.randint(2, 5)))
            return of(("", "the ", f"{word()}: "), ("a ", "", f"{word()}=")), r.choice((spoken(r.randint(12, 24)), joined, joined.capitalize()))
        if style == 4:
            if r.randint(0, 1):
                return r.choice(("http:", "https:")), f"//www.{word()}.com/" + "/".join(r.choice((word(), word(), digits(4))) for _ in range(r.randint(3, 40)))
            return r.choice(("", "", f"{word()}=")), r.choice("_-/").join([word() for _ in range(r.randint(4, 60))] + [digits(2)])
        if style == 0:
            return of(("commit ", "sha ", "md5 ", "checksum ", "hash "), ("commit: ", "sha: ", "build ")), run(hexa, r.choice((32, 40)))
        if style == 1:
            return f"{word()}{r.choice(('=', ': '))}", word() + word()
        if style == 2:
            return "", f"{word()}{word()}-{word()}{digits(2)}"
        return f"{of(('width', 'count', 'page', 'size', 'time'), ('height', 'total', 'index', 'port', 'length'))}=", digits(r.randint(6, 9))

    xs, ys = [], []
    for k in range(rows):
        kind = ("email", "ip", "card", "phone", "secret")[k % 5]
        y = k // 5 % 2
        lead, s = (positive if y else negative)(kind)
        head = " ".join(word() for _ in range(r.randint(0, 6)))
        text = f"{head} {lead}{s} " + " ".join(word() for _ in range(r.randint(0, 6)))
        start = text.index(s, len(head) + 1 + len(lead))
        xs.append(features(text, (kind, start, start + len(s))))
        ys.append(y)
    return np.array(xs), np.array(ys, float)


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth as arrays: feature and limit [tree, node], value [tree, leaf];
    steps (scores, probabilities) of the calibration; thresholds by kind."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float
    steps: tuple[np.ndarray, np.ndarray]
    thresholds: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of features."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(math.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.score(x), *self.steps)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: rising (score, probability) points, two a block: its lowest
    and its highest score."""
    blocks: list[list[float]] = []
    for s, y in sorted(zip(scores.tolist(), labels.tolist(), strict=True)):
        blocks.append([s, s, y, 1])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, y2, n2 = blocks.pop()
            low, _, y1, n1 = blocks[-1]
            blocks[-1] = [low, high, y1 + y2, n1 + n2]
    return np.array([x for b in blocks for x in b[:2]]), np.array([b[2] / b[3] for b in blocks for _ in range(2)])


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gradient boosting on the logistic loss with histogram splits and Newton leaves."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    start = math.log(y.mean() / (1 - y.mean()))
    f = np.full(len(x), start)
    feature, limit, value = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h, node = y - p, p * (1 - p), np.zeros(len(x), np.int64)
        for level in range(depth):
            for n in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == n)
                best = (1e-9, 0, np.inf)
                for j, e in enumerate(edges):
                    if not len(e) or len(at) < 20:
                        continue
                    gs, hs = np.bincount(codes[at, j], g[at], len(e) + 1).cumsum(), np.bincount(codes[at, j], h[at], len(e) + 1).cumsum()
                    gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(e[k]))
                _, feature[t, n], limit[t, n] = best
                node[at] = 2 * n + 1 + (x[at, best[1]] > best[2])
        leaf = node - (2**depth - 1)
        value[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        f += value[t][leaf]
    return feature, limit, value, start


@lru_cache(maxsize=4)
def fitted(max_rows: int = 6000, precision: float = 0.98, seed: int = 11) -> Trees:
    """Trees fitted on two thirds of the labelled rows, of one family, and calibrated on a third of the
    other; per kind the lowest threshold with the wanted precision there (1.1: none reaches it)."""
    parts = boost(*training_rows(max_rows * 2 // 3, seed))
    x, y = training_rows(max_rows - max_rows * 2 // 3, seed, family=1)
    raw = Trees(*parts, (np.zeros(1), np.zeros(1)), {})
    scores = raw.score(x)
    steps = isotonic(scores, y)
    p = np.interp(scores, *steps)
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = x[:, 0] == k
        good = [t for t in np.unique(p[own]) if y[own & (p >= t)].mean() >= precision]
        thresholds[kind] = max(0.5, float(min(good, default=1.1)))
    return Trees(*parts, steps, thresholds)


def find(text: str, model: Trees) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans). An added span overlaps no base span and no added one of a
    higher probability; ties go to the earlier start, then the longer span."""
    base = base_spans(text)
    proposed = candidates(text)
    if not proposed:
        return base, base
    p = model.probability(np.array([features(text, s) for s in proposed]))
    # the spans taken so far, disjoint and in order: starts and ends
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for i in sorted(range(len(proposed)), key=lambda i: (-p[i], proposed[i][1], -proposed[i][2])):
        kind, a, b = proposed[i]
        if p[i] < model.thresholds[kind]:
            continue
        k = bisect_right(ends, a)
        if k == len(starts) or b <= starts[k]:
            starts.insert(k, a)
            ends.insert(k, b)
            added.append(proposed[i])
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [KIND] in the place of each span; overlapping spans become one, named
    by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """One row per row of docs: id, n_<kind> of the base spans, base and spans (strings of
    kind:start:end in code points, end exclusive), n_spans (of all kinds, added ones too).

    A null text is an empty one, without spans. Repeated rows repeat. Other columns of docs
    are not read. Texts of any length are read whole."""
    ship(docs.sparkSession)
    model = model or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            bases, spans, total = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = find(text or "", model)
                for k, kind in enumerate(BASE_KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                bases.append(joined(base))
                spans.append(joined(every))
                total.append(len(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(bases, pa.string()), pa.array(spans, pa.string()), pa.array(total, pa.int64())], names=[id_col, *[f"n_{k}" for k in BASE_KINDS], "base", "spans", "n_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in BASE_KINDS)}, base string, spans string, n_spans long")


@plain_columns
def redact(docs: DataFrame, text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """docs with the spans of the text replaced by [KIND]; null texts stay null, a column
    n_chars follows the new text, all others are as they were, whatever their names. Repeated
    rows repeat, texts of any length are read whole, an empty table gives no rows."""
    ship(docs.sparkSession)
    model = model or fitted()
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, find(t, model)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
