"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IPv4 addresses, card and phone numbers.
The model looks at the text between them for what patterns miss: a run of up to
``longest`` tokens is one candidate segment, scored as a whole (its shape, digit
count, checksum, separators, the words before it), and dynamic programming over
segments of bounded length chooses boundaries and types together.  It is trained
here, by the gradient of the segment likelihood, on sentences composed from
formats of personal and of harmless data.

Only tokens that could be in an entity (a digit, an at sign, a spelled-out at or
dot, a key word) open a lattice; all others are outside by definition of a
candidate, which is what keeps long texts linear.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import free_name, prepare

#: The order of kinds where two spans begin at one place.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn")

# Fixed patterns.  Each is preceded by what keeps it from being tried inside a run it would have begun with.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at each @: the local part is the run of its characters before it, back to the last match at most."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in order of start and then kind; a failing match is dropped, never retried."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return ordered(found)


def ordered(spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- candidate tokens -------------------------------------------------------------------------------------------------

_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key", "akia")
_ARTICLES = ("the", "a", "an", "this", "that")
_ENDINGS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io")
_EDGES = "\"'.,;:!?()[]{}<>|*%&#$»«“”"
_AROUND = 40
_RUN = re.compile("[0-9@]+")
#: Of lower-cased text, each tried only where one of the words occurs.  A spelled-out at counts where a host and a dot, spelled out or not, follow it.
_SPELLED = (
    (_CUES, re.compile("|".join(_CUES))),
    (("dot",), re.compile(r"\bdot\b")),
    (("at",), re.compile(r"\bat\b(?=\s*[\])}]?\s*[a-z0-9-]+\s*(?:[\[({]\s*)?(?:dot\b|\.[a-z0-9]))")),
)
_WORD = re.compile(r"\S+")
_SPACE = re.compile(r"\s")


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    text: str
    open: bool


def token(text: str, a: int, b: int, anchors: list[int]) -> Token:
    """The token at a .. b without the signs around it; brackets that belong to a number or a spelled-out at stay.  One with an anchor in it is open."""
    while a < b and text[a] in _EDGES and text[a] not in "([":
        a += 1
    while b > a and text[b - 1] in _EDGES and text[b - 1] not in ")]":
        b -= 1
    return Token(a, b, text[a:b], bisect_left(anchors, a) < bisect_left(anchors, b))


def anchors_of(text: str) -> list[tuple[int, int]]:
    """Where whatever opens a token begins and ends, in order."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals become two characters
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    found = [m.span() for m in _RUN.finditer(low)]
    for words, pattern in _SPELLED:
        if any(w in low for w in words):
            found += [m.span() for m in pattern.finditer(low)]
    return sorted(found)


def lattices(text: str) -> Iterator[list[Token]]:
    """Tokens, split at white space, of the stretches around what may be personal data; a token is never cut, however long."""
    windows: list[list[int]] = []
    found = anchors_of(text)
    anchors = [a for a, _ in found]
    for a, b in found:
        low, high = max(0, a - _AROUND), min(len(text), b + _AROUND)
        if windows and low <= windows[-1][1]:
            if high <= windows[-1][1]:
                continue
            low = windows.pop()[0]
        else:
            while low and not text[low - 1].isspace():  # the window before ends at white space, so this goes over no token twice
                low -= 1
        end = _SPACE.search(text, high)
        windows.append([low, end.start() if end else len(text)])
    for low, high in windows:
        yield [token(text, *m.span(), anchors) for m in _WORD.finditer(text, low, high)]


# --- whole-span features ----------------------------------------------------------------------------------------------


def shape(text: str) -> str:
    """Letters, capitals and digits to a, A and 9; runs above three shortened."""
    out: list[str] = []
    for c in text:
        s = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c
        if len(out) < 3 or not (out[-1] == out[-2] == out[-3] == s):
            out.append(s)
    return "".join(out)


def span_features(tokens: list[Token], i: int, j: int) -> list[str]:
    """What can be said of tokens i .. j-1 as one segment."""
    whole = " ".join(t.text for t in tokens[i:j])
    signs = set(whole)
    digits = "".join(_DIGITS.findall(whole))
    n = len(digits)
    low = whole.lower()
    before = tokens[i - 1].text.lower().strip(_EDGES) if i else "^"
    out = [
        f"tokens={j - i}",
        f"digits={min(n, 20)}",
        f"before={before}",
        f"ends={'open' if tokens[i].open else 'word'},{'open' if tokens[j - 1].open else 'word'}",
        f"shape={shape(whole)}" if len(whole) < 40 else "shape=long",
        f"signs={''.join(sorted(c for c in signs if not c.isalnum() and not c.isspace()))}",
        f"letters={'none' if not any(c.isalpha() for c in signs) else 'all' if all(c.isalpha() for c in signs) else 'some'}",
    ]
    if 12 <= n <= 19:
        out.append(f"luhn={luhn(digits)}")
    if re.fullmatch(r"[a-z0-9._-]+\s*(?:[\[({]\s*at\s*[\])}]|\bat\b|@)\s*[a-z0-9-]+(?:\s*(?:[\[({]\s*dot\s*[\])}]|\bdot\b|\.)\s*[a-z0-9-]+)+", low) and (" dot " in low or "dot)" in low or "dot]" in low or "at)" in low or "at]" in low):
        parts = re.findall("[a-z0-9-]+", low)
        out += ["spelled address", f"ending={parts[-1] if parts[-1] in _ENDINGS else len(parts[-1])}", f"host={parts[-3] in _ARTICLES}"]
    if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", whole):
        out.append("local number")
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", whole):
        out.append("three two four")
    if re.match(r"(?:password|passwd|secret|token|api_?key)\s*[=:]", low):
        out.append(f"assigned={'digits' if n else 'words'}")
    if re.fullmatch(r"AKIA[0-9A-Z]{16}", whole):
        out.append("access key")
    return out


# --- model ------------------------------------------------------------------------------------------------------------


@dataclass
class SemiCrf:
    """Weights by (type, feature); a token outside any segment scores 0."""

    longest: int = 6
    weight: dict[tuple[str, str], float] = field(default_factory=dict)

    def segments(self, tokens: list[Token]) -> list[tuple[int, int, str, list[str]]]:
        """All candidate segments: they begin and end with a token that may open one."""
        out = []
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + self.longest) + 1):
                first_or_spelled = tokens[i].open or (j - i >= 3 and i + 1 < len(tokens) and tokens[i + 1].open)
                last_or_spelled = tokens[j - 1].open or (j - i >= 3 and tokens[j - 2].open)
                if first_or_spelled and last_or_spelled and all(t.text for t in (tokens[i], tokens[j - 1])):
                    found = span_features(tokens, i, j)
                    out += [(i, j, kind, found) for kind in KINDS]
        return out

    def score(self, kind: str, found: list[str]) -> float:
        w = self.weight
        return w.get((kind, ""), 0.0) + sum(w.get((kind, f), 0.0) for f in found)

    def decode(self, tokens: list[Token]) -> list[tuple[int, int, str]]:
        """The best segmentation; ties go to fewer segments."""
        ending = defaultdict(list)
        for i, j, kind, found in self.segments(tokens):
            if (s := self.score(kind, found)) > 0:
                ending[j].append((i, kind, s))
        best: list[float] = [0.0]
        back: list[tuple[int, str] | None] = [None]
        for j in range(1, len(tokens) + 1):
            top, how = best[j - 1], None
            for i, kind, s in ending[j]:
                if best[i] + s > top:
                    top, how = best[i] + s, (i, kind)
            best.append(top)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((i, j, kind))
                j = i
            else:
                j -= 1
        return out[::-1]

    def train(self, examples: list[tuple[list[Token], set[tuple[int, int, str]]]], epochs: int = 10, rate: float = 0.2, decay: float = 1e-4) -> SemiCrf:
        """Gradient ascent on the likelihood of the segmentations: observed less expected features, by forward and backward sums."""
        lattice = [(len(t), self.segments(t), gold) for t, gold in examples]
        for _ in range(epochs):
            for n, segments, gold in lattice:
                scores = [self.score(k, f) for _, _, k, f in segments]
                starts, ends = defaultdict(list), defaultdict(list)
                for x, (i, j, _, _) in enumerate(segments):
                    starts[i].append(x)
                    ends[j].append(x)
                ahead = [0.0] * (n + 1)
                for j in range(1, n + 1):
                    ahead[j] = _logsum([ahead[j - 1], *(ahead[segments[x][0]] + scores[x] for x in ends[j])])
                behind = [0.0] * (n + 1)
                for i in range(n - 1, -1, -1):
                    behind[i] = _logsum([behind[i + 1], *(behind[segments[x][1]] + scores[x] for x in starts[i])])
                for x, (i, j, kind, found) in enumerate(segments):
                    step = float((i, j, kind) in gold) - exp(min(0.0, ahead[i] + scores[x] + behind[j] - ahead[n]))
                    if abs(step) > 1e-4:
                        for f in ("", *found):
                            old = self.weight.get((kind, f), 0.0)
                            self.weight[kind, f] = old + rate * (step - decay * old)
        return self


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values))


def examples(n: int, longest: int, seed: int = 5) -> list[tuple[list[Token], set[tuple[int, int, str]]]]:
    """Sentences of made-up words with one formatted value each: personal data that the base patterns miss, and harmless look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    letters = lambda a, b: "".join(pick(string.ascii_lowercase) for _ in range(int(rng.integers(a, b))))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def spelled() -> str:
        at, dot = pick([(" at ", " dot "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] ")])
        return letters(3, 9) + pick(["", "." + letters(2, 6), digits(2)]) + at + letters(3, 9) + dot + pick(_ENDINGS)

    personal = [
        ("email", spelled),
        ("phone", lambda: pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))),
        ("ssn", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        ("secret", lambda: pick(["password", "passwd", "secret", "token", "api_key"]) + pick(["=", ":"]) + hexes(int(rng.integers(*pick([(10, 24), (24, 200)]))))),
        ("secret", lambda: pick(["password", "secret", "token", "api_key"]) + pick([" = ", ": ", " : "]) + '"' + hexes(int(rng.integers(16, 64)))),
        ("secret", lambda: "AKIA" + "".join(pick(string.ascii_uppercase + string.digits) for _ in range(16))),
    ]
    harmless = [
        lambda: f"{pick(['19', '20'])}{digits(2)}",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}.{digits(2)}.{digits(4)}",
        lambda: f"{digits(1)}.{digits(1)}.{digits(1)}",
        lambda: f"{digits(2)}:{digits(2)}",
        lambda: digits(int(rng.integers(1, 18))),
        lambda: f"{digits(3)},{digits(3)}",
        lambda: f"{digits(4)}-{digits(4)}",
        lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}",
        lambda: f"{letters(3, 8)} at {letters(3, 8)}",
        lambda: f"a dot {letters(3, 8)}",
        lambda: f"the {pick(_CUES[:4])} {letters(3, 9)}",
        lambda: letters(2, 6) + digits(2),
        lambda: hexes(pick([16, 16, 32, 40, 64, 128])),
        lambda: f"{pick(['version', 'Version'])} {digits(1)}.{digits(1)}",
        lambda: "@" + letters(3, 9),
        lambda: f"{letters(3, 8)} at {pick(_ARTICLES)} dot {pick(['com', 'org', letters(3, 8)])}",
        lambda: f"{letters(3, 8)} at {letters(3, 8)} dot {letters(4, 9)}",
    ]
    out = []
    for k in range(n):
        kind, make = pick(personal) if k % 2 else ("", pick(harmless))
        value = make() if kind else f" {letters(2, 6)} ".join(pick(["{}", "{},", "{}:"]).format(pick(harmless)()) for _ in range(int(rng.integers(1, 4))))
        left = " ".join(letters(2, 9) for _ in range(3))
        line = f"{left} {value}{pick(['', '.', ','])} " + " ".join(letters(2, 9) for _ in range(3))
        a = len(left) + 1
        for tokens in lattices(line):
            gold = {(i, j, kind) for i in range(len(tokens)) for j in range(i + 1, min(len(tokens), i + longest) + 1) if kind and tokens[i].start == a and tokens[j - 1].end == a + len(value)}
            out.append((tokens, gold))
    return out


@lru_cache(maxsize=4)
def model(n: int = 1200, longest: int = 6) -> SemiCrf:
    return SemiCrf(longest).train(examples(n, longest))


def all_spans(text: str, crf: SemiCrf) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those with the model's, none of which touches a base span."""
    base = base_spans(text)
    added = []
    for tokens in lattices(text):
        for i, j, kind in crf.decode(tokens):
            a, b = tokens[i].start, tokens[j - 1].end
            if all(b <= x or y <= a for x, y, _ in base):
                added.append((a, b, kind))
    return base, ordered(base + added)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or union of overlapping ones, replaced by the kind of the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, *, text: str = "text", to: str = "pii", clean: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with one more, a struct: n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, and clean if asked for.

    Spans are kind:start:end, in code points, end exclusive.  A null text is taken
    as empty and has no span; an empty list's digest is that of the empty string.
    clean is the text without the spans (null stays null).  The new column is the
    last; where ``docs`` has one named ``to`` already, that stays and the new one's
    name gets underscores before it.
    """
    prepare(docs.sparkSession)
    crf = model()  # trained once, on the driver; a few thousand weights
    names = [*(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", *["clean"] * clean]

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", clean string" * clean)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                base, every = all_spans("" if t is None else t, crf)
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS[:4]]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), *[None if t is None else redacted(t, every)] * clean))
            yield pd.DataFrame(rows, columns=names)

    return docs.withColumn(free_name(docs, to), run(F.col(text).cast("string")))
