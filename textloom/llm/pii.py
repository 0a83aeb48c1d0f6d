"""Personal data by a semi-Markov conditional random field over rules.

Rules find e-mail addresses, IP addresses, card numbers and phone numbers by fixed patterns; what they find stays.
Around digits, at signs and spelled-out addresses that no rule covers, a semi-Markov conditional random field chooses
boundaries and types together: a candidate segment of up to MAX_TOKENS tokens is scored by features of the whole span
(digits, checksum, shape of groups, separators, the word before it), and dynamic programming over segments finds the
best labelling. So a phone number directly followed by a card number, which the patterns read as one long number and
drop, becomes two spans. The field learns once from sentences made by a seeded generator, by gradient ascent on the
exact log-likelihood. Its spans that overlap a rule's span or that are plain numbers are not added.

Defined cases: a null text is the empty text; offsets are code points; texts of any length are read whole, runs of
digits or dots of any length in linear time; rows that repeat give equal rows; null ids are carried along; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import body, table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, SEED = 7, 11
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_dotted = re.compile(r"[0-9][0-9.]*\.[0-9.]*")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digits = re.compile(r"[0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers parted by single dots, from the left; those with a part over 255 are dropped."""
    out = []
    for run in _dotted.finditer(text):
        parts = [(m.start(), m.end()) for m in _digits.finditer(text, run.start(), run.end())]
        k = 0
        while k + 3 < len(parts):
            four = parts[k : k + 4]
            gap = next((i for i in range(3) if four[i + 1][0] - four[i][1] != 1), None)
            if gap is not None:
                k += gap + 1
                continue
            if all(b - a - len(text[a:b]) + len(text[a:b].lstrip("0") or "0") <= 3 and int(text[a:b].lstrip("0")[:4] or "0") <= 255 for a, b in four):
                out.append((four[0][0], four[3][1]))
            k += 4
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _number(text: str, a: int, b: int) -> str:
    return "".join(_digits.findall(text, a, b))


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _card.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(n := _number(text, *m.span())) <= 19 and luhn(n)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _phone.finditer(text) if 9 <= len(_number(text, *m.span())) <= 15] if "+" in text else []


def rules(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind, then start."""
    return [(k, a, b) for k, f in enumerate((emails, addresses, cards, phones)) for a, b in f(text)]


# The field

_token = re.compile(r"[^\s]+")
#: Marks that no entity holds, so that key:value pairs, compact JSON and lists part into tokens; not within [at] and [dot].
GLUE, _bracketed = frozenset(":,;=\"|{}<>"), re.compile(r"\[(?:at|dot)\]", re.I)
_trigger = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]|\bat\s+\S+\s+dot\b", re.I)
_cues = {"mail": 0, "e-mail": 0, "email": 0, "contact": 0, "ip": 1, "host": 1, "address": 1, "server": 1, "card": 2, "visa": 2, "mastercard": 2, "credit": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "telephone": 3}
_spelled = re.compile(r"[a-z0-9._%+-]+\s*(?:@|[\[(]at[\])]|\sat\s)\s*[a-z0-9-]+(?:\s*(?:\.|[\[(]dot[\])]|\sdot\s)\s*[a-z0-9-]+)+", re.I)
_phone_shape = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{2,4}[ .-]?[0-9]{2,5}")


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of tokens: parted by white space and by marks that belong to no number or address, without marks around them."""
    out = []
    for m in _token.finditer(text, start, end):
        at, stop = m.span()
        cuts = [k for k in range(at, stop) if text[k] in GLUE] if not _bracketed.search(text, at, stop) else []
        for a, b in zip([at, *(k + 1 for k in cuts)], [*cuts, stop], strict=True):
            while b > a and text[b - 1] in ".!?\"'>]}":
                b -= 1
            while a < b and text[a] in "\"'<[{":
                a += 1
            if a < b:
                out.append((a, b))
    return out


def features(text: str, spans: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Of the whole segment of tokens i to j - 1."""
    a, b = spans[i][0], spans[j - 1][1]
    span = text[a:b]
    n = j - i
    if b - a > 80:
        return ["long"]
    digits = _number(span, 0, len(span))
    k, letters = len(digits), any(c.isalpha() for c in span)
    out = [f"n={n}", f"digits={k if k < 20 else 20}", f"letters={letters}"]
    before = text[spans[i - 1][0] : spans[i - 1][1]].lower().rstrip(":=") if i else ""
    if before in _cues:
        out.append(f"cue={KINDS[_cues[before]]}")
    if k and not letters:
        plain = all(c in "+0123456789 ().-" for c in span)
        out.append(f"plain={plain}")
        if plain:
            out += [f"card={13 <= k <= 19 and luhn(digits) and '+' not in span and '(' not in span}", f"phone={bool(_phone_shape.fullmatch(span)) and 9 <= k <= 15}", f"plus={span[0] == '+' and span.count('+') == 1}", f"parted={any(c in ' ().-' for c in span)}", f"bracket={'(' in span and ')' in span}"]
            groups = [len(x) for x in _digits.findall(span)]
            out += [f"groups={len(groups)}", f"even={len(set(groups)) == 1 and len(groups) > 1}", f"quad={len(groups) == 4 and span.count('.') == 3 and len(span) == k + 3 and all(int(x) < 256 for x in span.split('.') if len(x) < 5)}"]
    elif letters:
        out += [f"spelled={bool(_spelled.fullmatch(span))}", f"at={'@' in span}"]
    return out


def _make(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence of made-up words with personal data and other numbers in it: text, (kind, start, end)."""
    word = lambda: "".join(rng.choice("aeiou" if k % 2 else "bdlmnrst") for k in range(rng.randint(2, 8)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        head = rng.choice("3456") + num(rng.choice([12, 14, 14, 14]))
        digits = next(head + c for c in "0123456789" if luhn(head + c))
        sep = rng.choice(["", "", " ", "-", "."])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        shape = rng.choice(["+1 ({}) {}-{}", "+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+1 {} {} {}", "+1-{}-{}-{}", "+49 {} {}{}"])
        return shape.format(a, b, c)

    def email():
        return rng.choice(["{}@{}.com", "{} at {} dot com", "{} [at] {} [dot] org", "{}(at){}(dot)net", "{}@{} . org"]).format(word() + rng.choice(["", "." + word(), num(2)]), word())

    quad = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    noise = [lambda: num(rng.randint(1, 6)), lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"20{num(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)), lambda: "password=" + num(3) + word() + num(4), lambda: '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: num(rng.randint(20, 30)), lambda: num(rng.randint(13, 16)), lambda: f"{num(2)}:{num(2)}", lambda: f"{num(1)},{num(3)}.{num(2)}", lambda: f"at {word()} {word()}", lambda: "-".join(num(2) for _ in range(3)), lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}"]
    text, spans = word(), []
    for _ in range(rng.randint(2, 5)):
        text += " " + " ".join(word() for _ in range(rng.choice([0, 0, 1, 2, 3]))) if rng.random() < 0.7 else ""
        text = text.rstrip() + " "
        if rng.random() < 0.45:
            made = rng.choice(noise)()
            if made.isdigit() and 13 <= len(made) <= 19 and luhn(made):
                continue
            text += made
        else:
            kind = rng.randrange(4)
            if rng.random() < 0.2:
                text += rng.choice([c for c, k in _cues.items() if k == kind]) + rng.choice([" ", ": "])
            made = (email, quad, card, phone)[kind]()
            if rng.random() < 0.25:
                text += rng.choice(['{"' + word() + '":"', word() + ":", word() + "=", num(2) + ",", word() + ";"])
            spans.append((kind, len(text), len(text) + len(made)))
            text += made + rng.choice(["", "", ".", ",", '",', ";" + word()])
    return text + " " + word(), spans


class SemiCRF:
    """Labels 0 to 3 are KINDS, 4 is a single token outside."""

    def __init__(self, weights: dict[tuple[int, str], float]):
        self.weights = weights

    def table(self, text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
        """Of each end j: (start, features) of each segment that ends there."""
        return [[(i, features(text, spans, i, j)) for i in range(max(0, j - MAX_TOKENS), j)] for j in range(1, len(spans) + 1)]

    def scores(self, table) -> list[list[tuple[int, int, float]]]:
        get = self.weights.get
        return [[(i, y, sum(get((y, f), 0.0) for f in fs)) for i, fs in row for y in range(5) if y < 4 or i == j] for j, row in enumerate(table)]

    def best(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(kind, first token, end token) of the best labelling."""
        rows = self.scores(self.table(text, spans))
        best, back = [0.0], []
        for row in rows:
            score, i, y = max((best[i] + s, i, y) for i, y, s in row)
            best.append(score)
            back.append((i, y))
        out, j = [], len(spans)
        while j:
            i, y = back[j - 1]
            if y < 4:
                out.append((y, i, j))
            j = i
        return out[::-1]

    @classmethod
    def fit(cls, sentences: int = 240, rounds: int = 5, rate: float = 0.25, ridge: float = 1e-4) -> SemiCRF:
        rng = random.Random(SEED)
        made = []
        for text, gold in (_make(rng) for _ in range(sentences)):
            spans = tokens(text, 0, len(text))
            at = {a: k for k, (a, _) in enumerate(spans)}
            ends = {b: k + 1 for k, (_, b) in enumerate(spans)}
            kept = {(at[a], ends[b], k) for k, a, b in gold if a in at and b in ends and ends[b] - at[a] <= MAX_TOKENS}
            inside = {t for i, j, _ in kept for t in range(i, j)}
            kept |= {(t, t + 1, 4) for t in range(len(spans)) if t not in inside}
            made.append((cls({}).table(text, spans), kept))
        own = cls({})
        sums: dict[tuple[int, str], float] = {}
        for _ in range(rounds):
            rng.shuffle(made)
            for rows, gold in made:
                scored = own.scores(rows)
                n = len(rows)
                ahead = np.full(n + 1, -np.inf)
                behind = np.full(n + 1, -np.inf)
                ahead[0] = behind[n] = 0.0
                for j, row in enumerate(scored, 1):
                    ahead[j] = np.logaddexp.reduce([ahead[i] + s for i, _, s in row])
                for j in range(n, 0, -1):
                    for i, _, s in scored[j - 1]:
                        behind[i] = np.logaddexp(behind[i], behind[j] + s)
                change: dict[tuple[int, str], float] = {}
                for j, row in enumerate(scored, 1):
                    of = dict(rows[j - 1])
                    for i, y, s in row:
                        step = ((i, j, y) in gold) - float(np.exp(ahead[i] + s + behind[j] - ahead[n]))
                        if abs(step) > 1e-4:
                            for f in of[i]:
                                change[y, f] = change.get((y, f), 0.0) + step
                for key, g in change.items():
                    sums[key] = sums.get(key, 1e-8) + g * g
                    own.weights[key] = own.weights.get(key, 0.0) * (1 - ridge) + rate * g / sums[key] ** 0.5
        return own


@lru_cache(1)
def trained() -> dict[tuple[int, str], float]:
    return SemiCRF.fit().weights


def _sound(kind: int, span: str) -> bool:
    """Whether the span can be of the kind at all."""
    n = _number(span, 0, len(span))
    if kind == 0:
        return bool(_spelled.fullmatch(span))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", span)) and all(int(x) < 256 for x in span.split("."))
    if kind == 2:
        return 13 <= len(n) <= 19 and luhn(n) and not any(c.isalpha() for c in span)
    return 9 <= len(n) <= 15 and bool(_phone_shape.fullmatch(span)) and not n == span


def spans_of(text: str, field: SemiCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """What the rules find, and all spans with what the field adds; both by kind, then start."""
    base = rules(text)
    taken = sorted((a, b) for _, a, b in base)
    added, windows = [], []
    k, reach = 0, -1
    for m in _trigger.finditer(text):
        at = m.start()
        while k < len(taken) and taken[k][0] <= at:
            reach = max(reach, taken[k][1])
            k += 1
        if at < reach:
            continue
        if windows and at < windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], at + 48)
        else:
            windows.append([at, at + 48])
    # Windows may overlap, so that an entity at a seam is whole in one of them; what the earlier one found stays.
    for at, end in windows:
        start, stop = max(0, at - 40), min(len(text), end)
        while start > 0 and not text[start - 1].isspace() and at - start < 80:
            start -= 1
        while stop < len(text) and not text[stop].isspace() and stop - end < 80:
            stop += 1
        own = tokens(text, start, stop)
        for kind, i, j in field.best(text, own):
            a, b = own[i][0], own[j - 1][1]
            if _sound(kind, text[a:b]) and not any(x < b and a < y for x, y in taken) and not any(x < b and a < y for _, x, y in added[-8:]):
                added.append((kind, a, b))
    return base, sorted(base + added)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the rules' spans), spans (all), n_added of every row."""
    weights = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = SemiCRF(weights)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, every = spans_of(text, field) if _trigger.search(text) else ([], [])
                rows.append((*(sum(x[0] == k for x in base) for k in range(4)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), len(every) - len(base)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"], index=batch.index)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
