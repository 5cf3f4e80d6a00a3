"""Personal data in texts: fixed patterns, and spans that a classifier selects beside them.

Four fixed patterns give the base spans (email, ip, card, phone).  Generators of high recall propose further spans, which
may overlap: addresses with "at" and "dot" spelt out, numbers of telephones without a plus, cards with odd separators, bank
accounts, long and defanged internet addresses.  Gradient-boosted trees judge each by its format and its context.  A monotone
calibration on samples that the trees have not seen turns scores into probabilities, and each kind has the lowest threshold
that keeps the wanted precision there.  Of overlapping candidates the likeliest stays; none touches a base span.
Trees are trained from labelled samples (text, spans), of which at most ``max_rows`` are taken.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotated, position, restored, take

# The contract's kinds and patterns.
BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Kinds of spans that the trees add.
ADDED = ("spelt_email", "other_ip", "other_card", "local_phone", "account")
KINDS = BASE + ADDED
SPAN = [("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the fixed patterns' matches, in order.

    Equal to the leftmost non-overlapping matches of each pattern with failing ones dropped, in time linear in the text: an address is
    sought from its ``@``, and a chain of dotted numbers is cut once.
    """
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((start, 1, start + size))
            start += size + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# Generators.  Every repeat is bounded, so the work is in proportion to the text.
AT = re.compile(r"[\x20\[({<](?:at|AT|At|@)[\x20\])}>]|[^\s@]@[^\s@]|\x20@\x20?|@\x20")
LEFT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}$")
AROUND = re.compile(r"[\x20\[({<]{0,2}(?:at|AT|At|@)[\x20\])}>]{0,2}")
RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({<]?\x20?(?:dot|DOT|Dot)\x20?[\])}>]?\x20?|\x20?[\[({<]?\.[\])}>]?)[A-Za-z0-9-]{2,63}){1,4}")
NUMBER = re.compile(r"(?<![0-9A-Za-z.,])\(?[0-9]{1,6}\)?(?:[\x20./–-]{1,2}\(?[0-9]{1,8}\)?){1,6}(?![0-9A-Za-z])")
DIGITS = re.compile(r"(?<![0-9A-Za-z.,+])[0-9]{7,19}(?![0-9A-Za-z])")
GROUPED = re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[\x20./_ –-]{1,3}[0-9]{2,7}){2,4}(?![0-9A-Za-z])")
DEFANGED = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20)[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])")
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of everything that may be personal data; spans may overlap and repeat for several kinds."""
    out = set()
    for m in AT.finditer(text):
        k = m.start() + (m[0].index("@") if "@" in m[0] else 1)
        a = AROUND.match(text, k)
        lead = k
        while lead > max(0, k - 2) and text[lead - 1] in " [({<":
            lead -= 1
        left, right = LEFT.search(text, max(0, lead - 64), lead), a and RIGHT.match(text, a.end())
        if left and right:
            out.add((left.start(), 4, right.end()))
    for m in DEFANGED.finditer(text):
        out.add((m.start(), 5, m.end()))
    for m in COLONS.finditer(text):
        if m[0].count(":") >= 3 or "::" in m[0]:
            out.add((m.start(), 5, m.end()))
    for pattern in (NUMBER, DIGITS, GROUPED):
        for m in pattern.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 7 <= n <= 15:
                out.add((m.start(), 7, m.end()))
            if 12 <= n <= 19:
                out.add((m.start(), 6, m.end()))
    for m in ACCOUNT.finditer(text):
        out.add((m.start(), 8, m.end()))
    return sorted(out)


#: Words that announce a kind, in four languages.
CUES = (
    "mail e-mail email contact write correo courriel kontakt schreib".split(),
    "ip host server address adresse dirección login client".split(),
    "card visa mastercard credit karte carte tarjeta amex payment".split(),
    "tel phone call mobile fax cell whatsapp telefon anruf téléphone appelez teléfono llame móvil".split(),
    "iban account bank konto compte cuenta".split(),
)
#: Words that announce a number of another sort.
OTHER = "version isbn order invoice total price page ref sku article date time size code rechnung bestellung facture pedido build id model serial".split()
BEFORE, AFTER = 40, 12
WORDS = re.compile(r"[^\W\d_][^\W\d_-]*")


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, rank: int, end: int) -> list[float]:
    """Format of a candidate, and what stands around it."""
    s, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    letters = sum(c.isalpha() for c in s)
    near = [w.lower() for w in WORDS.findall(before)[-4:]]
    cue = [max((i + 1 for i, w in enumerate(near) if w in words), default=0) for words in CUES]
    own = {4: 0, 5: 1, 6: 2, 7: 3, 8: 4}[rank]
    seps = sorted({c for c in s if not c.isalnum()})
    last = re.split(r"[^A-Za-z0-9]+", s.rstrip(")]}>"))[-1]
    return [
        *(float(rank == r) for r in range(4, 9)),
        len(s), len(digits), letters, len(groups), min(groups, default=0), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(bool(digits) and luhn(digits)), len(set(digits)), float(s.startswith("(")), float(digits.startswith("0")), float(digits.startswith("00")), float(digits[:2] in ("19", "20")),
        len(seps), float("/" in s), float("." in s), float("-" in s), float(" " in s), float("@" in s), float(bool(re.search(r"\b(?:dot|DOT|Dot)\b", s))), float(bool(re.search(r"[\[({<]", s))),
        float(last.isalpha()), len(last), s.count(":"), float("::" in s), float(s.count("(") == s.count(")")), float(rank == 8 and _mod97(s)),
        float(len(groups) == 4 and all(g <= 3 for g in groups) and all(int(g) <= 255 for g in re.findall("[0-9]{1,3}", s))),
        cue[own], max(cue[:own] + cue[own + 1 :]), float(any(w in OTHER for w in near[-2:])), float(before[-1:] in "$€£#=" and bool(before)), float(after[:1] in "%€$°" and bool(after)),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] == ":"), float(bool(re.match(r"[\s./_–-]{0,3}[0-9]", after))), float(bool(re.search(r"[0-9][\s./_–-]{0,3}$", before))), float("://" in before[-20:]),
    ]


@dataclass
class Boosted:
    """Trees of one depth, each as arrays of features and thresholds by node and of values by leaf."""

    depth: int
    bias: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.2, shrink: float = 1.0, bins: int = 32) -> Boosted:
    """Newton boosting of the logistic loss.  Thresholds are quantiles of a feature; a node without gain sends all rows left."""
    share = min(0.99, max(0.01, float(y.mean()) if len(y) else 0.01))
    model = Boosted(depth, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score = np.full(len(y), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf), np.full(2**depth - 1, bins)
        node = np.zeros(len(y), int)
        for level in range(depth):
            first = 2**level - 1
            at = node - first
            gain = np.zeros(2**level)
            for f, c in enumerate(cuts):
                key = at * (bins + 1) + binned[:, f]
                gs, hs = (np.bincount(key, v, 2**level * (bins + 1)).reshape(-1, bins + 1).cumsum(1) for v in (g, h))
                total = gs[:, -1:] ** 2 / (hs[:, -1:] + shrink)
                split = gs**2 / (hs + shrink) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + shrink) - total
                best = split[:, : len(c)].argmax(1)
                better = split[np.arange(2**level), best] > gain + 1e-9
                for k in np.flatnonzero(better):
                    gain[k], feature[first + k], threshold[first + k], cut[first + k] = split[k, best[k]], f, c[best[k]], best[k]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - len(feature)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + shrink)
        model.trees.append((feature, threshold, value))
        score += value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone probabilities by pooling neighbours that violate the order: (scores, probabilities) of the steps."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2]]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class PrivacyModel:
    trees: Boosted
    steps: np.ndarray
    probabilities: np.ndarray
    thresholds: dict[int, float]  # by rank of the kind

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.zeros(len(x))
        at = np.searchsorted(self.steps, self.trees(x), "right") - 1
        return np.where(at < 0, 0.0, self.probabilities[np.maximum(at, 0)])


def fit(samples: list[tuple[str, list[tuple[int, int, str]]]], precision: float = 0.98) -> PrivacyModel:
    """Trees on two thirds of the samples; calibration and thresholds on the rest.  A kind that reaches ``precision`` at no
    threshold selects nothing."""
    x, y, rank, held = [], [], [], []
    for i, (text, spans) in enumerate(samples):
        true = {(a, KINDS.index(kind), b) for a, b, kind in spans if kind in ADDED}
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(c in true)
            rank.append(c[1])
            held.append(i % 3 == 2)
    if not x:
        return PrivacyModel(Boosted(1, 0.0), np.zeros(0), np.zeros(0), {})
    x_, y_, rank_, held_ = np.array(x, float), np.array(y, float), np.array(rank), np.array(held)
    trees = boost(x_[~held_], y_[~held_])
    score = trees(x_[held_])
    steps, p = isotonic(score, y_[held_]) if held_.any() else (np.zeros(0), np.zeros(0))
    model = PrivacyModel(trees, steps, p, {})
    calibrated = model(x_[held_]) if held_.any() else np.zeros(0)
    for r in range(len(BASE), len(KINDS)):
        mine, true = calibrated[rank_[held_] == r], y_[held_][rank_[held_] == r]
        fits = [t for t in np.unique(mine) if t >= 0.5 and true[mine >= t].mean() >= precision]
        if fits:
            model.thresholds[r] = float(fits[0])
    return model


def train(samples: DataFrame, max_rows: int = 20_000) -> PrivacyModel:
    """Fit to at most ``max_rows`` samples (text string, spans array of start, end, kind) in the order of their hash; a null in either counts for none."""
    rows = samples.where("text is not null and spans is not null").orderBy(F.xxhash64("text"), "text").limit(max_rows).collect()
    return fit([(r["text"], [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in rows])


def sample_rows(n: int = 6000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled samples from a seeded rule: personal data of each kind, with or without a word that announces it, and
    numbers, dates, versions and codes of other sorts, between words of random letters."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("aeioubcdfghlmnprstvwz", k=rng.randint(1, 9)))
    pick = rng.choice

    def checked(k: int, right: bool = True) -> str:
        stem = d(k - 1)
        return stem + next(c for c in rng.sample("0123456789", 10) if luhn(stem + c) == right)

    def cut(s: str, sizes: list[int], sep: str) -> str:
        parts = []
        for k in sizes:
            parts.append(s[:k])
            s = s[k:]
        return sep.join([*parts, s] if s else parts)

    def iban(right: bool) -> str:
        land, body = pick(["DE", "FR", "ES", "GB", "NL", "IT"]), d(pick([16, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        check = check if right else (check + rng.randint(1, 80)) % 97 + 1
        s = f"{land}{check:02d}{body}"
        return cut(s, [4] * ((len(s) - 1) // 4), " ") if rng.random() < 0.6 else s

    def mail() -> str:
        at = pick([" at ", "(at)", "[at]", " (at) ", " [at] ", "{at}", " @ ", "[@]", " AT "])
        dot = pick([" dot ", "[dot]", "(dot)", " [dot] ", "."]) if at.strip() != "at" or rng.random() < 0.1 else pick([" dot ", "[dot]", " (dot) "])
        return word() + pick(["", "." + word(), "_" + d(2), "." + d(2)]) + at + word() + d(rng.randint(0, 1)) + dot + pick(["com", "org", "net", "de", "fr", "es", "io", "example" + dot + "com"])

    def phone() -> str:
        form = pick(["({3}) {3}-{4}", "{3}-{3}-{4}", "{3}.{3}.{4}", "0{3} {7}", "0{2} {2} {2} {2} {2}", "00{2} {3} {7}", "0{3}/{6}", "1-{3}-{3}-{4}", "{3} {3} {4}", "(0{2}) {4} {4}"])
        return re.sub(r"\{(\d)\}", lambda m: d(int(m[1])), form)

    def card() -> str:
        k = pick([16, 16, 16, 15])
        sizes = [4, 4, 4] if k == 16 else [4, 6]
        return cut(checked(k), sizes, pick([".", "/", " - ", "_", "–", " ", "  "]))

    def address() -> str:
        if rng.random() < 0.5:
            return pick(["[.]", "(.)", "[dot]", " dot ", " [.] "]).join(str(rng.randint(0, 255)) for _ in range(4))
        h = lambda: f"{rng.randint(0, 65535):x}"
        return pick([lambda: ":".join(h() for _ in range(8)), lambda: h() + "::" + h(), lambda: "fe80::" + ":".join(h() for _ in range(rng.randint(1, 4))), lambda: ":".join(h() for _ in range(4)) + "::" + h()])()

    def other() -> str:
        y, m, t = rng.randint(1900, 2035), rng.randint(1, 12), rng.randint(1, 28)
        return pick([
            lambda: f"{y}-{m:02d}-{t:02d}", lambda: f"{t}.{m}.{y}", lambda: f"{t:02d}/{m:02d}/{y}", lambda: f"{y}-{m:02d}-{t:02d} {t}:{m:02d}:00", lambda: f"{y}-{y + 1}", lambda: f"{y} {y + 1} {y + 2}",
            lambda: f"{t}:{m:02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: d(rng.randint(7, 19)),
            lambda: checked(16, False), lambda: cut(checked(16, False), [4, 4, 4], pick([" ", "-", ".", "/", "_"])), lambda: checked(pick([12, 13, 16])), lambda: "978-" + cut(d(10), [1, 4, 4], "-"),
            lambda: f"{rng.randint(1, 999)},{d(3)},{d(3)}.{d(2)}", lambda: f"{rng.randint(1, 99)}.{d(3)}.{d(3)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(5)}", lambda: f"{d(2)} {d(3)} {d(2)}", lambda: f"{d(1)} {d(3)} {d(3)}",
            lambda: " ".join(d(rng.randint(1, 5)) for _ in range(rng.randint(2, 6))), lambda: "-".join(d(rng.randint(1, 5)) for _ in range(rng.randint(3, 6))), lambda: f"{d(2)}.{d(6)} {d(2)}.{d(6)}", lambda: f"{d(4)}x{d(4)}",
            lambda: word() + " at " + word() + pick([". ", ".", " "]) + word(), lambda: word() + " at " + word() + " dot " + word() + word(), lambda: word() + "@" + word(), lambda: "a::b", lambda: "std::" + word(), lambda: iban(False),
            lambda: f"{d(1)}:{d(1)}:{d(1)}:{d(1)}", lambda: pick(["AB", "XK", "QQ"]) + d(10) + d(pick([0, 4])),
        ])()

    make = {"spelt_email": mail, "other_ip": address, "other_card": card, "local_phone": phone, "account": lambda: iban(True)}
    cues = dict(zip(("spelt_email", "other_ip", "other_card", "local_phone", "account"), CUES, strict=True))
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += "".join(word() + pick([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rng.randint(0, 8)))
            kind = pick([*make, None, None, None, None, None])
            if kind:
                # digits in the form of a telephone number are one where a word says so, or in the form with brackets
                item = make[kind]()
                needed = kind == "local_phone" and not item.startswith("(") and not item.startswith("00")
                if needed or rng.random() < 0.5:
                    text += pick(cues[kind]) + pick([" ", ": ", " is ", " number ", "= ", " - "])
                spans.append((len(text), len(text) + len(item), kind))
                text += item
            else:
                if rng.random() < 0.4:
                    text += pick(OTHER) + pick([" ", ": ", " is ", "= "])
                text += other()
            text += pick([" ", ", ", ". ", "\n", "; ", "!! ", "### "])
        if rng.random() < 0.15 and not any(k == "spelt_email" for _, _, k in spans):
            text = text.upper()
        rows.append((text, spans))
    return rows


def default_samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sample_rows(), "text string, spans array<struct<start:int,end:int,kind:string>>")


def find(texts: list[str | None], model: PrivacyModel, chunk: int = 50_000) -> list[list[dict]]:
    """All spans of each text, by start, then kind."""
    bases, out = [base_spans(t) if t else [] for t in texts], []
    proposed, rows, likely = [], [], []

    def judge() -> None:
        if rows:
            likely.extend(model(np.array(rows, float)).tolist())
            rows.clear()

    for t, base in zip(texts, bases, strict=True):
        free = _clear(candidates(t), base) if t and model.thresholds else []
        proposed.append(free)
        for c in free:
            rows.append(features(t, *c))
            if len(rows) >= chunk:
                judge()
    judge()
    at = 0
    for base, mine in zip(bases, proposed, strict=True):
        scored = sorted((-p, c) for c, p in zip(mine, likely[at : at + len(mine)], strict=True) if p >= model.thresholds.get(c[1], 2.0))
        at += len(mine)
        spans = [(*c, 1.0) for c in base] + _best(scored)
        out.append([{"start": a, "rank": r, "end": b, "kind": KINDS[r], "score": p} for a, r, b, p in sorted(spans)])
    return out


def _clear(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans, by start, that touch no base span, by start: one pass over the stretches that base spans cover."""
    covered: list[list[int]] = []
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    out, k = [], 0
    for a, r, b in spans:
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k == len(covered) or covered[k][0] >= b:
            out.append((a, r, b))
    return out


def _best(scored: list[tuple[float, tuple[int, int, int]]]) -> list[tuple[int, int, int, float]]:
    """The likeliest of overlapping candidates first.  A candidate's length is bounded, so taken places are a set."""
    taken: set[int] = set()
    out = []
    for p, (a, r, b) in scored:
        if taken.isdisjoint(range(a, b)):
            taken.update(range(a, b))
            out.append((a, r, b, -p))
    return out


def scan(docs: DataFrame, model: PrivacyModel) -> DataFrame:
    """doc_id and spans (array of start, rank, end, kind, score) of every row, by start, then kind as listed in KINDS.

    Places are code points, ends exclusive.  A null text counts as empty and has no span; repeated rows are scanned each;
    texts are read whole, in time in proportion to their length; other columns are not read; an empty table gives an empty result.
    """
    held, kind = docs.sparkSession.sparkContext.broadcast(model), pa.list_(pa.struct(SPAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(find(part.column(1).to_pylist(), held.value), kind)], names=["doc_id", "spans"])

    rows = take(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redacted(text: str, spans: list[dict]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: PrivacyModel) -> DataFrame:
    """``docs`` with all spans in ``text`` replaced; other columns and a null text stay as they are."""
    held, text = docs.sparkSession.sparkContext.broadcast(model), f"_c{position(docs, 'text')}"

    def make():
        return lambda texts: [t if t is None else redacted(t, s) for t, s in zip(texts, find(texts, held.value), strict=True)]

    return restored(annotated(docs, "text", make, "_new string").withColumn(text, F.col("_new")), docs.columns)
