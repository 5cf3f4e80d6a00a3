"""Toxicity by a learned lexicon, met through a Levenshtein automaton, and the context of each hit.

The lexicon (words, and stems that stand at the start of words) is learned from labelled rows.  Its trie
is intersected with the Levenshtein automaton of the term's allowed distance, which counts a swap of two neighbours as one
edit; the product is made deterministic lazily, so a word is read once, character by character, and most words
leave it after a few.  Digits and signs inside a word belong to it, so "id1ot" is one substitution away.
Each hit is weighed by its term, its distance, and a window around it: quotation marks and words of
reporting lower it, address in the second person raises it.  A logistic model of the weights, fitted to
the same bounded sample, gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take

WORD = re.compile(r"(?=[\d@$*]*[^\W\d_])[^\W_](?:[\w@$*]*[^\W_])?")
QUOTES = "\"“”„«»‹›‘’`"
# Words that report speech, and words of address, in the four languages of the corpus.
REPORTING = frozenset("said says called quote quoted quotes wrote reported word term dit disait cité mot appelé sagte schrieb zitat wort genannt dijo dice cita palabra llamó escribió".split())
ADDRESS = frozenset("you your yourself youre tu toi vous votre ton du dich dein ihr sie tú usted vosotros ustedes eres".split())
#: What an edit leaves of a term's weight: labelled misspellings are too few to learn it from.
EDIT_FACTOR = 0.5


@dataclass
class Term:
    text: str
    prefix: bool  # a stem: the word may go on
    distance: int
    weight: float


@dataclass
class ToxicityModel:
    terms: list[Term] = field(default_factory=list)
    coef: list[float] = field(default_factory=lambda: [0.0] * 3)
    bias: float = -4.0


class Automaton:
    """Trie of the terms times Levenshtein automaton, determinised as words ask for it."""

    def __init__(self, terms: list[Term], max_states: int = 200_000):
        self.terms, self.max_states = terms, max_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # the largest distance that a term below allows
        for t, term in enumerate(terms):
            at = 0
            self.most[0] = max(self.most[0], term.distance)
            for ch in term.text:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({}), self.ends.append([]), self.most.append(0)
                at = self.children[at][ch]
                self.most[at] = max(self.most[at], term.distance)
            self.ends[at].append(t)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[tuple[dict[int, int], dict[int, int], dict[tuple[int, str], int]]] = []
        self.next: list[dict[str, int]] = []
        self.start = self._state({0: 0}, {}, {})

    def _state(self, nodes: dict[int, int], met: dict[int, int], swaps: dict[tuple[int, str], int]) -> int:
        """nodes: trie node to fewest edits; met: stems already read, with their edits; swaps: trie node that is reached,
        with these edits, if the given character follows.  -1: nothing left."""
        todo = list(nodes)
        while todo:  # skip characters of the lexicon
            x = todo.pop()
            for y in self.children[x].values():
                e = nodes[x] + 1
                if e <= self.most[y] and e < nodes.get(y, 99):
                    nodes[y] = e
                    todo.append(y)
        for x, e in nodes.items():
            for t in self.ends[x]:
                if self.terms[t].prefix and e <= self.terms[t].distance and e < met.get(t, 99):
                    met[t] = e
        if not nodes and not met and not swaps:
            return -1
        key = frozenset([*nodes.items(), *((-1 - t, e) for t, e in met.items()), *swaps.items()])
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append((nodes, met, swaps)), self.next.append({})
        return self.number[key]

    def _step(self, state: int, ch: str) -> int:
        nodes, met, swaps = self.states[state]
        out: dict[int, int] = {}
        ahead: dict[tuple[int, str], int] = {}
        for (y, first), e in swaps.items():
            if first == ch and e < out.get(y, 99):
                out[y] = e
        for x, e in nodes.items():
            if e + 1 <= self.most[x] and e + 1 < out.get(x, 99):
                out[x] = e + 1  # a character too many
            for c, y in self.children[x].items():
                f = e + (c != ch)
                if f <= self.most[y] and f < out.get(y, 99):
                    out[y] = f
                z = self.children[y].get(ch)
                if c != ch and z is not None and e + 1 <= self.most[z] and e + 1 < ahead.get((z, c), 99):
                    ahead[z, c] = e + 1  # the two in the other order
        return self._state(out, dict(met), ahead)

    def match(self, word: str) -> tuple[int, int] | None:
        """Best term (fewest edits, then heaviest) and its edits."""
        if len(self.states) > self.max_states:
            self._forget()
        s = self.start
        for ch in word:
            nxt = self.next[s]
            s = nxt[ch] if ch in nxt else nxt.setdefault(ch, self._step(s, ch))
            if s < 0:
                return None
        nodes, met, _ = self.states[s]
        best = [(e, -self.terms[t].weight, t) for t, e in met.items()]
        best += [(e, -self.terms[t].weight, t) for x, e in nodes.items() for t in self.ends[x] if not self.terms[t].prefix and e <= self.terms[t].distance]
        return (min(best)[2], min(best)[0]) if best else None


class Reader:
    """Hits of a text, and its features."""

    def __init__(self, terms: list[Term], window: int = 4, max_cached: int = 300_000):
        self.auto, self.terms, self.window, self.max_cached = Automaton(terms), terms, window, max_cached
        self.met: dict[str, tuple[int, int] | None] = {}

    def _match(self, word: str) -> tuple[int, int] | None:
        if len(self.met) >= self.max_cached:
            self.met.clear()
        if word not in self.met:
            self.met[word] = self.auto.match(word) if self.terms else None
        return self.met[word]

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, int, int, float]], int]:
        """(start, end, term, edits, context factor) of each hit, and the number of words."""
        low = (text or "").lower()
        found = WORD.findall(low)
        bad = {w: m for w in set(found) if (m := self._match(w))}
        if not bad:
            return [], len(found)
        places = [(m.start(), m.end()) for m in WORD.finditer(low)]
        out = []
        for i, w in enumerate(found):
            if w in bad:
                a, b = places[i]
                near = found[max(0, i - self.window) : i + self.window + 1]
                left = low[max(0, places[max(0, i - self.window)][0] - 1) : a]
                right = low[b : places[min(len(places) - 1, i + self.window)][1] + 1]
                quoted = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
                factor = (0.4 if quoted else 1.0) * (0.6 if REPORTING.intersection(near) else 1.0) * (1.25 if ADDRESS.intersection(near) else 1.0)
                out.append((a, b, *bad[w], factor))
        return out, len(found)

    def features(self, text: str | None) -> list[float]:
        found, n = self.hits(text)
        load = sum(self.terms[t].weight * f * EDIT_FACTOR**e for _, _, t, e, f in found)
        return [math.log1p(load), math.log1p(len({t for _, _, t, _, _ in found})), math.log1p(100 * load / max(20, n))]


def _allowed(form: str, prefix: bool) -> int:
    """Edits that a term tolerates at most: short ones and short stems resemble too many other words."""
    n = len(form)
    return 0 if n < (6 if prefix else 4) else 1 if n < 9 or prefix else 2


def learn_lexicon(texts: list[str], toxic: list[int], max_terms: int = 2000) -> list[Term]:
    """Words and stems that mark toxic texts: the ``max_terms`` heaviest, which bounds the model.

    A form must occur in so many toxic texts that chance alone would yield few such forms.  Of a word and
    its stems the one with most toxic texts for its clean ones is kept, the longest of equals.  Beside a stem stands its
    most frequent word with the same weight, so that misspellings of the stem's own letters are met as well.
    """
    seen: set[tuple[int, int]] = set()
    df = {0: Counter(), 1: Counter()}
    n = Counter()
    for text, y in zip(texts, toxic, strict=True):
        w = WORD.findall(text.lower())
        runs = [" ".join(w[i : i + 5]).encode() for i in range(max(1, len(w) - 4))]
        marks = {(k, min(zlib.crc32(r, k) for r in runs)) for k in (1, 2, 3, 4)}
        if marks & seen:  # a near copy of an earlier text would count its words again
            continue
        seen |= marks
        n[y] += 1
        forms = set(w)
        df[y].update({(x, False) for x in forms} | {(x[:k], True) for x in forms for k in range(4, min(len(x), 10))})
    if not n[0] or not n[1]:
        return []
    share = n[1] / (n[0] + n[1])
    v = max(10, sum(c > 1 for c in df[1].values()))
    least = max(3, math.ceil(math.log(v / 2) / math.log(1 / share)))
    odds = lambda f: math.log((df[1][f] + 0.5) / (n[1] + 1)) - math.log((df[0][f] + 0.5) / (n[0] + 1))
    kept, whole = {}, {}
    for f, c in df[1].items():
        if f[1] or len(f[0]) < 3:
            continue
        forms = [f, *((f[0][:k], True) for k in range(4, min(len(f[0]), 10)))]
        best = max(forms, key=lambda g: (df[1][g] - 20 * share * df[0][g], len(g[0]), not g[1]))
        if df[1][best] >= least and (s := odds(best)) >= 3:
            kept[best] = s
            if best[1]:
                whole[best] = min(whole.get(best, f), f, key=lambda g: (-df[1][g], g))
    for stem, word in whole.items():
        kept.setdefault(word, kept[stem])
    heavy = sorted(kept, key=lambda g: (-kept[g], g))[:max_terms]
    return [Term(t, p, _allowed(t, p), kept[t, p] / 5) for t, p in heavy]


def fit(sample: list[tuple[str, int]], steps: int = 1500, rate: float = 0.3, shrink: float = 1e-3) -> ToxicityModel:
    """Lexicon, distances and logistic weights from (text, toxic) pairs."""
    texts, y = [t or "" for t, _ in sample], [int(v) for _, v in sample]
    terms = learn_lexicon(texts, y)
    if not terms:
        rate_ = (sum(y) + 0.5) / (len(y) + 1) if y else 0.01
        return ToxicityModel(bias=math.log(min(0.45, rate_) / (1 - min(0.45, rate_))))
    # a distance that clean texts reach as well is no sign of misspelling
    reader, wrong, right = Reader(terms), Counter(), Counter()
    for t, v in zip(texts, y, strict=True):
        for k in {(h[2], h[3]) for h in reader.hits(t)[0] if h[3]}:
            (right if v else wrong)[k] += 1
    for (t, e), c in wrong.items():
        if c > max(0.0005 * len(y), 0.2 * right[t, e]):
            terms[t].distance = min(terms[t].distance, e - 1)
    reader = Reader(terms)
    x, t = np.array([reader.features(s) for s in texts]), np.array(y, float)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(t > 0, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum()))
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        w -= rate * (x1.T @ (weight * (p - t)) + shrink * np.append(w[:-1], 0))
    w[:-1] = np.maximum(w[:-1], 0)
    return ToxicityModel(terms, [float(v) for v in w[:-1]], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, exclude=None, max_chars: int = 64_000_000) -> ToxicityModel:
    """Fit to at most ``max_rows`` labelled documents of at most ``max_chars`` characters together, taken whole in the
    order of their hashed doc_id; a text that would pass the bound is left out.

    Null labels, ids and texts do not count.  Of several labels of a document the largest counts, of several texts the one
    of the smallest hash, once.  ``exclude`` is a condition on doc_id.  Without a usable row nothing is toxic.
    """
    lab = take(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    if exclude is not None:
        lab = lab.where(~exclude)
    lab = lab.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    text = take(docs, "doc_id", "text").where("text is not null")
    # the sample has at most max_rows rows, so it may be broadcast
    rows = text.join(F.broadcast(lab), "doc_id").withColumn("name", F.xxhash64("text"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("name", F.length("text").alias("n"))).alias("t"), F.max("toxic").alias("toxic"))
    chosen, total = [], 0
    for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "t.*", "toxic").collect():
        if total + r["n"] <= max_chars:
            chosen.append((r["doc_id"], r["name"], r["toxic"]))
            total += r["n"]
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, name long, toxic int")
    got = text.withColumn("name", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "name"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    return fit([(r["text"], r["toxic"]) for r in sorted(got, key=lambda r: r["doc_id"])])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, hits (array of start, end, term, edits, context) for every row, repeated ones each.

    Null texts count as empty, and an empty text has no hit: its score is the model's for no feature.  Of terms at equal
    edits the heavier is the hit, of equal weights the first by text.  Texts are read whole; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        reader = Reader(m.terms)
        for pdf in batches:
            scores, hits = [], []
            for text in pdf["text"]:
                z = m.bias + float(np.dot(m.coef, reader.features(text)))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                hits.append([{"start": a, "end": b, "term": m.terms[t].text, "edits": e, "context": f} for a, b, t, e, f in reader.hits(text)[0]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "hits": hits})

    rows = take(docs, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = "doc_id string, score double, hits array<struct<start:int,end:int,term:string,edits:int,context:double>>"
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
