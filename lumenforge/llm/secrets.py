"""Secret scans by grammar inference: the prefix tree of labelled credentials of one format is merged, state by state where
the counts are statistically compatible (ALERGIA; Carrasco and Oncina, 1994), into a probabilistic automaton. Every candidate
token is scored by its likelihood under each format against a background of ordinary words. Fixed patterns give base spans,
which always stay; the automata add spans that the patterns miss.
"""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import string
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_table, materialize, share as send, utf8

#: Fixed patterns of the base spans, in the order of their kinds.
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Where in a run a credential may begin besides its start: after what joins it to a name or path.
JOINT = re.compile(r"[=/.]+")
#: The fit's sample: so many values of base assignments, and so many ordinary words, at most.
SAMPLE_VALUES, SAMPLE_DOCS = 600, 400
DRAWN, ALPHA = 400, 0.05
#: Ways out of a state from which it counts as part of a random body.
BODY = 5
#: Occurrences from which a state is held against others by its counts.
TOLD = 12
#: How much further below its weakest labelled credentials a format with a literal head may go, in units of the spread: fresh
#: bodies hold pairs of characters that no labelled one has.
SLACK = 0.25
#: A candidate must be likelier than under the background by so many nats a character, and by so many in all.
MARGIN, MARGIN_ALL = 0.7, 14.0

_ALNUM = string.ascii_letters + string.digits
#: Public credential formats: literal prefix, alphabet of the body, its lengths.
FORMATS = {
    "github": ("ghp_", _ALNUM, (36,)),
    "gitlab": ("glpat-", _ALNUM + "-_", (20,)),
    "google": ("AIza", _ALNUM + "-_", (35,)),
    "jwt": ("eyJhbGciOi", _ALNUM + "-_.", (60, 90, 120, 200, 400, 800)),
    "slack": ("xoxb-", string.digits + "-" + _ALNUM, (40, 48)),
    "stripe": ("sk_live_", _ALNUM, (24, 32)),
}


class Automaton:
    """A probabilistic automaton over characters: per state a map of characters to (next state, log probability) and the log
    probability of stopping."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self._grow(words)
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        self._freeze()
        self.least, self.most, self.head = min(map(len, words)), max(map(len, words)), len(os.path.commonprefix(words))
        logs = [(self.loglik(w), w) for w in words]
        self.mean = sum(p for p, _ in logs) / sum(len(w) + 1 - self.head for w in words)
        #: The format's weakest labelled credentials (1 in 100) set the least likelihood; the spread about the mean a character
        #: past the common head grows with the root of the length, so it holds for bodies of any length.
        self.floor = sorted(self.typical(p, len(w)) for p, w in logs)[len(words) // 100]

    def typical(self, p: float, size: int) -> float:
        """How far the log likelihood of so long a word is above the mean, in units of its spread."""
        n = max(1, size + 1 - self.head)
        return (p - self.mean * n) / math.sqrt(n)

    def _grow(self, words):
        self.next, self.seen, self.via, self.ends = [{}], [0], [{}], [0]
        for w in words:
            at = 0
            self.seen[0] += 1
            for ch in w:
                self.via[at][ch] = self.via[at].get(ch, 0) + 1
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    for a, x in ((self.next, {}), (self.seen, 0), (self.via, {}), (self.ends, 0)):
                        a.append(x)
                at = self.next[at][ch]
                self.seen[at] += 1
            self.ends[at] += 1

    def _distance(self, p: int, q: int, bound: float) -> float | None:
        """The largest difference of frequencies of p's and q's subtrees, in units of what chance allows; None beyond 1."""
        todo, worst = [(p, q)], 0.0
        while todo:
            p, q = todo.pop()
            n, m = self.seen[p], self.seen[q]
            if not n or not m:
                continue
            allowed = bound * (n**-0.5 + m**-0.5)
            for ch in {None, *self.via[p], *self.via[q]}:
                f = (self.ends[p] if ch is None else self.via[p].get(ch, 0)) / n
                g = (self.ends[q] if ch is None else self.via[q].get(ch, 0)) / m
                d = abs(f - g)
                if d > allowed:
                    return None
                worst = max(worst, d)
            if min(n, m) > 1:
                todo += [(self.next[p][ch], self.next[q][ch]) for ch in self.next[p].keys() & self.next[q].keys() if self.next[p][ch] != self.next[q][ch]]
        return worst

    def _merge(self, bound: float):
        """Red states are final; the states next to them, oldest first, fold into the nearest compatible one or turn red."""
        red, blue = [0], sorted(self.next[0].values())
        while blue:
            b = blue.pop(0)
            parent, ch = next((r, ch) for r in red for ch, x in self.next[r].items() if x == b)
            body = [r for r in red if len(self.via[r]) >= BODY]
            if self.seen[b] < TOLD and body:
                # Too rare to tell states apart by: it goes on like the body it comes from, else the most varied one.
                near = [(0, parent if parent in body else max(body, key=lambda r: len(self.via[r])))]
            else:
                near = [(round(d, 6), r) for r in red if (d := self._distance(r, b, bound)) is not None]
            if near:
                self.next[parent][ch] = r = min(near)[1]
                self._fold(r, b)
            else:
                red.append(b)
            known = set(red)
            blue = sorted({x for r in red for x in self.next[r].values()} - known)
        self.red = red

    def _fold(self, r: int, b: int):
        todo = [(r, b)]
        while todo:
            r, b = todo.pop()
            self.seen[r] += self.seen[b]
            self.ends[r] += self.ends[b]
            for ch, n in self.via[b].items():
                self.via[r][ch] = self.via[r].get(ch, 0) + n
                if ch in self.next[r]:
                    todo.append((self.next[r][ch], self.next[b][ch]))
                else:
                    self.next[r][ch] = self.next[b][ch]

    def _freeze(self):
        at = {r: i for i, r in enumerate(self.red)}
        self.moves = [{ch: (at[x], math.log(self.via[r][ch] / self.seen[r])) for ch, x in self.next[r].items()} for r in self.red]
        self.stop = [math.log(self.ends[r] / self.seen[r]) if self.ends[r] else -math.inf for r in self.red]
        # A state that many characters leave is part of a random body: of the format's characters, it lets any pass that its
        # sample happens to lack, by its commonest way, and may be the last. States of literal parts stay strict.
        self.alphabet = {ch for r in self.red for ch in self.via[r]}
        self.other = []
        for i, r in enumerate(self.red):
            p = math.log(0.5 / (self.seen[r] + 0.5 * len(self.alphabet)))
            body = len(self.via[r]) >= BODY
            self.other.append((at[self.next[r][max(self.via[r], key=self.via[r].get)]], p) if body else None)
            if body and not self.ends[r]:
                self.stop[i] = p
        del self.next, self.seen, self.via, self.ends, self.red

    def loglik(self, word: str) -> float:
        return next((p for size, p in self.ends(word, 0) if size == len(word)), -math.inf)

    def ends(self, run: str, start: int):
        """(length, log likelihood) of the words that begin at a place of run, for every end at which one may stop: that of
        the run, also without dashes at its end, and before = / or . or a character that the automaton doesn't let pass."""
        at, total, dashes = 0, 0.0, len(run.rstrip("-"))
        for i in range(start, len(run)):
            ch = run[i]
            move = self.moves[at].get(ch)
            if move is None and ch in self.alphabet:
                move = self.other[at]
            if i > start and (move is None or ch in "=/." or i == dashes):
                yield i - start, total + self.stop[at]
            if move is None:
                return
            at, p = move
            total += p
        yield len(run) - start, total + self.stop[at]


class Background:
    """Log likelihood of ordinary words: smoothed character pairs."""

    def __init__(self, words: list[str]):
        pairs, single = Counter(), Counter()
        for w in words:
            for x, y in zip("\0" + w, w + "\0"):
                pairs[x, y] += 1
                single[x] += 1
        self.pairs, self.single = pairs, single

    def loglik(self, word: str) -> float:
        return sum(math.log((self.pairs[x, y] + 0.5) / (self.single[x] + 0.5 * 70)) for x, y in zip("\0" + word, word + "\0"))


class Grammar:
    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        self.automata = {k: Automaton(sorted(v)) for k, v in sorted(labelled.items()) if v}
        self.background = Background(ordinary)
        self.heads = tuple(FORMATS[k][0] for k in self.automata if k in FORMATS)

    def prefixes(self, run: str, at: int) -> list[tuple[int, float, str]]:
        """(length, advantage over the background in nats, format) of the tokens that begin at a place of a run and count as
        credentials: they end with the run or before a character that joins, and are likely enough under the format."""
        out = []
        for k, a in self.automata.items():
            if k in FORMATS and not run.startswith(FORMATS[k][0], at):
                continue  # the literal states let nothing else pass
            # A format's bodies draw on as they may. The corpus' values have no head, so they would be walked from each start to
            # the run's end: they are scored up to the longest labelled.
            for size, p in a.ends(run if k in FORMATS else run[: at + a.most + 1], at):
                if size < max(16, a.least) or k not in FORMATS and size > a.most or a.typical(p, size) < a.floor - (SLACK if k in FORMATS else 0.0):
                    continue
                gain = p - self.background.loglik(run[at : at + size])
                if gain >= max(MARGIN_ALL, MARGIN * size):
                    out.append((size, gain, k))
        return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, each leftmost and non-overlapping for itself, by start, then kind as listed."""
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def starts(run: str, heads: tuple[str, ...]) -> list[int]:
    """The places of a run from which tokens are scored: its start, those after = / or ., and those of the formats' heads."""
    at = {0, *(m.end() for m in JOINT.finditer(run))}
    for head in heads:
        i = run.find(head)
        while i >= 0:
            at.add(i)
            i = run.find(head, i + 1)
    return sorted(x for x in at if len(run) - x >= 16)


def find(text: str, grammar: Grammar | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start. A run of token characters is scored as a whole, and from every feasible start to
    every feasible end: its own, and those before = / or . further on. Of the tokens that overlap the best by its
    advantage stays. A candidate that overlaps a base span adds nothing."""
    base = base_spans(text)
    added = []
    for m in CANDIDATE.finditer(text) if grammar else ():
        run = m[0].rstrip(".=")
        if len(run) < 16:
            continue
        found = []
        for i in starts(run, grammar.heads):
            for size, gain, kind in grammar.prefixes(run, i):
                s, e = m.start() + i, m.start() + i + size
                if not any(x < e and s < y for x, y, _ in base):
                    found.append((-gain, s, e, kind))
        taken = []
        for _, s, e, kind in sorted(found):
            if not any(x < e and s < y for x, y, _ in taken):
                taken.append((s, e, kind))
        added += taken
    return base, sorted([*base, *added], key=lambda x: x[0]) if added else base


def drawn(seed: int = 11) -> dict[str, list[str]]:
    """Labelled credentials of the public formats, drawn at random from a fixed seed."""
    rng = random.Random(seed)
    return {k: [head + "".join(rng.choices(body, k=rng.choice(sizes))) for _ in range(DRAWN)] for k, (head, body, sizes) in FORMATS.items()}


_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""


def train(docs: DataFrame) -> Grammar:
    """Automata of the public formats, and one of the values that assignments in the corpus label as credentials: of the
    distinct values, SAMPLE_VALUES with the least hashes. The background are words of SAMPLE_DOCS documents chosen
    likewise, 2,000 characters of each at a hashed place."""
    texts = docs.where(F.col("text").isNotNull()).select("text")
    share = lambda h, most, n: F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(3.0 * most / max(1, n))  # noqa: E731  so a task sends a few rows
    values = texts.where(F.col("text").rlike(_ASSIGN)).select(F.explode(F.regexp_extract_all("text", F.lit(_ASSIGN), 1)).alias("v")).where(F.length("v") <= 256).distinct()
    values = materialize(values, "values")
    h = F.xxhash64("v")
    found = [r[0] for r in values.where(share(h, SAMPLE_VALUES, values.count())).orderBy(h, "v").limit(SAMPLE_VALUES).collect()]
    drop_table(values)
    h = F.xxhash64("text")
    some = texts.where(share(h, SAMPLE_DOCS, docs.count())).where(~F.col("text").rlike(_ASSIGN) & (F.length("text") > 0))
    plain = some.select(F.substr("text", (F.pmod(h, F.greatest(F.length("text") - 1999, F.lit(1))) + 1).cast("int"), F.lit(2000)).alias("t"), h.alias("h"))
    words = [w for r in plain.orderBy("h", "t").limit(SAMPLE_DOCS).collect() for w in re.findall(r"[A-Za-z0-9+/_.=-]+", r[0])]
    return Grammar(drawn() | {"corpus": found}, words)


def scan(docs: DataFrame, grammar: Grammar | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added for each row of docs.

    Spans read kind:start:end in code points, end exclusive, by start, joined by commas; base_sha256 is the lower-case hex
    SHA-256 of the base spans alone. Null text counts as empty: no spans, the digest of the empty string. Repeated rows get
    equal results; whole texts are read whatever their length.
    """
    shared = send(docs.sparkSession, grammar)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]

    def run(batches):
        join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        known = shared()
        for b in batches:
            out = [[] for _ in names[1:]]
            for raw in utf8(b.column(1)):
                base, spans = find((raw or b"").decode(), known)
                kinds = Counter(k for _, _, k in base)
                for column, x in zip(out, (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(spans), len(spans) - len(base))):
                    column.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, types))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def op2_secret_grammar(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
