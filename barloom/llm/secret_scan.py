"""Secret scans: fixed credential patterns, and probabilistic automata inferred from the credentials they find.

Base kinds (leftmost non-overlapping, failing matches dropped): ``assign`` is a key word, a colon or equals sign and a value of 6 or more
characters; ``access`` is AKIA and capitals or digits, 20 or more in all; ``hex`` is 24 or more lower-case hexadecimal digits.

Method. Spark gathers the distinct base credentials of all documents; ``EXAMPLES`` of each kind, of ``LONGEST`` characters at most and of the least
hashes, label the fit (these two bound the fit only). Each becomes a string of character classes. Per kind, a prefix tree of the strings is merged:
first states of the same depth, the most visited first, where all their frequencies and those of what follows agree within Hoeffding's bound; then, with
the counts so gathered, states of any depth, which makes loops of what varies in length. How wide the bound is, and whether depths are merged at
all, is chosen by the likelihood of examples left out in turn, of which ``CHOOSE`` characters at about most are taken for this. So formats of a fixed length or prefix keep a state for each place.

Candidates are all stretches of runs of characters that an ``assign`` value may have, from the run's start or behind a mark (``=``, ``/``, ``.``) to its end
or before one; base spans are candidates too. All are scored in one pass over the run: of stretches that reach the same state at the same place
the longest stands for all. A candidate's score is its log-probability under the automaton less that under the ordinary text of the documents, a chain of pairs
of classes that Spark counts over all texts, per symbol. It has the format if the kind has all its symbols and the automaton may end there, its log-probability is within ``TYPICAL`` standard
deviations of what the states that it passes give on average, and the score is above 0. Of these the longest that do not overlap are reported as spans of kind
``format`` where no base span overlaps them.

Cases: a null text counts as empty: no spans, no score, and the digest of the empty string. Without examples of a kind there is no automaton of it.
Positions are code points, ends exclusive. Repeated rows are scanned each; other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import discard, lean, materialize, table

EXAMPLES, LONGEST, ALPHAS, FOLDS, CHOOSE, REMEMBER = 1000, 1024, (0.05, 0.001), 4, 12_000, 100_000
PRIOR, NEVER, TYPICAL = 0.5, -20.0, 3.0
KINDS = ("assign", "access", "hex")
# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the longest run from the first AKIA: shorter ones fail
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: shorter ones fail
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE, MARKS = re.compile(r"[A-Za-z0-9+/_.=-]+"), "=/."
_CLASS = {c: k for k, chars in {"d": "0123456789", "a": "abcdef", "l": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in chars}

#: Classes by number; 0 is the outside of runs.
SYMBOLS = " dalAU+/_.=-"
_NUMBER = np.zeros(256, np.int64)
_NUMBER[[ord(c) for c in (*_CLASS, *"+/_.=-")]] = [SYMBOLS.index(_CLASS.get(c, c)) for c in (*_CLASS, *"+/_.=-")]

Span = tuple[int, int, str]


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) by start, then kind as listed."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]))) if len(out) > 1 else out


def shape(value: str) -> str:
    return "".join(_CLASS.get(c, c) for c in value)


class Automaton:
    """States with how often each was visited, ended in, and left by each symbol; and what they give on average. ``alpha`` None: only states of one depth are merged."""

    def __init__(self, strings: list[str], alpha: float | None = None) -> None:
        self.visits, self.ends, self.out, self.depth = [0], [0], [{}], [0]
        for s in strings:
            q = 0
            self.visits[0] += 1
            for c in s:
                if c not in self.out[q]:
                    self.out[q][c] = len(self.out)
                    self.visits.append(0), self.ends.append(0), self.out.append({}), self.depth.append(self.depth[q] + 1)
                q = self.out[q][c]
                self.visits[q] += 1
            self.ends[q] += 1
        self.uses = [{c: self.visits[t] for c, t in o.items()} for o in self.out]
        self.into = list(range(len(self.out)))
        self._bound = math.sqrt(0.5 * math.log(2 / (alpha or ALPHAS[0])))
        self._merge(same_depth=True)
        if alpha is not None:
            self._merge(same_depth=False)
        self.out = [{c: self._now(t) for c, t in o.items()} for o in self.out]
        self.least = min(map(len, strings))
        self._smooth(Counter(c for s in strings for c in s))

    def _smooth(self, symbols: Counter) -> None:
        """Log-probabilities, targets and moments of every state; a symbol of the kind that a state never saw goes its most used way, at a small chance."""
        every = sum(symbols.values()) + self.visits[0]
        self.chance, self.end, self.to, self.mean, self.variance = [], [], [], [], []
        for q, uses in enumerate(self.uses):
            if q and self.into[q] != q:  # no way leads there any more
                for of, none in ((self.chance, {}), (self.end, 0.0), (self.to, {}), (self.mean, 0.0), (self.variance, 0.0)):
                    of.append(none)
                continue
            n = self.visits[q] + PRIOR
            main = max(uses, key=lambda c: (uses[c], c), default=None)
            self.to.append({c: self.out[q].get(c, self.out[q][main]) for c in symbols} if main else {})
            self.chance.append({c: math.log((uses.get(c, 0) + PRIOR * k / every) / n) for c, k in symbols.items()})
            self.end.append(math.log((self.ends[q] + PRIOR * self.visits[0] / every) / n))
            logs = [*self.chance[q].values(), self.end[q]]
            self.mean.append(sum(x * math.exp(x) for x in logs))
            self.variance.append(max(0.0, sum(x * x * math.exp(x) for x in logs) - self.mean[q] ** 2))

    def _differ(self, p: int, q: int) -> bool:
        """Whether the shares of ends or of a symbol differ by more than Hoeffding's bound."""
        n, m, u, v = self.visits[p], self.visits[q], self.uses[p], self.uses[q]
        most = self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if abs(self.ends[p] / n - self.ends[q] / m) > most:
            return True
        if most >= 1:
            return False
        for c, a in u.items():
            if abs(a / n - v.get(c, 0) / m) > most:
                return True
        return any(b / m > most for c, b in v.items() if c not in u)

    def _now(self, q: int) -> int:
        """The state that q has become."""
        into = self.into
        while into[q] != q:
            into[q] = q = into[into[q]]
        return q

    def _compatible(self, p: int, q: int, never: set[tuple[int, int]]) -> bool:
        """Whether p and q and all that follow them agree. Pairs that lead to one that does not are added to ``never``, so that no way is gone twice."""
        todo, came = [(p, q, None)], {}
        while todo:
            p, q, before = todo.pop()
            pair = p, q = self._now(p), self._now(q)
            if p == q or pair in came:
                continue
            came[pair] = before
            if pair in never or self._differ(p, q):
                while pair is not None:
                    never.add(pair)
                    pair = came[pair]
                return False
            todo += [(t, self.out[q][c], pair) for c, t in self.out[p].items() if c in self.out[q]]
        return True

    def _unite(self, p: int, q: int) -> tuple[list[int], list[int]]:
        """Make one state of p and q, and of what then follows by the same symbol; the states that went into others, and those that grew."""
        todo, gone, grown = [(p, q)], [], []
        while todo:
            p, q = map(self._now, todo.pop())
            if p == q:
                continue
            gone.append(q), grown.append(p)
            self.into[q] = p
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for c, t in self.out[q].items():
                self.uses[p][c] = self.uses[p].get(c, 0) + self.uses[q][c]
                todo += [(self.out[p][c], t)] if c in self.out[p] else []
                self.out[p].setdefault(c, t)
        return gone, grown

    def _merge(self, same_depth: bool) -> None:
        """Red states stay; of their other children the shallowest and most visited is united with the first compatible red one or turns red.

        The other children wait in a heap. One that grows is put there again, and entries that are out of date are passed over.
        """
        red: dict[int, list[int]] = defaultdict(list)
        known, blue, waiting, never = set(), set(), [], set()

        def wait(t: int) -> None:
            blue.add(t)
            heapq.heappush(waiting, (self.depth[t], -self.visits[t], t))

        def turn(t: int) -> None:
            known.add(t)
            red[self.depth[t] if same_depth else 0].append(t)
            children(t)

        def children(t: int) -> None:
            for x in {self._now(x) for x in self.out[t].values()} - known:
                wait(x)

        turn(0)
        while waiting:
            depth, visits, t = heapq.heappop(waiting)
            if self.into[t] != t or t in known or -visits != self.visits[t]:
                continue
            mine = red[depth if same_depth else 0]
            r = next((r for r in mine if self._compatible(r, t, never)), None)
            if r is None:
                turn(t)
                continue
            gone, grown = self._unite(r, t)
            never.clear()
            if known.intersection(gone):  # loops may take red states along; what took them is red in their place
                mine[:] = dict.fromkeys(map(self._now, mine))
                known = {self._now(q) for q in known}
            blue.update(self._now(q) for q in gone if q in blue)
            for q in {self._now(q) for q in grown}:
                children(q) if q in known else wait(q) if q in blue else None

    def likelihood(self, s: str) -> float:
        """The log-probability of a string; a symbol or a length that the kind never had costs as much as ``NEVER``."""
        q, out = 0, 0.0
        for c in s:
            out += self.chance[q].get(c, NEVER)
            q = self.to[q].get(c, q)
        return out + (self.end[q] if self.ends[q] else NEVER)

    def scan(self, form: str, ordinary: Background) -> list[tuple[int, int, float, bool]]:
        """(start, end, score, whether it has the format) of the candidates of a run's classes that the automaton takes."""
        found, active, before = [], {}, ordinary.sums(form)
        for i in range(len(form) + 1):
            c = form[i] if i < len(form) else "="
            if i and c in MARKS and (form[i - 1] not in MARKS or i == len(form)):
                for q, (start, total, mean, variance) in active.items():
                    if self.ends[q]:
                        total, away = total + self.end[q], total + self.end[q] - mean - self.mean[q]
                        score = (total - ordinary.between(form, before, start, i)) / (i - start + 1)
                        found.append((start, i, score, score > 0 and abs(away) <= TYPICAL * math.sqrt(variance + self.variance[q]) + 0.5))
            if i == len(form):
                break
            if (i == 0 or form[i - 1] in MARKS) and 0 not in active:
                active[0] = (i, 0.0, 0.0, 0.0)
            moved: dict = {}
            for q, (start, total, mean, variance) in active.items():
                t = self.to[q].get(c)
                if t is not None and (t not in moved or start < moved[t][0]):
                    moved[t] = (start, total + self.chance[q][c], mean + self.mean[q], variance + self.variance[q])
            active = moved
        return found

    def accepts(self, form: str, ordinary: Background) -> bool:
        return any(ok and (a, b) == (0, len(form)) for a, b, _, ok in self.scan(form, ordinary))


def learn(strings: list[str]) -> Automaton:
    """The automaton of strings of classes whose way of merging gives left-out strings most likelihood; the most specific on a tie."""
    strings = sorted(strings)
    some = strings[:: -(-sum(map(len, strings)) // CHOOSE) or 1]

    def held_out(alpha: float | None) -> float:
        folds = [some[k::FOLDS] for k in range(FOLDS)]
        rests = [[s for j, f in enumerate(folds) if j != k for s in f] for k in range(FOLDS)]
        return sum(a.likelihood(s) for fold, rest in zip(folds, rests, strict=True) if fold and rest for a in [Automaton(rest, alpha)] for s in fold)

    # a million small tables hold no cycles that a collector could find
    collects = gc.isenabled()
    gc.disable()
    try:
        return Automaton(strings, max([None, *ALPHAS], key=held_out) if len(strings) > 1 else None)
    finally:
        if collects:
            gc.enable()


class Background:
    """Ordinary runs as a chain of pairs of classes; ``counts`` of pairs over all texts, the outside of runs counting as a class."""

    def __init__(self, counts: np.ndarray | None = None) -> None:
        n = (np.zeros((len(SYMBOLS), len(SYMBOLS))) if counts is None else counts.reshape(len(SYMBOLS), -1)) + 0.5
        n[0, 0] = 0.5
        self.logs = np.log(n / n.sum(axis=1, keepdims=True)).tolist()
        self.number = {c: k for k, c in enumerate(SYMBOLS)}

    def sums(self, form: str) -> list[float]:
        out, total, last = [0.0], 0.0, None
        for c in form:
            k = self.number[c]
            total += self.logs[last][k] if last is not None else 0.0
            out.append(total)
            last = k
        return out

    def between(self, form: str, sums: list[float], start: int, end: int) -> float:
        """The log-probability of form[start:end] as a run of its own."""
        return self.logs[0][self.number[form[start]]] + sums[end] - sums[start + 1] + self.logs[self.number[form[end - 1]]][0]


class Formats:
    """What a scan needs: the automata by kind and the ordinary text. A plain value that tasks receive."""

    def __init__(self, automata: dict[str, Automaton], ordinary: Background) -> None:
        self.automata, self.ordinary = automata, ordinary
        self.least = min((a.least for a in automata.values()), default=None)
        self.memory: dict[str, list] = {}

    def candidates(self, run: str) -> list[tuple[int, int, float, bool]]:
        """(start, end, score, whether it has a format) of the run's candidates, the longest first."""
        form = shape(run)
        found = self.memory.get(form)
        if found is None:
            best: dict = {}
            for a in self.automata.values():
                for start, end, score, ok in a.scan(form, self.ordinary):
                    if end - start >= self.least and (start, end) not in best or best.get((start, end), (0, True)) < (score, ok):
                        best[start, end] = (score, ok)
            found = sorted(((s, e, *v) for (s, e), v in best.items()), key=lambda x: (x[0] - x[1], x))
            if len(self.memory) >= REMEMBER:
                self.memory.clear()
            if len(form) < 256:
                self.memory[form] = found
        return found


def _gather(docs: DataFrame) -> DataFrame:
    """(kind, value, n): the base credentials, and the counts of pairs of classes as kind ``pair``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = np.zeros(len(SYMBOLS) ** 2, np.int64), len(SYMBOLS)
        for b in batches:
            found = sorted({(k, v) for t in b.column("text").to_pylist() if t for _, _, k, v in base_spans(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array([1] * len(found), pa.int64())], ["kind", "value", "n"])
            for _, data, at in ta.chunks(b.column("text")):
                k = np.concatenate([[0], _NUMBER[data], [0]])
                pairs += np.bincount(k[:-1] * size + k[1:], minlength=size * size)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(some), pa.string()), pa.array([str(x) for x in some], pa.string()), pa.array(pairs[some])], ["kind", "value", "n"])

    return docs.select("text").mapInArrow(lean(of), "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def infer(docs: DataFrame, examples: int = EXAMPLES) -> Formats:
    """The formats of the base credentials of ``docs``; at most ``examples`` of a kind, and the counts of pairs of classes, reach the driver."""
    values = materialize(_gather(docs), "secret-credentials")
    taken = values.where("kind = 'pair'").select("kind", "value", "n")
    for kind in KINDS:
        taken = taken.unionByName(values.where((F.col("kind") == kind) & (F.length("value") <= LONGEST)).orderBy(F.xxhash64("value"), "value").limit(examples))
    by, pairs = defaultdict(list), np.zeros(len(SYMBOLS) ** 2)
    for r in taken.collect():
        if r.kind == "pair":
            pairs[int(r.value)] = r.n
        else:
            by[r.kind].append(shape(r.value))
    discard(values)
    return Formats({k: learn(v) for k, v in by.items()}, Background(pairs))


def all_spans(text: str, formats: Formats) -> tuple[list, list[Span], float | None]:
    """Base spans, all spans by start, and the best score of a candidate."""
    base = base_spans(text)
    spans, best = [s[:3] for s in base], None
    if formats.automata:
        for m in CANDIDATE.finditer(text):
            if m.end() - m.start() < formats.least:
                continue
            taken = [s[:2] for s in base if s[0] < m.end() and m.start() < s[1]]
            for a, b, score, ok in formats.candidates(m[0]):
                start, end = m.start() + a, m.start() + b
                best = score if best is None else max(best, score)
                if ok and not any(s < end and start < e for s, e in taken):
                    spans.append((start, end, "format"))
                    taken.append((start, end))
    return base, sorted(spans, key=lambda s: (s[0], (*KINDS, "format").index(s[2]))), best


def listed(spans: list) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, score) for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, spans, score = {k: [] for k in KINDS}, [], [], []
            for t in b.column("text").to_pylist():
                base, found, best = all_spans(t or "", formats)
                count = Counter(s[2] for s in base)
                for k in KINDS:
                    n[k].append(count[k])
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(found))
                score.append(best)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(of), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, score double")


def redacted(text: str, spans: list, mark: str) -> str:
    out, at = [], 0
    for start, end, *_ in spans:
        if end > at:
            out += [text[at : max(at, start)], mark] if start >= at else []
            at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, formats: Formats, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all their columns, with every span replaced by ``mark``; n_chars, where there is one, follows the text."""
    schema = docs.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, length = b.column("text").to_pylist(), b.column("n_chars").to_pylist() if "n_chars" in b.schema.names else None
            for i, t in enumerate(texts):
                spans = all_spans(t, formats)[1] if t else []
                if spans:
                    texts[i] = redacted(t, spans, mark)
                    if length:
                        length[i] = len(texts[i])
            columns = dict(zip(b.schema.names, b.columns, strict=True)) | {"text": pa.array(texts, b.schema.field("text").type)}
            if length is not None:
                columns["n_chars"] = pa.array(length, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(lean(of), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, infer(docs))
