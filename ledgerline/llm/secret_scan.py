"""Secret scans: fixed patterns, and formats learnt by grammar inference.

Base patterns give spans of three kinds. Candidates are all runs of ``A-Z a-z 0-9 + / _ . = -``, and their pieces between ``=`` and between ``= / . +``, each also without
dots and dashes at its end; they are scored by probabilistic automata.
Each automaton is inferred from labelled credentials of one format: their prefix tree is built with counts and, in breadth-first order, states are
merged whose frequencies (of ending, of each next symbol, and of kinds of characters, recursively) differ by no more than Hoeffding's bound allows. In the tree a character is a
symbol of its own where a fifth of the examples there have it, and ``.`` and ``=`` always; all others are one symbol, with frequencies of capitals, hex
letters, other letters, digits and punctuation within it. So a tree isn't split into thin branches by random characters, and counts stay large enough to tell states of different
lengths apart. An automaton of credentials gives a string nothing that leaves its transitions or ends where no example does: length counts. The
labelled examples that aren't credentials (words, identifiers, numbers, paths) give an automaton of the same sort, smoothed. A candidate's
score is its log-likelihood under the best credential automaton less that under the other, per character; the threshold lies where it splits held-out
examples best. What passes is a span of kind ``format``, unless it lies within a base span or a longer one.

All candidates are scored; the ones that no automaton can accept leave the computation at the first character that shows it. The examples are drawn by rule from a fixed seed,
so training takes a bounded time on the driver and its result is small. Documents are scanned in slices of 1 MB, whole texts, with no shuffle.

Defined results: null counts as empty and has no spans; spans are in code points, end exclusive; repeated rows and rows with a null or repeated id are each scanned; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import slices
from .tables import only, table

KINDS = ("assign", "access", "hex", "format")
WORD = 16  # characters of the shortest example that is no credential
SEED = 7
EXAMPLES = 400


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_HEX = np.zeros(256, dtype=bool)  # [0-9a-f]+ is greedy: its matches are the maximal runs
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.=-"]] = True


_ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
_PLACE = np.full(256, -1, dtype=np.int64)
_PLACE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_PIECE, _PART = _RUN.copy(), _RUN.copy()
_PIECE[ord("=")] = False
_PART[[ord(c) for c in "=/.+"]] = False
_CLASSES = (string.ascii_uppercase, "abcdef", "ghijklmnopqrstuvwxyz", string.digits, "+/_-")
_CLASS_OF = {c: k for k, some in enumerate(_CLASSES) for c in some}
_SIZES = np.array([len(x) for x in _CLASSES], dtype=float)
OTHER = len(_ALPHABET)  # the symbol of a character that is none of its own
SHARE = 0.2
NEVER = -1e6


def examples(seed: int = SEED, each: int = EXAMPLES) -> dict[str, list[str]]:
    """Labelled strings by format; under ``none`` those that are no credentials."""
    rng = random.Random(seed)

    def some(alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high or low)))

    alnum, upper, b64 = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/"
    made = {
        "access": lambda: "AKIA" + some(upper, 16),
        "personal": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + some(alnum, 36),
        "payment": lambda: rng.choice(("sk_live_", "sk_test_", "rk_live_")) + some(alnum, 24),
        "chat": lambda: "xoxb-" + some(string.digits, 11) + "-" + some(string.digits, 11) + "-" + some(alnum, 24),
        "cloud": lambda: "AIza" + some(alnum + "-_", 35),
        "signed": lambda: "eyJ" + some(alnum + "-_", 20, 40) + ".eyJ" + some(alnum + "-_", 30, 60) + "." + some(alnum + "-_", 43),
        "digest": lambda: some("0123456789abcdef", rng.choice((32, 40, 64))),
        "secret": lambda: some(b64, 40),
    }
    vowels, others = "aeiou", "bcdfghklmnprstvwz"

    def word() -> str:
        return "".join(rng.choice((*others, "", "", "", "sh", "th", "st")) + rng.choice(vowels) + rng.choice((*"nsrlt", "", "th", "nd")) for _ in range(rng.randint(1, 4)))

    def long_word() -> str:
        out = word()
        while len(out) < WORD:
            out += word()
        return out

    plain = (
        long_word,
        lambda: long_word().upper(),
        lambda: long_word().capitalize(),
        lambda: rng.choice("_-./=").join(word() for _ in range(rng.randint(4, 7))),
        lambda: long_word() + ".",
        lambda: some("=-_.", 1) * rng.randint(16, 60),
        lambda: some(string.digits, 16, 20),
        lambda: "/".join([word(), word(), word(), some(string.digits, 1, 4)]) + ".html",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}-{long_word()}",
        lambda: "".join(word().capitalize() for _ in range(4)),
    )
    out = {name: [make() for _ in range(each)] for name, make in made.items()}
    out["none"] = [x for _ in range(each) for make in plain if len(x := make()) >= WORD]
    return out


class Automaton:
    """A probabilistic deterministic automaton inferred from strings by merging compatible states of their prefix tree."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.ends: list[int] = []
        self.arrivals: list[int] = []
        self.next: list[dict[int, int]] = []
        self.counts: list[dict[int, int]] = []  # of symbols
        self.kinds: list[np.ndarray] = []  # of the classes of characters within the symbol OTHER
        self._grow(strings)
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))

    def _grow(self, strings: list[str]) -> None:
        todo = [(self._state(), strings, 0)]
        while todo:
            state, some, depth = todo.pop()
            self.arrivals[state] = len(some)
            after: dict[int, list[str]] = {}
            here = Counter(x[depth] for x in some if len(x) > depth)
            for x in some:
                if len(x) == depth:
                    self.ends[state] += 1
                    continue
                c = x[depth]
                own = c not in _CLASS_OF or (here[c] >= SHARE * len(some) and here[c] >= 20)
                if not own:
                    self.kinds[state][_CLASS_OF[c]] += 1
                after.setdefault(_ALPHABET.index(c) if own else OTHER, []).append(x)
            for s, rest in after.items():
                self.counts[state][s] = len(rest)
                self.next[state][s] = self._state()
                todo.append((self.next[state][s], rest, depth + 1))

    def _state(self) -> int:
        self.ends.append(0)
        self.arrivals.append(0)
        self.next.append({})
        self.counts.append({})
        self.kinds.append(np.zeros(len(_CLASSES)))
        return len(self.ends) - 1

    def _merge(self, width: float) -> None:
        red, blue = [0], sorted(self.next[0].values())
        parent = {t: (0, s) for s, t in self.next[0].items()}
        while blue:
            state = blue.pop(0)
            for kept in red:
                if self._alike(kept, state, width):
                    self.next[parent[state][0]][parent[state][1]] = kept
                    self._fold(kept, state)
                    break
            else:
                red.append(state)
            known, fringe = set(red), {}
            for r in red:
                for s, t in self.next[r].items():
                    if t not in known:
                        fringe[t], parent[t] = True, (r, s)
            blue = sorted(fringe)
        self.states = red

    def _alike(self, a: int, b: int, width: float) -> bool:
        """Whether no frequency below the two states differs by more than Hoeffding's bound."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            n, m = self.arrivals[a], self.arrivals[b]
            if not n or not m or (a, b) in seen:
                continue
            seen.add((a, b))
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound or (np.abs(self.kinds[a] / n - self.kinds[b] / m) > bound).any():
                return False
            for s in self.counts[a].keys() | self.counts[b].keys():
                if abs(self.counts[a].get(s, 0) / n - self.counts[b].get(s, 0) / m) > bound:
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to what lies below ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.arrivals[a] += self.arrivals[b]
            self.ends[a] += self.ends[b]
            self.kinds[a] = self.kinds[a] + self.kinds[b]
            for s, n in self.counts[b].items():
                self.counts[a][s] = self.counts[a].get(s, 0) + n
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t

    def arrays(self, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next states, log probabilities of characters, and of ending. The last state takes what no example has: ``strict`` allows nothing of it."""
        place = {s: i for i, s in enumerate(self.states)}
        n, k = len(self.states) + 1, len(_ALPHABET)
        step = np.full((n, k), n - 1)
        log, end = np.full((n, k), NEVER if strict else math.log(1 / (k + 1))), np.full(n, NEVER if strict else math.log(1 / (k + 1)))
        for state, i in place.items():
            total = self.arrivals[state] + (0.0 if strict else 0.5 * (k + 1))
            if not strict:
                log[i] = math.log(0.5 / total)
            ends = self.ends[state] + (0.0 if strict else 0.5)
            if ends:
                end[i] = math.log(ends / total)
            kinds = (self.kinds[state] + 0.5) / (self.kinds[state].sum() + 0.5 * len(_CLASSES)) / _SIZES
            for s, c in self.counts[state].items():
                to = place.get(self.next[state].get(s, -1), n - 1)
                for x, p in ((s, 1.0),) if s != OTHER else ((_ALPHABET.index(ch), kinds[cl]) for ch, cl in _CLASS_OF.items() if _ALPHABET.index(ch) not in self.counts[state]):
                    log[i, x], step[i, x] = math.log((c + (0.0 if strict else 0.5)) * p / total), to
        return step, log, end


class Formats:
    """All automata side by side, and the threshold."""

    def __init__(self, seed: int = SEED):
        train, held = examples(seed), examples(seed + 1, 100)
        steps, logs, ends, self.starts, self.names, at = [], [], [], [], [], 0
        for name, strings in train.items():
            step, log, end = Automaton(strings).arrays(strict=name != "none")
            steps.append(step + at)
            logs.append(log)
            ends.append(end)
            self.starts.append(at)
            self.names.append(name)
            at += len(step)
        self.step, self.log, self.end = np.concatenate(steps), np.concatenate(logs), np.concatenate(ends)
        self.shortest = min(self._shortest(s) for n, s in zip(self.names, self.starts, strict=True) if n != "none")
        good = np.sort(self.scores([x for name, s in held.items() if name != "none" for x in s]))
        bad = np.sort(self.scores(held["none"]))
        cuts = np.unique(np.concatenate((good, bad, [0.0])))
        cuts = cuts[cuts >= 0]  # a candidate has to be likelier as a credential than as something else
        wrong = np.searchsorted(good, cuts) / len(good) + 3 * (1 - np.searchsorted(bad, cuts, side="right") / len(bad))
        self.threshold = float(cuts[np.flatnonzero(wrong <= wrong.min() + 1e-12)[0]])

    def _shortest(self, start: int) -> int:
        """The length of the shortest string that an automaton accepts."""
        edge, known, n = {start}, {start}, 0
        while edge:
            if any(self.end[x] > NEVER for x in edge):
                return n
            edge = {int(t) for x in edge for t in self.step[x][self.log[x] > NEVER]} - known
            known |= edge
            n += 1
        return 1 << 62

    def scores(self, candidates: list[str]) -> np.ndarray:
        joined = "\0".join(candidates).encode()
        lengths = np.array([len(c) for c in candidates], dtype=np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        return self.span_scores(np.frombuffer(joined, dtype=np.uint8), begins, begins + lengths)

    def span_scores(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-likelihood per character of the best credential automaton less that of the other one, of spans of bytes. A span leaves when all automata are at an end with it."""
        none = self.names.index("none")
        out = np.full(len(start), float(NEVER))
        own = np.flatnonzero(end - start >= self.shortest)  # no automaton accepts a shorter one
        state = np.tile(np.array(self.starts), (len(own), 1))
        total = np.zeros(state.shape)
        j = 0
        while len(own):
            done = start[own] + j == end[own]
            if done.any():
                last = (total[done] + self.end[state[done]]) / (j + 1)
                out[own[done]] = np.delete(last, none, axis=1).max(axis=1) - last[:, none]
            place = np.full(len(own), -1)
            place[~done] = _PLACE[buf[start[own[~done]] + j]]
            own, state, total, place = (x[~done] for x in (own, state, total, place))
            total += self.log[state, place[:, None]]
            state = self.step[state, place[:, None]]
            alive = (np.delete(total, none, axis=1) > NEVER / 2).any(axis=1)
            own, state, total = own[alive], state[alive], total[alive]
            j += 1
        return out


@cache
def formats(seed: int = SEED) -> Formats:
    return Formats(seed)


def _edges(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside[buf], [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def _candidates(buf: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs and pieces of runs, also without dots and dashes at their end; those shorter than any automaton accepts are left out at once."""
    found = [_edges(buf, inside) for inside in (_RUN, _PIECE, _PART)]
    start, end = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    long = end - start >= shortest
    start, end = start[long], end[long]
    cut = end.copy()
    while True:
        more = (cut > start) & np.isin(buf[cut - 1], (ord("."), ord("-")))
        if not more.any():
            break
        cut[more] -= 1
    both = np.stack((np.concatenate((start, start)), np.concatenate((end, cut))), axis=1)
    both = np.unique(both[both[:, 0] < both[:, 1]], axis=0)
    return both[:, 0], both[:, 1]


def base_spans(text: str, data: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three base kinds; ``hexes`` are the runs of hex digits."""
    found = [(a, b, 2) for a, b in hexes]
    lowered = data.lower()
    if any(w in lowered for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if b"AKIA" in data:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found


def scan(texts: list[bytes], learnt: Formats) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all its spans, by start and then kind."""
    buf = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    start, end = _candidates(buf, learnt.shortest)
    passed = learnt.span_scores(buf, start, end) > learnt.threshold
    formats_ = _by_text(start[passed], end[passed], begins)
    start, end = _edges(buf, _HEX)
    long = end - start >= 16
    hexes = _by_text(start[long], end[long], begins)
    out = []
    for i, data in enumerate(texts):
        text = data.decode()
        own, digits = formats_.get(i, []), hexes.get(i, [])
        if (own or digits) and len(text) != len(data):  # from bytes to code points
            points = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
            own, digits = ([(int(points[a]) - 1, int(points[a]) - 1 + b - a) for a, b in x] for x in (own, digits))
        base = sorted(base_spans(text, data, digits), key=lambda s: (s[0], s[2]))
        extra, reach = [], -1
        for a, b in sorted(own, key=lambda s: (s[0], -s[1])):
            if a >= reach and not any(s <= a and b <= e for s, e, _ in base):
                extra.append((a, b, 3))
                reach = b
        out.append((base, sorted(base + extra, key=lambda s: (s[0], s[2]))))
    return out


def _by_text(start: np.ndarray, end: np.ndarray, begins: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in zip((np.searchsorted(begins, start, side="right") - 1).tolist(), start.tolist(), end.tolist(), strict=True):
        out.setdefault(i, []).append((a - int(begins[i]), b - int(begins[i])))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _run(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = formats(seed)
        for part, texts in slices(batches, "text"):
            found = scan(texts, learnt)
            counts = [[sum(k == kind for _, _, k in base) for base, _ in found] for kind in range(3)]
            digest = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found]
            spans = [_written(every) for _, every in found]
            columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_spans(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_run(seed), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
