"""Secrets in texts: patterns for the plain kinds, and a character convolutional
network over every candidate and what surrounds it.

Base kinds are `assign`, `access` and `hex`; their matches always stay, and the
network's score of their values goes with them. Further
candidates are runs of 16 or more key characters that no base match contains: a
run that one only touches is scored as a whole, but for a leading name and `=`.
The network (numpy) sees each whole candidate in windows, with the characters
before and after it, and gives a probability; those at or over the threshold of
their alphabet are spans of kind `learned`. It is trained on labelled findings
that are generated from a fixed seed, as many secrets as benign ones of every
alphabet, calibrated on held-out ones, and reported on others. Each alphabet's
threshold keeps RECALL of the held-out secrets at least: it is the largest that does,
or where benign ones all score lower, halfway (in log odds) between both. Secrets
of letters alone mix cases: random letters of one case are not told from words,
so these are benign findings, as headings and compounds of any language.

Null texts count as empty and have no spans. Spans are in code points, end
exclusive, ordered by start and then kind. Repeated rows stay repeated; an empty
table gives an empty table; columns other than doc_id and text are not read by
the scan, and redaction leaves all others as they are.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import column_udf, id_and_text, map_rows

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Runs as a whole, so that shorter ones drop out by their length alone.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: The name before a value within a run.
NAME = re.compile(r"[A-Za-z_-]{1,15}=+")
ASSIGN_LEAST = 12
SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"

#: A window: characters before the candidate, of it, and after it.
BEFORE, INSIDE, AFTER = 24, 40, 8
WINDOW, STEP = BEFORE + INSIDE + AFTER, 32
WIDTH, FILTERS = 5, 24
RECALL = 0.98
_MARKS = "0 \n\"'=:;,.-_/+@()<>{}[]#$%&*!?|"
_SIGNS = 2 + 52 + len(_MARKS)  # nothing, anything else, letters, marks; digits are one


@functools.cache
def _sign_table() -> np.ndarray:
    table = np.ones(128, np.int64)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + _MARKS, 2):
        table[ord(c)] = i
    table[ord("0") : ord("9") + 1] = table[ord("0")]
    return table


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base matches."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches."""
    return [m[:3] for m in base_matches(text)]


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that no base match contains; of those that one touches,
    what stands behind a name. base ascends by start."""
    found, live, at = [], [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] < end:
            live.append((base[at][0], base[at][2]))
            at += 1
        live = [s for s in live if s[1] > start]
        if live and (name := NAME.match(text, start, end)):
            start = name.end()
        if start < end and not any(a <= start and end <= b for a, b in live):
            found.append((start, end))
    return found


def _windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Signs of the candidate's windows; those inside it are told from those around it."""
    out = []
    for at in range(start, max(start + 1, end - INSIDE + STEP), STEP):
        stop = min(end, at + INSIDE)
        row = np.zeros(WINDOW, np.int64)
        for piece, place, inside in ((text[max(0, at - BEFORE) : at], BEFORE, 0), (text[at:stop], BEFORE + stop - at, 1), (text[stop : stop + AFTER], WINDOW, 0)):
            if piece:
                code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
                if not inside and place == WINDOW:
                    place = BEFORE + (stop - at) + len(piece)
                row[place - len(piece) : place] = np.where(code < 128, _sign_table()[np.minimum(code, 127)], 1) + inside * _SIGNS
        out.append(row)
    return out


def alphabet(candidate: str) -> int:
    """0: hexadecimal, 1: letters only, 2: other."""
    return 0 if re.fullmatch("[0-9a-fA-F]+", candidate) else 1 if candidate.isalpha() else 2


class Network:
    """One convolution over signs, maximum and mean over places, a logistic output."""

    def __init__(self, rng: np.random.Generator):
        kinds = np.repeat(np.arange(4), (2, 26, 26, _SIGNS - 54))  # letters of one case begin alike, so that changes of case are learned soon
        alike = rng.normal(0, 0.3, (WIDTH, 8, FILTERS))[:, np.concatenate([kinds, kinds + 4])]
        self.w = (alike + rng.normal(0, 0.15, (WIDTH, 2 * _SIGNS, FILTERS))).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.15, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold, self.reported = 1.0, 0.0, [0.5] * 3, []

    def _convolve(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - WIDTH + 1
        return np.maximum(sum(self.w[k][x[:, k : k + n]] for k in range(WIDTH)) + self.b, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = self._convolve(x)
        return np.concatenate([z.max(1), z.mean(1)], 1) @ self.v + self.c

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x).astype(np.float64) + self.shift, -40, 40)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = self._convolve(x)
        n, places, _ = z.shape
        best = z.argmax(1)
        pooled = np.concatenate([np.take_along_axis(z, best[:, None], 1)[:, 0], z.mean(1)], 1)
        off = (1 / (1 + np.exp(-(pooled @ self.v + self.c))) - y).astype(np.float32) / n
        dp = off[:, None] * self.v
        dz = np.repeat(dp[:, None, FILTERS:] / places, places, 1)
        dz[np.arange(n)[:, None], best, np.arange(FILTERS)] += dp[:, :FILTERS]
        dz = (dz * (z > 0)).reshape(-1, FILTERS)
        dw = np.empty_like(self.w)
        for k in range(WIDTH):
            flat = x[:, k : k + places].ravel()
            seen = np.zeros((len(flat), 2 * _SIGNS), np.float32)
            seen[np.arange(len(flat)), flat] = 1
            dw[k] = seen.T @ dz
        return [dw, dz.sum(0), off @ pooled, off.sum(keepdims=True)]

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rounds: int = 8, size: int = 128, rate: float = 0.01) -> None:
        """Adam over shuffled batches."""
        params = [self.w, self.b, self.v, self.c]
        mean, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(x), size):
                t += 1
                take = order[at : at + size]
                for p, g, m, s in zip(params, self.gradients(x[take], y[take]), mean, square):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)

    def calibrate(self, x: np.ndarray, y: np.ndarray, group: np.ndarray) -> None:
        """Logistic calibration by Newton steps, then a threshold for each alphabet."""
        z = self.logits(x).astype(np.float64)
        design, beta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
            hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            beta = beta + np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * (beta - [1.0, 0.0]))
        self.scale, self.shift = map(float, beta)
        z = self.scale * self.logits(x).astype(np.float64) + self.shift
        for g in range(3):
            secrets, benign = np.sort(z[(group == g) & (y == 1)]), np.sort(z[(group == g) & (y == 0)])
            if len(secrets) and len(benign):
                keeps, worst = secrets[int((1 - RECALL) * len(secrets))], benign[int(RECALL * len(benign))]
                at = keeps if worst >= keeps else (keeps + worst) / 2
                self.threshold[g] = float(1 / (1 + np.exp(-np.clip(at, -40, 40))))

    def report(self, x: np.ndarray, y: np.ndarray, group: np.ndarray) -> list[tuple[float, float]]:
        """Recall and precision for each alphabet."""
        accepted = self.probabilities(x) >= np.array(self.threshold)[group]
        share = lambda part, whole: float(part.sum() / max(1, whole.sum()))
        return [(share(accepted & (y == 1) & (group == g), (y == 1) & (group == g)), share(accepted & (y == 1) & (group == g), accepted & (group == g))) for g in range(3)]


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SYLLABLE_ENDS = ("", "", "n", "r", "s", "t", "st", "nd", "ng", "ch", "ll", "pf", "tz", "lch", "nth", "rst")
#: Words before values that are no secrets though they look random, and before values of any kind.
DIGEST_WORDS = ("sha1", "sha256", "md5", "commit", "checksum", "digest", "etag", "revision", "crc", "uuid", "request id")
VALUE_WORDS = ("key", "auth", "bearer", "name", "path", "id", "credential", "see")


class _Findings:
    """Generated texts with one candidate each, by alphabet and label."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def some(self, letters: str, n: int) -> str:
        return "".join(letters[i] for i in self.rng.integers(0, len(letters), n))

    def pick(self, *choices):
        return choices[self.rng.integers(len(choices))]

    def syllable(self) -> str:
        return self.some("bcdfghjklmnpqrstvwxz", int(self.rng.integers(0, 3))) + self.some("aeiou", self.pick(1, 1, 2, 3)) + self.pick(*SYLLABLE_ENDS)

    def word(self) -> str:
        return "".join(self.syllable() for _ in range(self.rng.integers(1, 5)))

    def long_word(self) -> str:
        made = ""
        while len(made) < 16 + self.rng.integers(0, 20):
            made += self.syllable()
        return made

    def rough_word(self) -> str:
        """A compound of few syllables that repeat, consonants in clusters."""
        parts = [self.some("bcdfghjklmnprstvwz", int(self.rng.integers(0, 3))) + self.some("aeiou", 1) + self.pick(*SYLLABLE_ENDS) for _ in range(4)]
        made = ""
        while len(made) < 16 + self.rng.integers(0, 12):
            made += self.pick(*parts)
        return made

    def accented(self, word: str) -> str:
        """The word, its vowels now and then with an accent."""
        return word.translate(str.maketrans("aeiou", "àéîöü")) if self.rng.integers(6) == 0 else word

    def cased(self, text: str) -> str:
        return self.pick(text, text.capitalize(), text.upper())

    def digest(self) -> str:
        made = self.some("0123456789abcdef", self.pick(16, 32, 40, 64))
        return self.pick(made, made.upper())

    def uuid(self) -> str:
        made = "-".join(self.some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        return self.pick(made, made.upper())

    def base64_words(self) -> str:
        return base64.b64encode(" ".join(self.word() for _ in range(self.rng.integers(3, 7))).encode()).decode()

    def benign(self, group: int) -> tuple[str, bool]:
        """A candidate that is no secret, and whether only its context tells."""
        if group == 0:
            unit = self.some("0123456789ABCDEF", int(self.rng.integers(1, 5)))
            runs = [unit * int(self.rng.integers(18, 40)), "0123456789ABCDEF" * int(self.rng.integers(1, 3)), self.pick("DEADBEEF", "CAFEBABE", "FFFF0000") * int(self.rng.integers(2, 5))]
            return self.pick((self.digest(), True), (self.digest().upper(), True), (self.pick(*runs), False))
        if group == 1:
            names = "".join(self.word().capitalize() for _ in range(self.rng.integers(3, 7)))
            rough = self.some(LOWER, int(self.rng.integers(16, 48)))  # of one case: no secret that is learned
            return self.pick(self.cased(self.long_word()), self.cased(self.rough_word()), self.cased(rough), names, (LOWER + self.some(LOWER, 1)).upper(), self.word() * 6), False
        return self.pick(
            (self.some("-_/", 1).join(self.word() for _ in range(self.rng.integers(3, 8))), False),
            (self.some("=-_+", 1) * int(self.rng.integers(16, 60)), False),
            ("/".join([self.word(), self.some("12", 1) + self.some(DIGITS, 3), self.some("01", 1) + self.some(DIGITS, 1), self.word(), self.word()]), False),
            ("-".join([f"20{self.some(DIGITS, 2)}", self.some(DIGITS, 2), self.some(DIGITS, 2), self.word(), self.word()]), False),
            ("-".join(self.some(DIGITS, n) for n in (3, 1, 4, 5, 6)), False),
            (self.cased(self.long_word()) + self.some(DIGITS, int(self.rng.integers(1, 5))), False),
            (self.uuid(), False),
            (self.base64_words(), False),
        )

    def secret(self, group: int) -> str:
        n = int(self.rng.integers(18, 64))
        if group == 0:
            return self.some(self.pick("0123456789ABCDEF", "0123456789ABCDEF", "0123456789abcdefABCDEF", "0123456789abcdef"), n)
        if group == 1:
            return self.some(LOWER + UPPER, n)
        return self.pick(
            self.some(LOWER + UPPER + DIGITS + "+/", n) + "=" * int(self.rng.integers(0, 3)),
            self.some(LOWER, int(self.rng.integers(2, 5))) + "_" + self.some(LOWER, 4) + "_" + self.some(LOWER + UPPER + DIGITS, n),
            self.some(LOWER + DIGITS, n),
            self.some(LOWER + UPPER + DIGITS, n),
            self.some(LOWER + UPPER + DIGITS + "-_", n),
        )

    def finding(self, group: int, label: int) -> tuple[str, int, int]:
        body, told = "", False
        while len(body) < 16 or not CANDIDATE.fullmatch(body) or alphabet(body) != group:
            body, told = (self.secret(group), False) if label else self.benign(group)
        loud, between = self.rng.integers(4) == 0, self.pick(" ", " ", ", ", "! ", "!! ", ". ", " - ")  # headings, lists
        around = lambda most: between.join(self.accented(self.word()) for _ in range(self.rng.integers(0, most)))
        lead = around(6).upper() if loud else around(6)
        if told:
            lead += self.some(" \n", 1) + self.pick(*DIGEST_WORDS) + self.pick(": ", " = ", " ", " is ")
        elif self.rng.integers(4) == 0:
            lead += self.some(" \n", 1) + self.pick(*VALUE_WORDS) + self.pick(": ", " = ", '="', " ")
        elif lead:
            lead += self.some("  \n(\"", 1)
        tail = self.pick("", ".", " ", ",", '"', "\n", "!! ") + (around(3).upper() if loud else around(3))
        if tail and CANDIDATE.match(body[-1] * 15 + tail[0]):
            tail = " " + tail
        return lead + body + tail, len(lead), len(lead) + len(body)


def labelled_findings(count: int, rng: np.random.Generator) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Generated texts with one candidate each (text, start, end) and their labels, 1
    for random keys and 0 for words, names, paths, numbers, digests, identifiers and
    encoded words; as many of each alphabet and label."""
    made = _Findings(rng)
    labels = np.arange(count) % 2
    return [made.finding(i // 2 % 3, i % 2) for i in range(count)], labels.astype(np.float32)


@functools.cache
def network(findings: int = 9000, seed: int = 7) -> Network:
    """The trained network; a fifth of the findings calibrates it, another gives its report."""
    rng = np.random.default_rng(seed)
    found, y = labelled_findings(findings, rng)
    x = np.stack([_windows(*f)[0] for f in found])
    group = np.array([alphabet(t[a:b]) for t, a, b in found])
    fit, rest = findings * 3 // 5, findings * 4 // 5
    net = Network(rng)
    net.fit(x[:fit], y[:fit], rng)
    net.calibrate(x[fit:rest], y[fit:rest], group[fit:rest])
    net.reported = net.report(x[rest:], y[rest:], group[rest:])
    return net


def scored_spans(net: Network, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, score) of the base matches of each text, and of the other
    candidates that the network accepts, in order."""
    where, rows = [], []
    for i, text in enumerate(texts):
        base = base_matches(text)
        other = [(start, 3, end, start) for start, end in other_candidates(text, [m[:3] for m in base])]
        for start, kind, end, value in base + other:
            windows = _windows(text, value, end)
            rows += windows
            where.append((i, start, kind, end, len(windows)))
    out: list[list] = [[] for _ in texts]
    if rows:
        p = np.concatenate([net.probabilities(np.stack(rows[at : at + 1024])) for at in range(0, len(rows), 1024)])
        at = 0
        for i, start, kind, end, n in where:
            score, at = float(p[at : at + n].max()), at + n
            if kind < 3 or score >= net.threshold[alphabet(texts[i][start:end])]:
                out[i].append((start, kind, end, score))
    return [sorted(found) for found in out]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of every whole text. Base
    matches stay whatever the score of their values."""
    net = network()

    def make():
        def step(rows):
            spans = scored_spans(net, rows["text"])
            return {"doc_id": rows["doc_id"], "spans": [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in found] for found in spans]}

        return step

    return map_rows(id_and_text(docs), f"doc_id long, spans {SPAN}", make)


def _redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    start, end = spans[0]
    for a, b in [*spans[1:], (len(text) + 1, 0)]:
        if a < end:
            end = max(end, b)
            continue
        out += [text[at:start], mark]
        at, start, end = end, a, b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; in text each run of overlapping spans becomes the
    mark, and n_chars, where it is there as a whole number, is counted again. Null
    texts stay null."""
    net = network()

    def make():
        def step(column):
            texts = column.to_pylist()
            for i, spans in enumerate(scored_spans(net, [t or "" for t in texts])):
                if spans:
                    texts[i] = _redacted(texts[i], [(a, b) for a, _, b, _ in spans], mark)
            return texts

        return step

    name = "_".join(["redacted", *[c for c in docs.columns if c.startswith("redacted")]])  # one that isn't taken
    fresh = docs.withColumn(name, column_udf("string", make)(F.col("text")))
    columns = {"text": F.col(f"`{name}`")}
    counted = next((f for f in docs.schema if f.name == "n_chars" and isinstance(f.dataType, IntegralType)), None)
    if counted is not None:
        length = F.length(columns["text"]).cast(counted.dataType)
        columns["n_chars"] = F.when(columns["text"].eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(length)
    return fresh.withColumns(columns).drop(name)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return find_secrets(docs).select("doc_id", *map(count, KINDS), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
