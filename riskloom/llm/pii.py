"""Personal data by patterns and a semi-Markov conditional random field.

Patterns with checks (number ranges, check digits, digit counts) give the base spans,
which always stay. The field looks at what they leave: stretches of words with digits or
an at sign, cut into atoms (runs of letters and digits, single marks, white space). A
segment of at most ``LONGEST`` atoms is scored as a whole, by its digits, marks, shape and
neighbours, for each kind; dynamic programming then picks the best set of segments that do
not overlap, boundaries and kinds together. Weights maximise the likelihood of segmented
stretches from a bounded sample of documents. Their gold segments are the base spans, partly
rewritten into forms that the patterns miss (no plus sign, other separators, spelt-out at
sign), which is what the field adds.

Defined results: null and empty texts have no spans; repeated rows get equal spans;
without any span to learn from the field adds nothing; it adds no span across the white
space where a run of more than ``STRETCH`` characters of digits and addresses is cut;
other columns are ignored, or kept by ``redact``. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as S

from riskloom.llm import text as T

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int, int]  # kind, start, end
#: Documents and stretches the field is fitted on at most, and atoms of such a stretch.
SAMPLE_DOCS, SAMPLE_STRETCHES, SAMPLE_ATOMS = 3_000, 6_000, 48
LONGEST = 16
#: Characters after which a run of words is ended, and characters looked at together.
STRETCH, TOGETHER = 20_000, 100_000
#: Log-odds a segment needs over being left out.
MARGIN = 2.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: the one before it would have taken the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# An at sign in brackets, or the word with a dotted or spelt-out domain behind it, of any case.
_DOT = r"(?:\.|\s{0,3}[\[(]?\s{0,3}(?<![A-Za-z0-9])[Dd][Oo][Tt](?![A-Za-z0-9])\s{0,3}[\])]?\s{0,3})"
_SPELT_DOMAIN = rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}"
_SPELT = rf"[\[(]\s{{0,3}}[Aa][Tt]\s{{0,3}}[\])](?:\s{{0,3}}{_SPELT_DOMAIN})?|(?<![A-Za-z0-9])[Aa][Tt]\s{{1,3}}{_SPELT_DOMAIN}"
_HOT, _SPELT = re.compile(f"[0-9@]|{_SPELT}"), re.compile(_SPELT)
_WORD = re.compile(r"\S+")
_ATOM = re.compile(r"[A-Za-z0-9]+|\s+|.", re.S)
_NO_DIGIT = re.compile("[^0-9]+")
_NUMBER = re.compile("[._+-]?[0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain, in one pass over the at signs."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def stretches(text: str, taken: list[Span] | None) -> Iterator[tuple[int, int]]:
    """Runs of words with a digit or an at sign, one word more on either side.

    With ``taken`` given, only runs that hold something outside those spans. A run is
    ended at white space once it is ``STRETCH`` characters long.
    """
    covered = Ranges(taken or [])
    done, at = 0, 0
    while (m := _HOT.search(text, at)) is not None:
        at = covered.end_at(m.start())
        if at is not None:
            continue
        # Back over the word and one more, forward over words while they are hot and one more.
        low = m.start()
        for _ in range(2):
            start = low
            while start > done and text[start - 1].isspace():
                start -= 1
            while start > done and not text[start - 1].isspace():
                start -= 1
            low = start
        if low < m.start() and text[low].isspace():
            low += 1
        word = _WORD.match(text, m.end())
        high = word.end() if word else m.end()
        while high - low < STRETCH and (word := _WORD.search(text, high)) is not None:
            high = word.end()
            if not _HOT.search(text, word.start(), high):
                # A spelt-out address goes over several words; this one may be its beginning.
                spelt = _SPELT.search(text, word.start(), high + 1_000)
                if spelt is None or text[high : spelt.start()].strip():
                    break
                word = _WORD.match(text, spelt.end())
                high = word.end() if word else spelt.end()
        done = at = high
        yield low, high


class Ranges:
    """Ranges of spans, merged, for look-ups by position."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a), self.ends.append(b)

    def end_at(self, position: int) -> int | None:
        """End of the range that holds a position."""
        k = bisect_right(self.starts, position) - 1
        return self.ends[k] if k >= 0 and position < self.ends[k] else None

    def within(self, low: int, high: int) -> list[tuple[int, int]]:
        """Ranges that touch low to high, counted from low."""
        first, last = bisect_right(self.ends, low), bisect_left(self.starts, high)
        return [(a - low, b - low) for a, b in zip(self.starts[first:last], self.ends[first:last])]


_MARKS = "@.+()-[] "


def _bucket(values: np.ndarray, cuts: list[int]) -> np.ndarray:
    return np.searchsorted(cuts, values, side="right")


class Lattice:
    """All segments of many stretches, with their features."""

    def __init__(self, texts: list[str]):
        atoms: list[str] = []
        self.bounds, self.offsets = [0], []
        for t in texts:
            at = 0
            for a in _ATOM.findall(t):
                atoms.append(a)
                self.offsets.append(at)
                at += len(a)
            self.bounds.append(len(atoms))
        self.sizes = np.array(list(map(len, atoms)), np.int64)
        self.offsets = np.array(self.offsets, np.int64)
        n = len(atoms)
        digits = np.array([sum(c.isdigit() and c.isascii() for c in a) for a in atoms], np.int64)
        word = np.array([a[0].isalnum() and a.isascii() for a in atoms], bool) if n else np.empty(0, bool)
        mark = {c: np.array([a == c for a in atoms], np.int64) for c in "@.+()-[]"}
        mark[" "] = np.array([a.isspace() for a in atoms], np.int64)
        letters = np.where(word, self.sizes - digits, 0)
        spelt = np.array([a.lower() == "at" for a in atoms], np.int64)
        dot = np.array([a.lower() == "dot" for a in atoms], np.int64)
        octet = np.array([a.isdigit() and len(a) <= 3 and int(a) <= 255 for a in atoms], np.int64)
        other = 1 - (word | sum(mark.values()).astype(bool)).astype(np.int64) if n else digits
        self.window = np.repeat(np.arange(len(texts)), np.diff(self.bounds)).astype(np.int64)
        ends = np.array(self.bounds, np.int64)[self.window + 1] if n else np.empty(0, np.int64)

        opens = word | (mark["+"] > 0) | (mark["("] > 0) if n else word
        start = np.repeat(np.arange(n), LONGEST)
        stop = start + np.tile(np.arange(1, LONGEST + 1), n)
        ok = (stop <= np.repeat(ends, LONGEST)) & opens[start] if n else np.empty(0, bool)
        start, stop = start[ok], stop[ok]
        total = lambda x: (lambda c: c[stop] - c[start])(np.concatenate([[0], np.cumsum(x)]))
        closes = word[stop - 1] | (mark[")"][stop - 1] > 0)
        n_digits, n_at, n_other = total(digits), total(mark["@"] + spelt), total(other)
        ok = closes & (n_other == 0) & ((n_digits >= 4) | (n_at == 1)) & (n_at <= 1)
        self.start, self.stop = start[ok], stop[ok]
        start, stop = self.start, self.stop
        n_digits, n_at = n_digits[ok], n_at[ok]
        counts = {c: total(mark[c]) for c in _MARKS}
        n_letters, n_words, n_octets = total(letters), total(word.astype(np.int64)), total(octet)
        runs = total((digits > 0).astype(np.int64))
        bounds = np.array(self.bounds, np.int64)
        first = start == bounds[self.window[start]] if n else np.empty(0, bool)
        last = stop == bounds[self.window[stop - 1] + 1] if n else np.empty(0, bool)
        left, right = np.maximum(start - 1, 0), np.minimum(stop, max(n - 1, 0))
        glue_left = ~first & (mark[" "][left] == 0) if n else first
        glue_right = ~last & (word[right] | (mark["@"][right] > 0) | (mark["-"][right] > 0) | (mark["+"][right] > 0)) if n else last
        tail = letters[stop - 1] > 0 if n else last
        columns = [np.ones(len(start), bool), glue_left, glue_right, tail, mark["+"][start] > 0, mark["("][start] > 0]
        columns += [n_at == 1, total(dot) > 0, n_letters == 0, n_letters > 4, n_octets == n_words, (n_octets == 4) & (n_words == 4)]
        columns += [(n_at == 1) & tail & ((counts["."] > 0) | (total(dot) > 0)), (n_letters == 0) & (counts["."] == 3) & (n_words == 4)]
        address = (n_at == 1) & tail & ((counts["."] > 0) | (total(dot) > 0))
        columns += [address & (n_digits == 0), address & (counts["@"] == 0) & (counts["["] + counts["("] == 0), address & (counts[" "] > 1)]
        for value, cuts in ((n_digits, [1, 4, 7, 8, 10, 11, 12, 14, 16, 17, 20]), (runs, [1, 2, 3, 4, 5, 6]), (counts["."], [1, 2, 3, 4]),
                            (counts["-"], [1, 2, 4]), (counts[" "], [1, 2, 3, 4, 6]), (counts["("] + 2 * counts[")"], [1, 3, 4]),
                            (counts["["] + counts["]"], [1, 3]), (n_words, [1, 2, 3, 4, 5, 6, 8])):
            code = _bucket(value, cuts)
            columns += [code == k for k in range(len(cuts) + 1)]
        lengths = [digits[start] if n else start, digits[stop - 1] if n else stop]
        for value in lengths:
            code = _bucket(value, [1, 2, 3, 4, 5, 7, 11])
            columns += [code == k for k in range(8)]
        self.features = np.stack(columns, 1).astype(np.float32) if n else np.empty((0, len(columns)), np.float32)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the segments in their stretches, in code points."""
        return self.offsets[self.start], self.offsets[self.stop - 1] + self.sizes[self.stop - 1]


class SemiMarkovField:
    """Weights by feature and kind; an atom outside any segment scores 0."""

    def __init__(self, weights: np.ndarray | None):
        self.weights = weights

    def segment(self, texts: list[str], taken: list[list[tuple[int, int]]]) -> list[list[Span]]:
        """The best segments of each stretch that do not touch its taken ranges."""
        out: list[list[Span]] = [[] for _ in texts]
        if self.weights is None or not texts:
            return out
        lattice = Lattice(texts)
        scores = lattice.features @ self.weights - MARGIN
        kind, best = scores.argmax(1), scores.max(1) if len(scores) else np.empty(0)
        low, high = lattice.spans()
        blocked = [Ranges([(0, a, b) for a, b in t]) for t in taken]
        by_window: dict[int, list[tuple[int, int, int, float]]] = {}
        for k in np.flatnonzero(best > 0).tolist():
            w = int(lattice.window[lattice.start[k]])
            a, b = int(low[k]), int(high[k])
            if not blocked[w].within(a, b):
                by_window.setdefault(w, []).append((b, a, int(kind[k]), float(best[k])))
        for w, segments in by_window.items():
            # Segments that score nothing are never chosen, so the chain runs over the others' ends.
            segments.sort()
            stops, value, choice = [0], [0.0], [None]
            for b, a, k, s in segments:
                at = int(np.searchsorted(stops, a, side="right")) - 1
                total = value[at] + s
                if b > stops[-1]:
                    stops.append(b), value.append(value[-1]), choice.append(None)
                if total > value[-1]:
                    value[-1], choice[-1] = total, (at, a, k)
            at = len(stops) - 1
            while at > 0:
                if choice[at] is None:
                    at -= 1
                else:
                    before, a, k = choice[at]
                    out[w].append((k, a, stops[at]))
                    at = before
        return out


def train(examples: list[tuple[str, list[Span]]], steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> SemiMarkovField:
    """Maximise the likelihood of segmented stretches by forward and backward sums over all segmentations."""
    examples = [(t, s) for t, s in examples if len(_ATOM.findall(t)) <= SAMPLE_ATOMS]
    if not any(s for _, s in examples):
        return SemiMarkovField(None)
    lattice = Lattice([t for t, _ in examples])
    low, high = lattice.spans()
    window = lattice.window[lattice.start]
    gold = np.zeros((len(low), len(KINDS)), np.float32)
    place = {(w, a, b): k for k, (w, a, b) in enumerate(zip(window.tolist(), low.tolist(), high.tolist()))}
    for w, (_, spans) in enumerate(examples):
        for kind, a, b in spans:
            if (k := place.get((w, a, b))) is not None:
                gold[k, kind] = 1
    bounds = np.array(lattice.bounds)
    n, width = len(examples), int(np.diff(bounds).max())
    size = np.diff(bounds)
    i, j = lattice.start - bounds[window], lattice.stop - bounds[window]
    ending, starting = ([np.flatnonzero(x == k) for k in range(width + 1)] for x in (j, i))
    x = lattice.features
    weights, first, second = (np.zeros((x.shape[1], len(KINDS)), np.float32) for _ in range(3))
    weights[0] = -3
    wanted = x.T @ gold
    for step in range(1, steps + 1):
        scores = (x @ weights).astype(np.float64)
        any_kind = np.logaddexp.reduce(scores, axis=1)
        forward, backward = np.zeros((n, width + 1)), np.zeros((n, width + 1))
        for k in range(1, width + 1):
            forward[:, k] = forward[:, k - 1]
            e = ending[k]
            np.logaddexp.at(forward[:, k], window[e], forward[window[e], i[e]] + any_kind[e])
        for k in range(width - 1, -1, -1):
            backward[:, k] = np.where(k < size, backward[:, k + 1], 0)
            e = starting[k]
            np.logaddexp.at(backward[:, k], window[e], backward[window[e], j[e]] + any_kind[e])
        z = backward[:, 0]
        p = np.exp(forward[window, i] + backward[window, j] - z[window])[:, None] * np.exp(scores)
        slope = (wanted - x.T @ p.astype(np.float32)) / n - ridge * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights = weights + rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return SemiMarkovField(weights.astype(np.float32))


def rewrite(text: str, spans: list[Span], seed: int) -> tuple[str, list[Span]]:
    """A stretch with its spans in forms that the patterns miss."""
    pick = random.Random(seed)
    out, made, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        raw = text[a:b]
        if kind == 0:
            if pick.random() < 0.5:  # many addresses have no digit
                raw = _NUMBER.sub("", raw) if _NUMBER.sub("", raw.partition("@")[0]) else raw
            local, _, domain = raw.partition("@")
            sign = pick.choice([" [at] ", " (at) ", "[at]", "(AT)", " [ at ] ", " ( AT ) ", " at ", " AT ", " at "])
            if pick.random() < 0.4:
                domain = domain.replace(".", pick.choice([" dot ", " DOT ", " [dot] "]))
            raw = local + sign + domain
        elif kind == 1:
            raw = raw.replace(".", pick.choice(["[.]", "(.)"]))
        elif kind == 2:
            digits = _NO_DIGIT.sub("", raw)
            raw = pick.choice(["-", ".", " . "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
            raw = raw.replace("-", ". ") if "-" in raw else raw
        else:
            digits = _NO_DIGIT.sub("", raw)[-10:]
            raw = pick.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "1 ({}) {}-{}"]).format(digits[:3], digits[3:6], digits[6:])
        out += text[at:a]
        made.append((kind, len(out), len(out) + len(raw)))
        out, at = out + raw, b
    return out + text[at:], made


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            spans = base_spans(text or "")
            for a, b in stretches(text or "", None):
                if b - a <= 400:
                    inside = [[k, x - a, y - a] for k, x, y in spans if a <= x and y <= b]
                    rows.append({"key": key, "stretch": text[a:b], "spans": inside})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("key", pa.int64()), ("stretch", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))]))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_stretches: int = SAMPLE_STRETCHES) -> SemiMarkovField:
    """Learn from at most ``sample_docs`` documents and ``sample_stretches`` stretches, the first by hash."""
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("key")).where(F.col("text").rlike("[0-9@]"))
    chosen = keyed.select("key").distinct().orderBy("key").limit(sample_docs)
    found = keyed.join(F.broadcast(chosen), "key").mapInArrow(_samples, "key long, stretch string, spans array<array<int>>")
    rows = found.distinct().orderBy("key", "stretch").limit(sample_stretches).collect()
    examples = []
    for k, r in enumerate(rows):
        spans = [tuple(s) for s in r["spans"]]
        examples.append((r["stretch"], spans))
        if spans:
            examples.append(rewrite(r["stretch"], spans, k))
    field = train(examples)
    del rows, examples
    T.give_back()
    return field


def find_spans(texts: list[str | None], field: SemiMarkovField) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text, by kind and start."""
    base = [base_spans(t) if t else [] for t in texts]
    windows, places, taken = [], [], []
    for k, t in enumerate(texts):
        if t and field.weights is not None:
            ranges = Ranges(base[k])
            for a, b in stretches(t, base[k]):
                windows.append(t[a:b])
                places.append((k, a))
                taken.append(ranges.within(a, b))
    every = [list(s) for s in base]
    together = np.cumsum([len(w) for w in windows]) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(together)) + 1).tolist(), len(windows)]
    for low, high in zip(cuts, cuts[1:]):
        for (k, a), spans in zip(places[low:high], field.segment(windows[low:high], taken[low:high])):
            every[k] += [(kind, a + x, a + y) for kind, x, y in spans]
    return base, [sorted(s) for s in every]


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: SemiMarkovField) -> DataFrame:
    """doc_id, base counts by kind, a digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                base, every = find_spans(part.column("text").to_pylist(), field)
                columns = {"doc_id": part.column("doc_id")}
                for k, kind in enumerate(KINDS):
                    columns[f"n_{kind}"] = pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64())
                columns["base_sha256"] = pa.array([hashlib.sha256(_written(s).encode()).hexdigest() for s in base], pa.string())
                columns["spans"] = pa.array([_written(s) for s in every], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, field: SemiMarkovField) -> DataFrame:
    """All rows and columns, each span in ``text`` replaced by its kind; ``n_chars`` follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = part.column("text").to_pylist()
                _, every = find_spans(texts, field)
                clean = [_masked(t, s) if s else t for t, s in zip(texts, every)]
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))
                at = part.schema.get_field_index("n_chars")
                if at >= 0 and counted:
                    old = part.column(at).to_pylist()
                    new = [len(t) if s else n for t, s, n in zip(clean, every, old)]
                    part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                yield part

    counted = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, S.IntegralType)
    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return detect(docs, fit(docs))
