"""Secrets by inferred formats: fixed patterns label credentials, automata learn their formats, all
long runs of credential characters are scored by them, whole and in parts: a credential may stand behind a name, in a path
or in a URL.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse.llm.automata import Automaton, Background
from roompulse.session import staged

# The base patterns and published credential formats (prefix, characters, length).
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
PART = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")     # the shortest credential that a base pattern labels
CUT = re.compile(r"[=/.:_-]")                    # where a credential may begin or end within a run
KINDS = ("assign", "access", "hex", "format")
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FORMATS = {
    "aws": ("AKIA", _UPPER + _DIGITS, 16), "github": ("ghp_", _UPPER + _LOWER + _DIGITS, 36),
    "slack": ("xoxb-", _DIGITS, 24), "google": ("AIza", _UPPER + _LOWER + _DIGITS + "-_", 35),
    "stripe": ("sk_live_", _UPPER + _LOWER + _DIGITS, 24), "npm": ("npm_", _UPPER + _LOWER + _DIGITS, 36)}

EXAMPLES = 2000         # labelled credentials per kind that the states are merged on; all are counted
LONGEST = 512           # characters of a credential that it is fitted on
LEAST = 20              # characters of what a format may claim; fewer where it has shorter labelled credentials
MARGIN = 0.5            # nats per character by which a format must beat ordinary words
LETTERS = frozenset("\n" + _DIGITS + _UPPER + _LOWER + "+/_.=-")      # what the background is asked about


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, credential)`` of the fixed patterns, leftmost first within each kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in RUN.finditer(text):
        if "AKIA" in run[0]:
            out += [(m.start(), m.end(), "access", m[0])
                    for m in ACCESS.finditer(text, run.start(), run.end()) if len(m[0]) >= 16]
        if len(run[0]) >= 32:
            out += [(m.start(), m.end(), "hex", m[0])
                    for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple[int, int, str, str]] = ()) -> list[tuple[int, str]]:
    """Runs of credential characters outside the spans ``base`` that hold a letter and a digit."""
    out, at = [], 0
    spans = sorted((s, e) for s, e, *_ in base)
    for m in PART.finditer(text):
        start = m.start()
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        k = at
        pieces = []
        while k < len(spans) and spans[k][0] < m.end():
            pieces.append((start, spans[k][0]))
            start = max(start, spans[k][1])
            k += 1
        pieces.append((start, m.end()))
        out += [(i, text[i:j]) for i, j in pieces if j - i >= 8
                and any(c.isdigit() for c in text[i:j]) and any(c.isalpha() for c in text[i:j])]
    return out


_FOUND = ("key bigint, starts array<int>, ends array<int>, kinds array<string>, values array<string>, "
          "run_starts array<int>, runs array<string>, ordinary array<string>")


def _finder(batches):
    for batch in batches:
        rows, words = [], set()
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            base = base_spans(text)
            runs = candidates(text, base)
            words.update(text.split())
            rows.append({
                "key": key, "starts": [b[0] for b in base], "ends": [b[1] for b in base],
                "kinds": [b[2] for b in base], "values": [b[3] for b in base],
                "run_starts": [s for s, _ in runs], "runs": [r for _, r in runs], "ordinary": []})
        if rows:    # a batch's words stand once, beside its first document
            rows[0]["ordinary"] = sorted(w for w in words if len(w) >= 6 and w.isalpha())
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


_SCHEMA = pa.schema([
    ("key", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
    ("kinds", pa.list_(pa.string())), ("values", pa.list_(pa.string())),
    ("run_starts", pa.list_(pa.int32())), ("runs", pa.list_(pa.string())),
    ("ordinary", pa.list_(pa.string()))])


class Formats:
    """One automaton per kind of labelled credential and per published format, and the background."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str],
                 counts: dict[tuple[str, str], int] | None = None):
        rng = random.Random(7)
        examples = {k: v for k, v in labelled.items() if v}
        for name, (prefix, letters, n) in FORMATS.items():
            examples[name] = [prefix + "".join(rng.choices(letters, k=n)) for _ in range(100)]
        self.background = Background(ordinary, counts)
        self.automata = {k: Automaton(v) for k, v in sorted(examples.items())}
        # A format claims strings about as likely, per character, as all but 1 % of its own examples.
        self.floor = {k: sorted(a.score(x) / (len(x) + 1) for x in examples[k])[len(examples[k]) // 100] - 0.2
                      for k, a in self.automata.items()}

        # Lengths of credentials: a whole run may be longer, as formats may loop; a part of a run may not.
        self.least = {k: min(LEAST, min(map(len, v))) for k, v in examples.items()}
        self.longest = {k: max(map(len, v)) for k, v in examples.items()}

    def claims(self, text: str) -> bool:
        return any(self._claimed(k, text, self.background.sums(text), 0, [len(text)]) for k in self.automata)

    def _claimed(self, kind: str, text: str, usual: list[float], start: int, ends: list[int]) -> list[int]:
        """Of ``ends``, ascending, those up to which the format claims the text from ``start``."""
        floor, out = self.floor[kind], []
        ends = [e for e in ends if e - start >= self.least[kind]]
        if ends:
            for e, score in self.automata[kind].scores(text, start, ends, floor * (ends[-1] - start + 1)):
                n = e - start
                # What stands before a part is no reason to find its first character odd.
                ordinary = usual[e] - usual[start]
                if score >= floor * (n + 1) and score - ordinary >= MARGIN * n:
                    out.append(e)
        return out

    def spans(self, run: str) -> list[tuple[int, int]]:
        """Spans of a run that formats claim: all of it, or else its longest parts from and to separators, none
        overlapping another. Each part holds a letter and a digit."""
        if self.claims(run):
            return [(0, len(run))]
        cuts = [m.start() for m in CUT.finditer(run)]
        if not cuts:
            return []
        usual = self.background.sums(run)
        starts = sorted({0, *cuts, *(c + 1 for c in cuts)})
        stops = sorted({*cuts, *(c + 1 for c in cuts), len(run)})
        found = set()
        for start in starts:
            for kind in self.automata:
                low = bisect.bisect_left(stops, start + self.least[kind])
                high = bisect.bisect_right(stops, start + self.longest[kind])
                found.update((start, e) for e in self._claimed(kind, run, usual, start, stops[low:high]))
        out: list[tuple[int, int]] = []
        for s, e in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
            part = run[s:e]
            if any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
                at = bisect.bisect_left(out, (s, e))
                if (at == 0 or out[at - 1][1] <= s) and (at == len(out) or e <= out[at][0]):
                    out.insert(at, (s, e))
        return out


def _pairs(batches):
    """How often each two neighbouring characters occur in words; the second is empty if no credential can hold it."""
    for batch in batches:
        counts: Counter = Counter()
        for w in batch.column(0).to_pylist():
            counts.update((a, b if b in LETTERS else "") for a, b in zip("\n" + w, w) if a in LETTERS)
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b, "n": n} for (a, b), n in counts.items()], pa.schema(
            [("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))


def _walked(formats: Formats):
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((kind, *step) for step in formats.automata[kind].walk(text))
            yield pa.RecordBatch.from_pylist(
                [{"kind": k, "state": s, "c": c, "n": n} for (k, s, c), n in counts.items()], pa.schema(
                    [("kind", pa.string()), ("state", pa.int32()), ("c", pa.string()), ("n", pa.int64())]))
    return run


def _scored(formats: Formats):
    def run(batches):
        for batch in batches:
            kinds, texts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [formats.automata[k].score(x) / (len(x) + 1) for k, x in zip(kinds, texts)], pa.float64())], ["kind", "x"])
    return run


def learned(found: DataFrame) -> Formats:
    """The formats of all distinct credentials, beside the pairs of characters in all distinct ordinary words.

    States are merged on at most ``EXAMPLES`` credentials per kind, the first by their hashes. If there are more, all of them
    pass through the states, and probabilities, least score and lengths are theirs.
    """
    each = staged(found.select(F.explode(F.arrays_zip("kinds", "values")).alias("x")).select("x.*").filter(
        F.length("values") <= LONGEST).distinct(), "secrets-labelled")
    labelled = {}
    for kind in KINDS[:3]:
        rows = each.filter(F.col("kinds") == kind).select("values")
        labelled[kind] = [r[0] for r in rows.orderBy(F.xxhash64("values"), "values").limit(EXAMPLES).collect()]
    words = found.select(F.explode("ordinary").alias("w")).distinct().mapInArrow(_pairs, "a string, b string, n bigint")
    pairs = {(r["a"], r["b"]): r["n"] for r in words.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    formats = Formats(labelled, [], pairs)

    length = F.length("values")
    sizes = {r["kinds"]: r for r in each.groupBy("kinds").agg(
        F.count(F.lit(1)).alias("n"), F.min(length).alias("least"), F.max(length).alias("longest")).collect()}
    many = [k for k, r in sizes.items() if r["n"] > EXAMPLES]
    if many:
        rest = each.filter(F.col("kinds").isin(many))
        walked = rest.mapInArrow(_walked(formats), "kind string, state int, c string, n bigint").groupBy(
            "kind", "state", "c").agg(F.sum("n").alias("n")).collect()
        for kind in many:
            formats.automata[kind].recount({(r["state"], r["c"]): r["n"] for r in walked if r["kind"] == kind})
            formats.least[kind] = min(LEAST, sizes[kind]["least"])
            formats.longest[kind] = sizes[kind]["longest"]
        scores = rest.mapInArrow(_scored(formats), "kind string, x double").groupBy("kind").agg(
            F.percentile_approx("x", 0.01, 1_000_000).alias("x"))
        formats.floor.update({r["kind"]: r["x"] - 0.2 for r in scores.collect()})
    return formats


def found_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_assign, n_access, n_hex, base_sha256, spans)`` for each row of ``docs``.

    Spans are ``kind:start:end`` of whole matches in code points, end exclusive, by start and then by kind. The
    fixed patterns' spans stay; ``format`` spans are other runs of credential characters with a letter and a digit, or parts
    of runs between separators, that an inferred format claims: 20 characters, or the shortest labelled credential of the
    format if that is less; parts are no longer than its longest. Null and empty texts have none; rows that repeat are scanned alike.
    The texts are read once: what the formats are learned from and what they score is written out.
    """
    plain = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    found = staged(plain.mapInArrow(_finder, _FOUND), "secrets-found")
    formats = learned(found)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                base = list(zip(r["starts"], r["ends"], r["kinds"]))
                more = [(s + i, s + j, "format") for s, x in zip(r["run_starts"], r["runs"])
                        for i, j in formats.spans(x)]
                both = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))
                join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
                rows.append({
                    "key": r["key"], **{f"n_{k}": r["kinds"].count(k) for k in KINDS[:3]},
                    "base_sha256": hashlib.sha256(join(base).encode()).hexdigest(), "spans": join(both)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("key", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]))

    return found.drop("values", "ordinary").mapInArrow(
        run, "key bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    ).withColumnRenamed("key", key)
