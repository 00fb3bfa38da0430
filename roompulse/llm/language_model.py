"""Scores of texts under an n-gram trie in Elias-Fano levels, trained on the whole corpus.

Level 1 holds all training words: their sorted 64-bit hashes as an Elias-Fano sequence (a word's number is its place)
and exact counts, which the add-one score needs. Each further level holds, one after another, the successors of all
entries of the level before: monotone pointers from the entries, an Elias-Fano sequence that grows within an entry and
goes on from the last number of the entry before, and 16-bit codes of the smoothed shares of probability and of what
each context leaves to the level below. An n-gram is looked up by a successor search for its last word's number
relative to its context: at level 2 the word's number, beyond that its place among the successors of the shorter
context, so that numbers stay as small as that context has successors.

Levels are cut into parts, level 1 by hashes, the others by ranges of contexts; there are more parts where there are
more tokens. One task builds a part from counts that every map task has combined and packed beforehand, and writes it to
the shared folder; scoring tasks map it into memory. The driver sees one row of sizes per part.
"""

from __future__ import annotations

import uuid
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse.llm import mapped
from roompulse.llm.columns import crc_fold
from roompulse.llm.eliasfano import EliasFano, encode
from roompulse.llm.wordhash import U, Words, part_of
from roompulse.session import staging_folder

START, END = U(0x517CC1B727220A95), U(0x2545F4914F6CDD1D)   # hashes of the two marks
GRID = 2048                 # steps of the quantised probabilities per power of ten
FLUSH = 1 << 21             # distinct entries that a task combines before it passes them on
PIECE = 1 << 18             # tokens looked up at a time
ORDER = 3                   # words of the longest n-grams
ENTRIES = 1 << 23           # tokens per part: bounds what one task builds
KEY_BITS = 64               # bits of a counted n-gram (context and symbol)
OPEN = 512                  # parts of a level that a worker holds open


class _Counts:
    """Counts of 64-bit keys combined over the batches of a task."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * FLUSH:
            self.combine()

    def combine(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, U), np.zeros(0, np.int64)
        keys, counts = combined(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return keys, counts

    def clear(self) -> None:
        self.keys, self.counts, self.held = [], [], 0


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=U(0))
    wide = np.stack([((steps >> U(8 * k)) & U(255)).astype(np.uint8) for k in range(8)])
    small = np.stack([((counts >> (8 * k)) & 255).astype(np.uint8) for k in range(6)])
    return zstandard.ZstdCompressor(level=1).compress(
        np.int64(len(keys)).tobytes() + wide.tobytes() + small.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    wide, small = raw[8:8 + 8 * n].reshape(8, n), raw[8 + 8 * n:].reshape(6, n)
    steps = sum((wide[k].astype(U) << U(8 * k) for k in range(8)), np.zeros(n, U))
    counts = sum((small[k].astype(np.int64) << (8 * k) for k in range(6)), np.zeros(n, np.int64))
    return np.cumsum(steps, dtype=U), counts


def _blobs(counts: _Counts, owner):
    """A batch ``(part, blob)`` of what a task has counted; ``owner`` gives the growing parts of sorted keys."""
    keys, n = counts.combine()
    counts.clear()
    if not len(keys):
        return
    part = owner(keys)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    yield pa.RecordBatch.from_arrays([
        pa.array(part[cut[:-1]], pa.int64()),
        pa.array([_pack(keys[i:j], n[i:j]) for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["part", "blob"])


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    pieces = [_unpack(b.as_py()) for b in table.column("blob")]
    return combined(np.concatenate([k for k, _ in pieces]), np.concatenate([c for _, c in pieces]))


def _tokens(words: Words, number: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """``(token, first)``: each row's words and end; where rows begin."""
    rows = len(words.at) - 1
    shift = np.arange(rows)
    token = np.empty(len(number) + rows, number.dtype)
    token[np.arange(len(number)) + np.repeat(shift, np.diff(words.at))] = number
    token[words.at[1:] + shift] = end
    return token, words.at[:-1] + shift


def _before(values: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token; ``start`` where a row begins."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = start
    return out


def _count_words(parts: int):
    def owner(keys):
        return part_of(keys, parts)

    def run(batches):
        counts = _Counts()
        for batch in batches:
            h = Words(batch.column(0)).hash
            keys, n = np.unique(h, return_counts=True)
            counts.add(keys, n)
            counts.add(np.array([min(START, END), max(START, END)], U), np.full(2, batch.num_rows, np.int64))
            if counts.held > FLUSH and len(counts.combine()[0]) > FLUSH:
                yield from _blobs(counts, owner)
        yield from _blobs(counts, owner)
    return run


FIELDS = {"head": np.int64, "low": np.uint8, "high": np.uint8, "rank": np.int64}


def _fields(of: str) -> dict[str, type]:
    return {f"{of}.{k}": t for k, t in FIELDS.items()}


def _written(of: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{of}.{k}": a for k, a in encode(values).items()}


def _sequence(of: str, arrays: dict[str, np.ndarray]) -> EliasFano | None:
    get = {k: arrays[f"{of}.{k}"] for k in FIELDS}
    return EliasFano(**get) if len(get["head"]) else None


def _write_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        keys, n = _merged(table)
        part = table.column("part")[0].as_py()
        mapped.write_together(folder, f"words-{part}", {
            **_written("hash", (keys - keys[0]).astype(np.int64)), "least": keys[:1], "count": n})
        tokens = int(n[keys != START].sum())
        return pa.table({"part": pa.array([part], pa.int64()), "size": pa.array([len(keys)], pa.int64()),
                         "tokens": pa.array([tokens], pa.int64())})
    return run


class Vocabulary:
    """Level 1: numbers and counts of words; a word's number is its place among all hashes, -1 if unknown."""

    def __init__(self, folder: str, bases: tuple[int, ...]):
        self.folder, self.bases = folder, np.array(bases, np.int64)
        self.files: dict[int, tuple] = {}

    def part(self, p: int):
        if p not in self.files:
            if len(self.files) >= OPEN:
                self.files.clear()
            get = mapped.read_together(self.folder, f"words-{p}", {**_fields("hash"), "least": U, "count": np.int64})
            self.files[p] = (_sequence("hash", get), get["least"], get["count"])
        return self.files[p]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(number, count)`` of sorted distinct hashes."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        parts = len(self.bases) - 1
        cut = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            hashes, least, counts = self.part(int(p))
            if hashes is None:
                continue
            at = hashes.find((h[cut[p]:cut[p + 1]] - least[0]).astype(np.int64))
            number[cut[p]:cut[p + 1]] = np.where(at >= 0, at + self.bases[p], -1)
            count[cut[p]:cut[p + 1]] = np.where(at >= 0, counts[at], 0)
        return number, count


class Shape(NamedTuple):
    """How a level beyond the first is cut. ``bits`` hold any symbol and one more; where a context and a symbol do not fit
    into one key together, contexts are counted in ``slices`` of whole parts."""

    level: int
    contexts: int
    width: int          # contexts per part
    bits: int
    slices: int         # contexts per slice

    @staticmethod
    def of(level: int, contexts: int, words: int, tokens: int, parts: int, entries: int, key_bits: int) -> Shape:
        bits = int(words + 1).bit_length()
        room = 1 << max(0, key_bits - bits)
        width = min(room, max(1, -(-contexts // max(parts, -(-tokens // entries)))))
        return Shape(level, contexts, width, bits, room // width * width)

    @property
    def parts(self) -> int:
        return -(-self.contexts // self.width)


def _distinct(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order and where each row's pair is; ``b`` takes ``bits``, ``a`` may be of any size."""
    own = None
    if int(a.max()).bit_length() + bits > 64:
        own, a = np.unique(a, return_inverse=True)      # places among PIECE rows
    keys, back = np.unique((a.astype(U) << U(bits)) | b.astype(U), return_inverse=True)
    first, second = (keys >> U(bits)).astype(np.int64), (keys & U((1 << bits) - 1)).astype(np.int64)
    return first if own is None else own[first], second, back


class Level:
    """A level beyond the first; parts are opened as needed."""

    def __init__(self, folder: str, shape: Shape, bases: tuple[int, ...]):
        self.folder, self.shape, self.bases = folder, shape, np.array(bases, np.int64)
        self.files: dict[int, tuple] = {}

    def part(self, p: int):
        if p not in self.files:
            if len(self.files) >= OPEN:
                self.files.clear()
            get = mapped.read_together(self.folder, f"level{self.shape.level}-{p}", {
                **_fields("pointer"), **_fields("successor"), "code": np.uint16, "rest": np.uint16})
            self.files[p] = (_sequence("pointer", get), _sequence("successor", get), get["code"], get["rest"])
        return self.files[p]

    def look_up(self, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(number, place, share, rest)`` of each token after its context, -1 standing for what is unknown: the
        n-gram's number in this level, its place among the successors of its context, its share of probability, and what
        its context leaves to the level below."""
        number, place = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        share, rest = np.zeros(len(context)), np.ones(len(context))
        for at in range(0, len(context), PIECE):
            known = at + np.flatnonzero(context[at:at + PIECE] >= 0)
            if len(known):
                one, after, back = _distinct(context[known], symbol[known] + 1, self.shape.bits)
                for out, got in zip((number, place, share, rest), self._found(one, after)):
                    out[known] = got[back]
        return number, place, share, rest

    def _found(self, context: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
        """``look_up`` for distinct rows in order; ``after`` is the symbol and one, 0 if unknown."""
        number, place = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        share, rest = np.zeros(len(context)), np.ones(len(context))
        width = self.shape.width
        cut = np.searchsorted(context, np.arange(self.shape.parts + 1) * width)
        for p in np.flatnonzero(np.diff(cut)):
            pointers, successors, code, left = self.part(int(p))
            if pointers is None:
                continue
            piece = slice(cut[p], cut[p + 1])
            a = context[piece] - p * width
            new = np.concatenate([[True], a[1:] != a[:-1]])
            own, back = a[new], np.cumsum(new) - 1
            begin, end = pointers.access(own), pointers.access(own + 1)
            base = np.zeros(len(own), np.int64)
            later = np.flatnonzero((begin > 0) & (end > begin))
            base[later] = successors.access(begin[later] - 1)
            at = successors.find(base[back] + after[piece])
            hit = (at >= begin[back]) & (at < end[back])
            number[piece] = np.where(hit, at + self.bases[p], -1)
            place[piece] = np.where(hit, at - begin[back], -1)
            share[piece] = np.where(hit, 10.0 ** (code[np.where(hit, at, 0)] / -GRID), 0)
            rest[piece] = 10.0 ** (left[a] / -GRID)
        return number, place, share, rest


@lru_cache(maxsize=2)
def _opened(folder: str, bases: tuple[int, ...], shapes: tuple) -> tuple[Vocabulary, list[Level]]:
    return Vocabulary(folder, bases), [Level(folder, shape, ends) for shape, ends in shapes]


def _numbered(words: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and counts of all words, and those of the two marks."""
    own, back = np.unique(np.concatenate([words.hash, [START, END]]), return_inverse=True)
    number, count = vocabulary.look_up(own)
    number, count = number[back], count[back]
    return number[:-2], count[:-2], number[-2:], count[-2:]


def _count_level(folder: str, bases: tuple[int, ...], shapes: tuple, shape: Shape):
    def run(batches):
        vocabulary, levels = _opened(folder, bases, shapes)
        held: dict[int, _Counts] = {}

        def flush(s: int):
            return _blobs(held[s], lambda keys: ((keys >> U(shape.bits)).astype(np.int64) + s * shape.slices)
                          // shape.width)

        for batch in batches:
            words = Words(batch.column(0))
            number, _, marks, _ = _numbered(words, vocabulary)
            symbol, first = _tokens(words, number, marks[1])
            context = _before(symbol, first, marks[0])
            for level in levels:
                number, symbol, _, _ = level.look_up(context, symbol)
                context = _before(number, first, -1)
            known = context >= 0
            context, symbol = context[known], symbol[known]
            slice_of = context // shape.slices
            for s in np.unique(slice_of) if shape.contexts > shape.slices else range(min(1, len(context))):
                mine = slice(None) if shape.contexts <= shape.slices else slice_of == s
                keys, n = np.unique(((context[mine] - s * shape.slices).astype(U) << U(shape.bits))
                                    | symbol[mine].astype(U), return_counts=True)
                counts = held.setdefault(int(s), _Counts())
                counts.add(keys, n)
                if counts.held > FLUSH and len(counts.combine()[0]) > FLUSH:
                    yield from flush(int(s))
            if sum(c.held for c in held.values()) > 4 * FLUSH:
                for s in held:
                    yield from flush(s)
        for s in held:
            yield from flush(s)
    return run


def _write_level(folder: str, shape: Shape):
    def run(table: pa.Table) -> pa.Table:
        keys, n = _merged(table)
        part = table.column("part")[0].as_py()
        start = part * shape.width
        size = min(shape.width, shape.contexts - start)
        context = (keys >> U(shape.bits)).astype(np.int64) - start % shape.slices
        symbol = (keys & U((1 << shape.bits) - 1)).astype(np.int64)
        kinds = np.bincount(context, minlength=size)
        total = np.bincount(context, weights=n, minlength=size)
        pointers = np.concatenate([[0], np.cumsum(kinds)])
        last = np.where(kinds > 0, symbol[np.maximum(pointers[1:] - 1, 0)] + 1, 0)
        base = np.concatenate([[0], np.cumsum(last)])[:-1]
        whole = total + kinds
        mapped.write_together(folder, f"level{shape.level}-{part}", {
            **_written("pointer", pointers), **_written("successor", symbol + 1 + base[context]),
            "code": _code(n / whole[context]),
            "rest": _code(np.where(kinds > 0, kinds / np.maximum(whole, 1), 1.0))})
        return pa.table({"part": pa.array([part], pa.int64()), "size": pa.array([len(keys)], pa.int64())})
    return run


def _code(share: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-GRID * np.log10(share)), 0, 65535).astype(np.uint16)


class Model:
    """Where the trie lies and how large it is: all that the driver knows of it."""

    def __init__(self, folder: str, bases: tuple[int, ...], shapes: tuple, tokens: int):
        self.folder, self.bases, self.shapes, self.tokens = folder, bases, shapes, tokens

    def score(self, column: pa.Array) -> list[np.ndarray]:
        """``(tokens, known, base, score)`` of each text; logarithms to base 10.

        Witten-Bell: at each level the n-gram's share, and the context's rest spread by the level below."""
        vocabulary, levels = _opened(self.folder, self.bases, self.shapes)
        words = Words(column)
        number, count, marks, counts = _numbered(words, vocabulary)
        symbol, first = _tokens(words, number, marks[1])
        seen, _ = _tokens(words, count, counts[1])
        distinct = max(0, self.bases[-1] - 1)           # the start mark is no token
        single = (seen + 1) / (self.tokens + distinct + 1)
        mixture, context = single, _before(symbol, first, marks[0])
        for level in levels:
            number, symbol, share, rest = level.look_up(context, symbol)
            mixture = np.minimum(share + rest * mixture, 1.0)     # codes are rounded
            context = _before(number, first, -1)
        sums = [np.add.reduceat(x, first) for x in ((seen > 0).astype(np.int64), np.log10(single), np.log10(mixture))]
        return [np.diff(words.at) + 1, *sums]


def _bases(rows, parts: int) -> tuple[int, ...]:
    size = {r["part"]: r["size"] for r in rows}
    return tuple(np.cumsum([0, *(size.get(p, 0) for p in range(parts))]).tolist())


def trained(texts: DataFrame, parts: int, folder: str, order: int = ORDER, entries: int = ENTRIES,
            key_bits: int = KEY_BITS) -> Model:
    """The trie of one column of texts. A context's successors lie in one part; a word that stands for a third of all
    tokens adds no more than its distinct successors to it, for tasks combine before they pass on, and what follows
    its pairs lies with the pairs, in many parts."""
    parts = max(2, parts)       # hashes of a part are less than 2^63 apart
    blob = "part bigint, blob binary"
    sizes = texts.mapInArrow(_count_words(parts), blob).groupBy("part").applyInArrow(
        _write_words(folder), "part bigint, size bigint, tokens bigint").collect()
    bases, tokens = _bases(sizes, parts), sum(r["tokens"] for r in sizes)
    shapes: tuple = ()
    contexts = bases[-1]
    for level in range(2, order + 1):
        if not contexts:
            break
        shape = Shape.of(level, contexts, bases[-1], tokens, parts, entries, key_bits)
        sizes = texts.mapInArrow(_count_level(folder, bases, shapes, shape), blob).groupBy("part").applyInArrow(
            _write_level(folder, shape), "part bigint, size bigint").collect()
        ends = _bases(sizes, shape.parts)
        shapes, contexts = (*shapes, (shape, ends)), ends[-1]
    return Model(folder, bases, shapes, tokens)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7,
           held_out: int = 2, parts: int | None = None, order: int = ORDER, entries: int = ENTRIES,
           key_bits: int = KEY_BITS) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    The model learns from every row whose crc32(key as text) modulo ``folds`` is not ``held_out``. Tokens are
    the words (A-Z lower-cased) and one end; null and empty texts are just an end. ``base_score`` is the add-one
    single-word score, ``score`` that of the trie of n-grams up to ``order`` words. Without training rows every token
    is unknown; an empty table gives an empty result. Rows that repeat a key count and are scored one by one; a null key
    counts as the empty text in the fold. Very long texts count and are scored whole, ``PIECE`` tokens at a time.
    ``entries`` is the number of tokens per part and ``key_bits`` that of the bits of a counted n-gram; neither
    changes the scores.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{staging_folder(spark)}/trie-{uuid.uuid4().hex}"
    fold = crc_fold(F.col(key), folds)
    model = trained(docs.filter(fold != held_out).select(F.col(text).alias("text")), parts, folder, order, entries,
                    key_bits)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, known, base, score = model.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                pa.array(np.full(len(tokens), model.tokens), pa.int64()), pa.array(base), pa.array(score)],
                ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), (fold == held_out).alias("held_out"),
                       F.col(text).alias("text"))
    return rows.mapInArrow(run, (
        "key bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double")).withColumnRenamed("key", key)
