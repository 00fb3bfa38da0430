"""SentencePiece BPE encoding and decoding by suffix-array matching.

The words of a batch are joined into one text and its suffixes are sorted. A binary search per piece gives the range
of suffixes that begin with it, hence every place where the piece occurs: the edges. Sorted by where they end, they
are relaxed from left to right: each prefix of a word has one last piece, namely the longest edge that ends there and
whose start's last piece it may follow. A piece may follow another if byte-pair merging their joined text gives
the two back. This is what merging by score, leftmost first, arrives at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
KEPT = 1 << 20          # distinct words that a worker remembers
PAIRS = 1 << 21         # pairs of pieces that it remembers, and new ones before they are sorted in
FRESH = 1 << 16


_HELD: dict[str, Pieces] = {}


def _held(token: str, table: tuple) -> Pieces:
    """The pieces of this worker process, which keeps what earlier tasks have learned."""
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = Pieces(*table)
    return _HELD[token]


class Pieces:
    """The pieces of a BPE model with byte fallback: ``texts`` by id, their ``scores``, and where bytes start."""

    def __init__(self, texts: list[str], scores: list[float], byte_ids: list[int], plain: list[bool]):
        self.texts, self.scores, self.byte_ids = texts, scores, byte_ids
        self.id = {t: i for i, (t, ok) in enumerate(zip(texts, plain)) if ok}
        self.longest = max(map(len, self.id), default=1)
        control = {i for i, ok in enumerate(plain) if not ok} - set(byte_ids)
        self.raw = [b"" if i in control else t.encode() for i, t in enumerate(texts)]
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        self.kind = np.uint16 if len(texts) <= 1 << 16 else np.uint32
        # Pairs of pieces and whether one may follow the other: sorted arrays, and what has come since.
        self.pairs = np.zeros(0, np.int64), np.zeros(0, bool)
        self.fresh: dict[int, bool] = {}
        self.token = hashlib.sha256("\x00".join(texts).encode()).hexdigest()
        self.words: dict[str, bytes] = {}      # ids as an array of ``kind``

    @staticmethod
    def read(model: str) -> Pieces:
        """The piece table of a model file; ids, texts and scores are all that is taken from it."""
        from sentencepiece import SentencePieceProcessor
        file = SentencePieceProcessor(model_file=model)
        every = range(file.get_piece_size())
        plain = [not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i)) for i in every]
        bytes_ = sorted((file.id_to_piece(i), i) for i in every if file.is_byte(i))
        pieces = Pieces([file.id_to_piece(i) for i in every], [file.get_score(i) for i in every],
                        [i for _, i in bytes_], plain)
        if any(BLANK in t.lstrip(BLANK) for t in pieces.id):
            raise ValueError("a piece reaches across words")
        return pieces

    def __reduce__(self):
        return _held, (self.token, (self.texts, self.scores, self.byte_ids, [t in self.id for t in self.texts]))

    # --- edges -----------------------------------------------------------------------------------

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, end, id)`` of every occurrence of every piece in ``text``, by end and then by start."""
        order = suffix_array(text, self.longest)
        codes = _codes(text)
        low, high, sizes = self._ranges(codes, order)
        count = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
        start = order[at]
        end = start + np.repeat(sizes, count)
        piece = np.repeat(np.fromiter(self.id.values(), np.int64, len(self.id)), count)
        sort = np.lexsort((start, end))
        return start[sort], end[sort], piece[sort]

    def _ranges(self, codes: np.ndarray, order: np.ndarray):
        """Suffix range of each piece, found by one binary search for all pieces, character by character."""
        names = [t for t in self.id]
        sizes = np.array([len(t) for t in names])
        table = np.zeros((len(names), self.longest), np.int64)
        flat = _codes("".join(names))
        row = np.repeat(np.arange(len(names)), sizes)
        table[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        padded = np.concatenate([codes, np.full(self.longest + 1, -1)])
        low, high = np.zeros(len(names), np.int64), np.full(len(names), len(order))
        for depth in range(self.longest):
            live = np.flatnonzero((sizes > depth) & (low < high))
            want = table[live, depth]
            for right in (False, True):
                a, b = low[live].copy(), high[live].copy()
                while True:
                    open_ = np.flatnonzero(a < b)
                    if not len(open_):
                        break
                    middle = (a[open_] + b[open_]) >> 1
                    c = padded[order[middle] + depth]
                    less = (c <= want[open_]) if right else (c < want[open_])
                    a[open_] = np.where(less, middle + 1, a[open_])
                    b[open_] = np.where(less, b[open_], middle)
                if right:
                    high[live] = a
                else:
                    first = a
            low[live] = first
        return low, np.maximum(low, high), sizes

    # --- merging ---------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging neighbours, best score first and leftmost among equals."""
        part = list(text)
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part):
                joined = part[i] + part[after[i]]
                if joined in self.id:
                    heapq.heappush(heap, (-self.scores[self.id[joined]], i, joined))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if part[i] is None or after[i] >= len(part) or part[i] + part[after[i]] != joined:
                continue
            j = after[i]
            part[i], part[j] = joined, None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p is not None]

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces ``right`` may come after ``left`` (ids; -1 stands for a character without a piece)."""
        keys, back = np.unique(left * len(self.texts) + right, return_inverse=True)
        known, fits = self.pairs
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        ok = np.ones(len(keys), bool)
        ok[hit] = fits[at[hit]]
        for i in np.flatnonzero(~hit & (keys >= 0)).tolist():
            key = int(keys[i])
            if key not in self.fresh:
                a, b = (self.texts[x] for x in divmod(key, len(self.texts)))
                self.fresh[key] = self.merged(a + b) == [a, b]
            ok[i] = self.fresh[key]
        if len(self.fresh) > FRESH:
            every = np.concatenate([known[:PAIRS], np.fromiter(self.fresh, np.int64, len(self.fresh))])
            good = np.concatenate([fits[:PAIRS], np.fromiter(self.fresh.values(), bool, len(self.fresh))])
            sort = np.argsort(every)
            self.pairs, self.fresh = (every[sort], good[sort]), {}
        return ok[back.ravel()]

    # --- words -----------------------------------------------------------------------------------

    def learn(self, words: Iterable[str]) -> None:
        """Pieces of new words, all at once; single characters without a piece stand for themselves."""
        words = sorted(words, key=lambda w: (-len(w), w))
        text = "\x00".join(words)
        start, end, piece = self.edges(text)
        cut = np.searchsorted(end, np.arange(len(text) + 2))
        size = np.array([len(w) for w in words])
        first = np.cumsum(size + 1) - size - 1
        # The last piece of each prefix: where it starts, and its id.
        last, own = np.arange(-1, len(text)), np.full(len(text) + 1, -1)
        for step in range(1, int(size[0]) + 1):
            begin = first[:np.searchsorted(-size, -step, "right")]     # of the words that are that long
            stop, edge = begin + step, cut[begin + step]
            while True:
                live = np.flatnonzero(edge < cut[stop + 1])
                if not len(live):
                    break
                stop, edge, begin = stop[live], edge[live], begin[live]
                s, right = start[edge], piece[edge]
                fits = s == begin
                ask = np.flatnonzero(s > begin)
                fits[ask] = self.may_follow(own[s[ask]], right[ask])
                last[stop[fits]], own[stop[fits]] = s[fits], right[fits]
                stop, edge, begin = stop[~fits], edge[~fits] + 1, begin[~fits]
        at, word, found = first + size, np.arange(len(words)), []
        while len(at):
            found.append((word, own[at], at))
            at = last[at]
            on = at > first[word]
            at, word = at[on], word[on]
        if not found:
            return
        depth = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        word, ids, at = (np.concatenate([f[k] for f in found]) for k in range(3))
        sort = np.lexsort((-depth, word))
        word, ids, at = word[sort], ids[sort], at[sort]
        flat, ends = ids.astype(self.kind), np.searchsorted(word, np.arange(len(words) + 1))
        width, raw = self.kind().itemsize, flat.tobytes()
        bounds = (ends * width).tolist()
        self.words.update((w, raw[x:y]) for w, x, y in zip(words, bounds, bounds[1:]))
        for w in np.unique(word[ids < 0]).tolist():
            out: list[int] = []
            for i, stop in zip(ids[ends[w]:ends[w + 1]].tolist(), at[ends[w]:ends[w + 1]].tolist()):
                out += [i] if i >= 0 else [self.byte_ids[b] for b in text[stop - 1].encode("utf-8", "replace")]
            self.words[words[w]] = np.array(out, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: spaces are marks, and a mark goes before the first word."""
        if len(self.words) > KEPT:
            self.words.clear()
        split = [words_of(t) for t in texts]
        new = {w for ws in split for w in ws if w not in self.words}
        if new:
            self.learn(new)
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), self.kind).astype(np.int32) for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes joined, marks as spaces, the first mark dropped."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def words_of(text: str) -> list[str]:
    """A text cut where a mark follows something else: no piece reaches across such a place."""
    if not text:
        return []
    chunks = (BLANK + text.replace(" ", BLANK)).split(BLANK)
    out, blanks = [], 0
    for chunk in chunks[1:]:
        blanks += 1
        if chunk:
            out.append(BLANK * blanks + chunk)
            blanks = 0
    return out + [BLANK * blanks] if blanks else out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def suffix_array(text: str, depth: int) -> np.ndarray:
    """Places of ``text`` sorted by their next ``depth`` characters at least, by prefix doubling."""
    codes = _codes(text)
    if not len(codes):
        return np.zeros(0, np.int64)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-width or None] = rank[width:] if width < len(rank) else 0
        pair = rank * (len(rank) + 2) + nxt
        order = np.argsort(pair, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[1], np.diff(pair[order]) != 0]))
        if rank[order[-1]] == len(rank):
            break
        width *= 2
    return order


def encoded(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_pieces, ids, round_trip)`` for each row of ``docs``, from the whole text.

    Null and empty texts have no ids. ``round_trip`` says whether decoding the ids gives the text back, which it does
    unless a text holds the mark U+2581 itself. Rows that repeat are encoded alike; other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = pieces.encode(texts)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            back = [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(ends), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                pa.array(back, pa.bool_())], ["key", "n_pieces", "ids", "round_trip"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, n_pieces bigint, ids array<int>, round_trip boolean"
                           ).withColumnRenamed("key", key)


def decoded(rows: DataFrame, pieces: Pieces, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` of rows of ids; null ids give a null text."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([None if x is None else pieces.decode(x)
                                           for x in batch.column(1).to_pylist()], pa.string())], ["key", "text"])

    return rows.select(F.col(key).cast("bigint").alias("key"), F.col(ids).alias("ids")).mapInArrow(
        run, "key bigint, text string").withColumnRenamed("key", key)
