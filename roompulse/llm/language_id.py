"""Language of texts by interpolated Kneser-Ney character models, one per language.

Models are sorted arrays of n-gram hashes with one column of probabilities per language. They are fitted on
a bounded sample of labelled rows, counted by Spark; the language with the lowest cross-entropy per character wins,
and thresholds from labelled rows that no model has seen say when even the best language is a poor fit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse.llm.columns import crc_fold
from roompulse.llm.wordhash import U, mix
from roompulse.session import staged

ORDER = 5
SAMPLE = 1500           # labelled rows per language that models are fitted on, as expected by their share
CHECKED = 5             # of the sampled rows, one in so many sets the thresholds and fits no model
FEW = 50                # a language with fewer sampled rows is fitted on all of them and has no threshold
QUANTILE = 0.995        # share of unseen labelled rows that a threshold accepts
PIECE = 1 << 19         # characters scored at a time
PAD = 1                 # stands before a text's first character
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point of each code point, and which are letters."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return lower, letter


def characters(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, row, letters)``: the texts in lower case with runs of other characters as one space, each after
    ``order - 1`` pads; the row of each code, -1 for pads; the number of letters per text."""
    lower, letter = _alphabet()
    pad = "\x00" * (order - 1)
    raw = np.frombuffer((pad + pad.join(x + "\x00" for x in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) + 1 for x in texts])
    row = np.full(len(raw), -1, np.int64)
    starts = np.cumsum(sizes + order - 1) - sizes
    for i, (s, n) in enumerate(zip(starts, sizes)):
        row[s:s + n] = i
    is_letter = letter[raw]
    letters = np.bincount(row[is_letter], minlength=len(texts))
    codes = np.where(is_letter, lower[raw], np.uint32(32))
    codes[row < 0] = PAD
    gap = (codes == 32) & (row >= 0)
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(gap[1:] & (gap[:-1] | (codes[:-1] == PAD)))
    return codes[keep], row[keep], letters


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` codes that end at each place; the first ``n - 1`` places hold nothing useful."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes), n, U)
        for j in range(n - 1, -1, -1):
            shifted = np.zeros(len(codes), U)
            shifted[j:] = codes[:len(codes) - j] if j else codes
            h = h * U(0x9E3779B97F4A7C15) + shifted
        return mix(h)


def _count(order: int):
    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes, row, _ = characters([t or "" for x, t in zip(langs, texts) if x == lang], order)
                places = np.flatnonzero(row >= 0)
                _, first, n = np.unique(_keys(codes, order)[places], return_index=True, return_counts=True)
                at = places[first]
                grams = codes[at[:, None] - np.arange(order - 1, -1, -1)]
                text = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(at), pa.string()),
                    pa.array([text[i:i + order] for i in range(0, len(text), order)], pa.string()),
                    pa.array(n, pa.int64())], ["lang", "gram", "n"])
    return run


class Models:
    """Probabilities of all languages for all n-grams that any language has, order by order."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """``grams``: per language the codes (rows of ``order``) and counts of its longest n-grams."""
        self.langs, self.order = langs, order
        every = np.unique(np.concatenate([g for g, _ in grams]), axis=0) if grams else np.zeros((0, order))
        self.floor = 1.0 / (len(np.unique(every[:, -1])) + 1) if len(every) else 1.0
        self.tables: list[tuple[np.ndarray, ...]] = []
        for n in range(1, order + 1) if len(every) else ():
            tails = np.unique(every[:, order - n:], axis=0)
            keys = self._row_keys(tails, n)
            own = np.argsort(keys)
            tails, keys = tails[own], keys[own]
            lower = self._shorter(tails[:, 1:], n - 1)
            chance = np.empty((len(keys), len(langs)))
            heads, back = np.unique(tails[:, :-1], axis=0, return_inverse=True)
            back = back.ravel()
            rest = np.ones((len(heads), len(langs)))
            for k, (g, c) in enumerate(grams):
                seen, weight = self._weights(g, c, n)
                at = np.searchsorted(keys, self._row_keys(seen, n))
                count = np.zeros(len(keys))
                count[at] = weight
                once, twice = (weight == 1).sum(), (weight == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                total = np.bincount(back, weights=count, minlength=len(heads))
                kinds = np.bincount(back, weights=count > 0, minlength=len(heads))
                rest[:, k] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                chance[:, k] = (np.maximum(count - discount, 0) / np.maximum(total[back], 1)
                                + rest[back, k] * lower[:, k])
            head_keys = self._row_keys(heads, n - 1) if n > 1 else np.zeros(1, U)
            sort = np.argsort(head_keys)
            self.tables.append((keys, chance, head_keys[sort], rest[sort]))
        self.limits = np.full(len(langs), np.inf)

    @staticmethod
    def _row_keys(rows: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(len(rows), n, U)
            for j in range(n):
                h = h * U(0x9E3779B97F4A7C15) + rows[:, j].astype(U)
            return mix(h)

    def _weights(self, grams: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and their counts: of the longest, occurrences; of shorter ones, distinct left neighbours."""
        if n == self.order:
            return grams, counts
        longer = np.unique(grams[:, self.order - n - 1:], axis=0)
        return np.unique(longer[:, 1:], axis=0, return_counts=True)

    def _shorter(self, rows: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full((len(rows), len(self.langs)), self.floor)
        keys, chance = self.tables[n - 1][:2]
        return chance[np.searchsorted(keys, self._row_keys(rows, n))]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(entropy, length, letters)``: nats per character of each text under each language."""
        codes, row, letters = characters(texts, self.order)
        total = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(codes), PIECE):
            begin = max(0, a - self.order)
            part = codes[begin:a + PIECE]
            keys = [_keys(part, n) for n in range(1, self.order + 1)]
            places = np.flatnonzero(row[a:a + PIECE] >= 0) + (a - begin)
            _, first, back = np.unique(keys[-1][places], return_index=True, return_inverse=True)
            at = places[first]
            chance = np.full((len(at), len(self.langs)), self.floor)
            for n, (known, p, heads, rest) in enumerate(self.tables, 1):
                hit, where = _find(known, keys[n - 1][at])
                head = np.zeros(len(at), U) if n == 1 else keys[n - 2][at - 1]
                ok, there = _find(heads, head)
                chance *= np.where(ok[:, None], rest[there], 1.0)
                chance[hit] = p[where[hit]]
            cost = -np.log(chance)
            own = row[a:a + PIECE][places - (a - begin)]
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(own, weights=cost[back.ravel(), k], minlength=len(texts))
        length = np.bincount(row[row >= 0], minlength=len(texts))
        return total / np.maximum(length, 1)[:, None], length, letters


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), bool), np.zeros(len(want), np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return keys[at] == want, at


def fitted(labelled: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Models:
    """Models from rows ``(key, lang, text)``. About ``sample`` rows per language, chosen by a hash of the key, are
    counted by Spark; their distinct n-grams, bounded by that sample, make the tables. Languages with fewer than ``FEW``
    of these rows are fitted on all of them."""
    # Written out, so that Spark knows how small it is and need not move the texts for the join.
    sizes = staged(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("all")), "language-sizes")
    grid = 1 << 20
    draw = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(grid))
    chosen = labelled.join(sizes, "lang").filter(draw < F.lit(sample * grid) / F.col("all"))
    many = F.least(F.col("all"), F.lit(sample)) >= FEW
    check = many & (F.pmod(F.xxhash64("key", F.lit(5)), F.lit(CHECKED)) == 0)
    fit = chosen.filter(~check).select("lang", "text")
    rows = fit.mapInArrow(_count(order), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).toArrow()
    lang = rows.column("lang").to_pylist()
    text = "".join(rows.column("gram").to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order)
    count = rows.column("n").to_numpy()
    langs = sorted(set(lang))
    of = np.array([langs.index(x) for x in lang], np.int64)
    grams = []
    for k in range(len(langs)):
        mine = codes[of == k]
        sort = np.lexsort(mine.T[::-1])
        grams.append((mine[sort], count[of == k][sort]))
    models = Models(langs, grams, order)
    if not langs:
        return models

    def unseen(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            entropy, _, letters = models.entropies([t or "" for t in batch.column(1).to_pylist()])
            keep = [i for i, x in enumerate(own) if x in langs and letters[i]]
            yield pa.RecordBatch.from_arrays([
                pa.array([own[i] for i in keep], pa.string()),
                pa.array([entropy[i, langs.index(own[i])] for i in keep], pa.float64())], ["lang", "entropy"])

    seen = chosen.filter(check).select("lang", "text").mapInArrow(unseen, "lang string, entropy double")
    for r in seen.groupBy("lang").agg(F.percentile("entropy", F.lit(QUANTILE)).alias("limit")).collect():
        models.limits[langs.index(r["lang"])] = r["limit"]
    return models


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3,
               held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """``(key, held_out, lang_pred, score, entropy, rejected)`` for each row of ``docs``.

    Learns from rows with a language whose crc32(key as text) modulo ``folds`` is not ``held_out``; predicts from the
    whole text alone. ``und`` with score 0 stands for texts that are null or hold no letter, or if nothing could be
    learned. ``score`` is the winner's share of likelihood over at most 100 characters at the text's mean rates;
    ``rejected`` says that the cross-entropy is above what ``QUANTILE`` of unseen rows of that language show.
    A null key counts as the empty text in the fold; rows that repeat are predicted alike.
    """
    fold = crc_fold(F.col(key), folds)
    labelled = docs.filter((fold != held_out) & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    models = fitted(labelled, sample)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            entropy, length, letters = models.entropies([t or "" for t in batch.column(2).to_pylist()])
            known = (letters > 0) & (len(models.langs) > 0)
            best = entropy.argmin(axis=1) if len(models.langs) else np.zeros(len(known), int)
            low = entropy.min(axis=1, initial=np.inf)
            gap = (entropy - low[:, None]) * np.minimum(length, 100)[:, None] if len(models.langs) else entropy
            score = np.where(known, 1 / np.maximum(np.exp(-gap).sum(axis=1), 1), 0.0)
            names = [models.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            rejected = [bool(k and e > models.limits[b]) for b, k, e in zip(best, known, low)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(names), pa.array(score),
                pa.array([float(e) if k else None for e, k in zip(low, known)], pa.float64()),
                pa.array(rejected, pa.bool_())],
                ["key", "held_out", "lang_pred", "score", "entropy", "rejected"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), (fold == held_out).alias("held_out"),
                       F.col(text).alias("text"))
    return rows.mapInArrow(run, (
        "key bigint, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"
    )).withColumnRenamed("key", key)
