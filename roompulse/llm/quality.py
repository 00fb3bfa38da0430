"""Line-first cleaning: rules judge lines, failing lines go, documents that lose too much are rejected.

Only DataFrame functions; every row is judged by itself, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roompulse.llm.columns import SPACE, WORD, words

# The line rules. Patterns run on a line without outer white space, in lower case. Groups
# repeat a fixed number of times only: open loops over groups overflow the stack on very long lines.
BOILERPLATE = (r"(all rights reserved|copyright|\(c\) [12][0-9]{3}|terms of (use|service)|privacy policy|"
               r"cookie|javascript|licensed under|public license|subscribe|sign up|log ?in|"
               r"click here|read more|back to top|share this)")
NAVIGATION = r"( [|»›·] [^|»›·]*){3}"
SHOUTING = r"([!?]{2,}[^!?]*){3}"
MARKED = r"([#*$%&|<>]{3,}[^#*$%&|<>]*){3}"
BLANKS = " \t\n\x0b\x0c\r"
LAST = r"[.!?…:;,)\"'”»]$"

# The same rules for text whose paragraphs are not broken into lines: what they find must be a good part of the line.
PHRASES = (r"(?<![\p{L}\p{N}_])(all rights reserved|copyright|\(c\) [12][0-9]{3}|terms of (use|service)|privacy policy|"
           r"cookies?|javascript|licensed under|public license|subscribe|sign up|log ?in|click here|read more|"
           r"back to top|share this)(?![\p{L}\p{N}_])")
SEPARATOR = r" [|»›·] "
SHOUT = r"[!?]{2,}"
SYMBOLS = r"[#*$%&|<>]{3,}"
SENTENCE_END = r"""[.!?…:;][)"\'”’»\]]*(?=[ \t-\r]|$)|[。！？；．।॥؟؛۔։።፧၊။៕᠃]"""

MIN_WORDS = 50          # of a document
MAX_REPEATED = 50       # per cent of words in repeated three-word windows
UNENDED_WORDS = 12      # a line of so many words must end with punctuation
SHORT_WORDS = 20        # a shorter line fails by one phrase
PHRASE_SHARE = 20       # per cent of a longer line's characters that phrases must fill
HIT_WORDS = 10          # three separators, shouts or groups of symbols count if there is one in so many words
MIN_LEFT = 50           # per cent of the characters in words that clean lines must hold


def _let(value: Column, body) -> Column:
    """``body`` of a value computed once: a lambda variable is never evaluated again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(ws: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""
    windows = F.when(F.size(ws) < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(
        F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.struct(
            F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p"))))

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        starts = F.sort_array(F.transform(again, lambda x: x["p"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"),
                                  p.alias("last")),
            lambda a: a["n"])
    return _let(F.sort_array(windows), covered)


def _chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.regexp_replace(text, SPACE, "")).cast("bigint")


def failing_line(line: Column) -> Column:
    """Whether a line breaks a rule; lines without a word never do."""
    low = F.lower(F.trim(line, F.lit(BLANKS)))
    return (low.rlike(BOILERPLATE) | low.rlike(NAVIGATION) | low.rlike(SHOUTING) | low.rlike(MARKED)
            | ((F.regexp_count(low, F.lit(WORD)) >= UNENDED_WORDS) & ~low.rlike(LAST)))


def failing_share(line: Column) -> Column:
    """Whether what breaks a rule is a good part of the line, so that a whole text on one line does not fail by one hit."""
    low = F.lower(F.trim(line, F.lit(BLANKS)))
    n = F.regexp_count(low, F.lit(WORD))

    def dense(pattern: str) -> Column:
        hits = F.regexp_count(low, F.lit(pattern))
        return (hits >= 3) & (hits * HIT_WORDS >= n)
    filled = F.length(low) - F.length(F.regexp_replace(low, PHRASES, ""))
    return ((low.rlike(PHRASES) & ((n < SHORT_WORDS) | (filled * 100 >= F.length(low) * PHRASE_SHARE)))
            | dense(SEPARATOR) | dense(SHOUT) | dense(SYMBOLS)
            | ((n >= UNENDED_WORDS) & ~low.rlike(LAST) & ~low.rlike(SENTENCE_END)))


def clean_lines(text: Column, failing: Callable[[Column], Column] = failing_line) -> Column:
    """The text without the lines that break a rule; null stays null."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~failing(x)), "\n")


def judged(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS,
           max_repeated: int = MAX_REPEATED, min_left: int = MIN_LEFT,
           failing: Callable[[Column], Column] = failing_line) -> DataFrame:
    """``docs`` with its columns in a struct ``doc`` and the verdict beside it, row by row.

    Columns: ``doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, clean_chars,
    base_failed, kept``. Null and empty texts have no words and fail. A document stays if it passes the base
    rules and at least ``min_left`` per cent of the characters of its words lie in lines that break no rule.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), body.alias("body"),
        _let(words(body), lambda ws: F.struct(
            F.size(ws).cast("bigint").alias("n_words"), _repeat_words(ws).alias("n_repeat_words"))
        ).alias("w"),
        _let(F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)), lambda ls: (
            F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint")).alias("n_dup_lines"))
    rows = counted.select(
        "doc", F.col("w.n_words").alias("n_words"), _chars(F.col("body")).alias("word_chars"),
        F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        "n_dup_lines", F.col("w.n_repeat_words").alias("n_repeat_words"),
        _chars(clean_lines(F.col("body"), failing)).alias("clean_chars"))
    failed = ((F.col("n_words") < min_words)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated))
    return rows.select("*", failed.alias("base_failed")).select("*", (
        ~F.col("base_failed") & (F.col("clean_chars") * 100 >= F.col("word_chars") * min_left)
    ).alias("kept"))


def good_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the documents that ``judged`` rejects when it judges lines by the share of
    them that breaks a rule."""
    return judged(docs, text, failing=failing_share).filter("kept").select("doc.*")
