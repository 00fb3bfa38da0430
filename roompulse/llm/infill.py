"""Fill-in-middle transformation by one regular expression with counted quantifiers per row.

``regexp_count`` gives the number n of code points. Two cut places a <= b follow from hashes of the row's id, and the
row's own pattern ``(.{a}+)(.{b-a}+)(.*)`` takes prefix, middle and suffix in one match: both counts are exact and
possessive, so the engine never steps back and its time is linear in the text. The replacement text of that match
puts the parts in the order of the form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks before prefix, suffix and middle, and how often forms occur (percent).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
FIM_PERCENT = 90
SPM_PERCENT = 20
# Code points that are counted as one match, so that a very long text never becomes a list of its code points.
BLOCK = 4096

_ORDER = {"psm": ((PREFIX, 1), (SUFFIX, 3), (MIDDLE, 2)), "spm": ((SUFFIX, 3), (PREFIX, 1), (MIDDLE, 2))}


def code_points(text: Column) -> Column:
    """Number of code points: whole blocks of ``BLOCK`` first, then the rest one by one."""
    whole = F.regexp_count(text, F.lit(f"(?s).{{{BLOCK}}}+")).cast("bigint") * BLOCK
    rest = F.substring(text, (whole + 1).cast("int"), F.lit(BLOCK))
    return whole + F.regexp_count(rest, F.lit("(?s)."))


def _draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of ``seed:key``; a null key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED,
                fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``(key, n, form, prefix_chars, middle_chars, body, output)``.

    ``body`` is the text, ``n`` its code points. The form is ``plain`` (``output`` is the text, the counts are null)
    for null and empty texts, texts that hold a mark already, and by draw; else ``psm`` or ``spm``. Draws depend on
    the key alone: repeated rows and rows with equal keys are cut by the same draws, rows without a key as if it
    were empty. Texts of any length are cut whole. No rows give no rows; other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.select("key", "body", code_points(F.col("body")).alias("n"), F.array(*_draws(F.col("key"), seed)).alias("h"))
    h = [F.col("h")[i] for i in range(4)]
    marked = F.col("body").contains(PREFIX) | F.col("body").contains(SUFFIX) | F.col("body").contains(MIDDLE)
    form = (F.when((F.col("n") == 0) | marked | (h[2] % 100 >= fim_percent), "plain")
            .when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    cuts = [h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)]
    rows = rows.select("key", "body", "n", form.alias("form"), F.least(*cuts).alias("a"),
                       (F.greatest(*cuts) - F.least(*cuts)).alias("m"))
    pattern = F.format_string(r"(?s)\A(.{%d}+)(.{%d}+)(.*)\z", "a", "m")
    orders = {f: "".join(f"{mark}${group}" for mark, group in order) for f, order in _ORDER.items()}
    swap = F.when(F.col("form") == "spm", orders["spm"]).otherwise(orders["psm"])
    cut = F.col("form") != "plain"
    return rows.select(
        F.col("key").alias(key), "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"),
        F.when(cut, F.col("m")).alias("middle_chars"), "body",
        F.when(cut, F.regexp_replace(F.col("body"), pattern, swap)).otherwise(F.col("body")).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone. A text of form ``psm`` or ``spm`` holds no mark, so the
    first mark of each kind is the one that was put in."""
    def parts(name: str) -> tuple[str, str]:
        order = _ORDER[name]
        taken = "".join(f"{mark}({'.*?' if i < 2 else '.*'})" for i, (mark, _) in enumerate(order))
        place = {group: i + 1 for i, (_, group) in enumerate(order)}
        return rf"(?s)\A{taken}\z", "".join(f"${place[g]}" for g in (1, 2, 3))
    spm, psm = parts("spm"), parts("psm")
    return (F.when(form == "plain", output).when(form == "spm", F.regexp_replace(output, F.lit(spm[0]), F.lit(spm[1])))
            .otherwise(F.regexp_replace(output, F.lit(psm[0]), F.lit(psm[1]))))
