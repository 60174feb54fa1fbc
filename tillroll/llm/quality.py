"""Quality rules: lines are judged first, a document goes when too much of it has failed.

Everything is built-in column expressions, so no row leaves the JVM and no rule needs a shuffle:
the cost is that of one scan, whatever the sources or groups of copies look like.

Edge cases: a null text counts as empty and fails (fewer than ten words); repeated rows are judged alike;
an empty table gives an empty table; columns pass through untouched whatever their names, as the document and what is found out
about it are two structs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

#: Rules of lines.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_BARS_PER_WORD = 0.2
MAX_SHOUT_MARKS_PER_WORD = 0.3
SHORT_LINE_WORDS = 4
TERMINAL = ".!?:;,…。！？\"'”’»)]"
NAVIGATION = (
    r"(?i)^\s*(home|menu|search|log ?in|sign ?(in|up)|next|previous|back to top|skip to content|share|read more|"
    r"contact( us)?|about( us)?|sitemap|archives?|categories|tags)\s*[.:»>|]*\s*$"
)
BOILERPLATE = [
    "all rights reserved", "cookie policy", "uses cookies", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "subscribe to our", "click here to", "released under the", "licensed under the",
    "distributed under the",
]
#: A document goes when more than this share of its words stood in lines that failed.
MAX_LOST = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a window of five words which the text has twice or more.

    Windows are compared by 64-bit hashes within one text. Only texts with a repeated hash pay for the positions.
    """
    ahead = [lambda i, k=k: F.get(words, i + k) for k in range(1, WINDOW)]
    hashes = F.slice(
        F.transform(words, lambda x, i: F.xxhash64(x, *[at(i) for at in ahead])),
        F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)),
    )
    return hashes


def covered_words(hashes: Column) -> Column:
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes))


def _covered(hashes: Column) -> Column:
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    twice = lambda s: F.filter(
        s,
        lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
    )
    # A one-element array and transform bind a value to a name, so that it is computed once.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    positions = bound(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["p"])))
    return bound(
        positions,
        lambda p: F.aggregate(
            F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))),
                       lambda a, b: F.least(a - b, F.lit(WINDOW))),
            F.lit(WINDOW), lambda total, x: total + x,
        ),
    )


def without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def how_many(line: Column, mark: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))


def line_fails(line: Column, noisy: bool) -> Column:
    """True for a line that is navigation, boilerplate, shouting, symbol noise or a stub without an end mark.

    Words of a line are its parts between blanks. ``noisy`` tells whether the document may have symbols at all.
    """
    n = how_many(line, " ") + 1
    noise = without(line, r"[#*$%&|<>]{2,}") if noisy else F.lit(0)
    bars = how_many(line, "|") + how_many(line, "»") + how_many(line, "›") + how_many(line, "•")
    shouts = how_many(line, "!")
    low = F.lower(line)
    ends = F.instr(F.lit(TERMINAL), F.substring(F.rtrim(F.translate(line, "\t\r", "  ")), -1, 1)) > 0
    return (
        (noise > MAX_SYMBOLS_PER_WORD * n)
        | (bars > MAX_BARS_PER_WORD * n)
        | ((shouts > MAX_SHOUT_MARKS_PER_WORD * n) & (shouts >= 2))
        | ((n < SHORT_LINE_WORDS) & ~ends)
        | ((n < SHORT_LINE_WORDS) & line.rlike(NAVIGATION))
        | reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in BOILERPLATE])
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc``, the row as it is, and ``quality``: base counts, ``cleaned`` (the lines that stay), ``lost`` (share of words gone), ``kept``.

    A line goes when a rule for lines fails or when it repeats an earlier line; blank lines are left out of ``cleaned``.
    ``kept`` is false if a base rule fails or if more than half of the words stood in lines that went.
    """
    start = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = start.withColumns(
        {
            "words": words_of(F.col("text")),
            "lines": F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""),
        }
    )
    hashed = parts.withColumns({"hashes": repeat_words(F.col("words")), "distinct": F.array_distinct("lines")})
    counted = hashed.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": without(F.col("text"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size("distinct")).cast("long"),
            "n_repeat_words": covered_words(F.col("hashes")).cast("long"),
        }
    )
    # Two lambdas, as an expression of the whole text inside a lambda is computed anew for each line.
    noisy, plain = F.filter("distinct", lambda x: ~line_fails(x, True)), F.filter("distinct", lambda x: ~line_fails(x, False))
    cleaned = counted.withColumn("stay", F.when(F.col("n_symbols") > 0, noisy).otherwise(plain)).withColumn(
        "cleaned", F.array_join("stay", "\n")
    )
    base = cleaned.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "n_kept_words": F.when(F.size("stay") == F.size("lines"), F.col("n_words")).otherwise(
                F.size(words_of(F.col("cleaned"))).cast("long")
            ),
        }
    )
    lost = base.withColumn(
        "lost", F.when(F.col("n_words") == 0, F.lit(1.0)).otherwise(1 - F.col("n_kept_words") / F.col("n_words"))
    )
    verdict = lost.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= MAX_LOST))
    return verdict.select("doc", F.struct(*COUNTS, "cleaned", "base_failed", "n_kept_words", "lost", "kept").alias("quality"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = quality(docs)
    return found.select("doc.doc_id", *[f"quality.{c}" for c in (*COUNTS, "base_failed", "kept", "n_kept_words")])


def passed(docs: DataFrame) -> DataFrame:
    """The stage of the pipeline: documents that pass, with the failing lines gone from their text."""
    # The optimizer would push the verdict below the expressions that it is made of, and write them out once for each use;
    # a number that isn't deterministic keeps the filter where it is.
    judged = quality(docs).withColumn("row", F.monotonically_increasing_id()).filter("quality.kept AND row >= 0")
    replaced = {"text": F.col("quality.cleaned"), "n_chars": F.length("quality.cleaned").cast("long")}
    return judged.select(*[replaced.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
