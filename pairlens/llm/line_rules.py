"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself (end punctuation, navigation, boilerplate, shouting, symbols), failing lines are removed, and a
document that loses too large a share of its text goes. Whole-document counts stand beside that as hard base rules.
Everything happens within the row: nothing is exploded or shuffled.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import key_and_text

#: White space that ends a word: space and 09 to 0D.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Marks that end a sentence, and what may close after one.
ENDINGS = ".!?:;…。！？"
CLOSING = "\"'”’»)]"
#: Characters at a line's end among which its end mark is looked for.
TAIL = 8
SEPARATORS = "|»›•"
#: Phrases, in lower case, of lines that say nothing about a document's subject.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie",
    "javascript",
    "lorem ipsum",
    "click here",
    "subscribe",
    "skip to content",
    "powered by",
    "copyright",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are of characters other than spaces.

    A line needs an end mark only from ``long_line`` words on, and a shouting line has at least ``shout_words`` words.
    """

    min_words: int = 50
    repeat_percent: int = 50
    long_line: int = 8
    separators: int = 3
    shout_words: int = 3
    symbol_share: float = 0.05
    lost_share: float = 0.5


def words_of(text: Column) -> Column:
    """The words of a text; an empty array if there is none."""
    return F.array_remove(F.split(text, SPACE), "")


def count_of(text: Column, characters: str) -> Column:
    """How often one of the characters occurs; plain replacements scan bytes and beat a translation by far."""
    return F.length(text) - F.length(reduce(lambda rest, c: F.replace(rest, F.lit(c)), characters, text))


def dense(text: Column) -> Column:
    """Characters but for spaces."""
    return F.length(F.replace(text, F.lit(" ")))


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACES)) != ""


def has_boilerplate(lowered: Column) -> Column:
    return reduce(Column.__or__, [lowered.contains(phrase) for phrase in BOILERPLATE])


def line_passes(line: Column, lowered: Column, rules: Rules) -> Column:
    """Whether a line passes all line rules, given it in lower case too; a line without words always does.

    The rules: a long line ends like a sentence; it is no row of a menu (``separators`` bars or arrows, not over five words
    for each); it holds no boilerplate phrase; it isn't all capitals; symbols are few. What the whole text has none of
    (columns n_symbols, n_separators, boilerplate) is not looked for in its lines.
    """
    chars = dense(line)
    n_words = F.length(line) - chars + 1
    separators = count_of(line, SEPARATORS)
    menu = (F.col("n_separators") >= rules.separators) & (separators >= rules.separators) & (n_words <= 5 * separators)
    # Trimming a set of characters walks the whole text it is given, so it is given the end alone.
    last = F.right(F.rtrim(F.rtrim(F.right(line, F.lit(TAIL)), F.lit(SPACES)), F.lit(CLOSING)), F.lit(1))
    unended = ~last.isin(*ENDINGS) & (n_words >= rules.long_line)
    boilerplate = F.col("boilerplate") & has_boilerplate(lowered)
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (n_words >= rules.shout_words)
    symbols = (F.col("n_symbols") > 0) & (count_of(line, SYMBOLS) > rules.symbol_share * chars)
    return ~has_word(line) | ~(menu | unended | boilerplate | shouting | symbols)


def judged(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, base_failed, clean_text (the lines that pass), lost_chars and kept, a row per document.

    Null text is empty; a text without words has all counts zero and fails the base rules. Repeated rows and ids are judged
    row by row.
    """
    return _judge(key_and_text(documents), ["doc_id"], rules)


def clean(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns, their text reduced to the lines that pass."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row")
    found = _judge(documents.select(row, F.coalesce("text", F.lit("")).alias("text")), ["__row"], rules)
    # A filter on what the rules made would be pushed below them and compute them again; it isn't pushed below a row number.
    found = found.withColumn("__number", F.monotonically_increasing_id()).filter("kept AND __number >= 0")
    made = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return found.select(*[made.get(c, F.col("__row").getField(c)).alias(c) for c in documents.columns])


def _judge(frame: DataFrame, carried: list[str], rules: Rules) -> DataFrame:
    """Every step names what later steps use more than once, so that Spark computes it once."""
    split = frame.select(
        *carried,
        "text",
        words_of(F.col("text")).alias("words"),
        F.split("text", "\n").alias("lines"),
        F.lower("text").alias("lowered"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        count_of(F.col("text"), SEPARATORS).alias("n_separators"),
    ).withColumns({"boilerplate": has_boilerplate(F.col("lowered")), "lowered": F.split("lowered", "\n")})
    starts = F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    passing = F.filter("lines", lambda line, i: line_passes(line, F.get("lowered", i), rules))
    counted = split.select(
        *carried,
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        # A 64-bit hash of each 3-word window; the hash runs on from word to word and takes in their lengths.
        F.transform(starts, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))).alias("hashes"),
        F.filter("lines", has_word).alias("worded"),
        F.array_join(passing, "\n").alias("clean_text"),
    )
    # Most texts repeat no window, which the distinct hashes alone show; only others are sorted to find the places.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    names = [*carried, "n_words", "word_chars", "n_symbols", "worded", "clean_text"]
    sorted_ = counted.select(*names, dense(F.col("text")).alias("text_chars"), placed.alias("placed"))
    last = F.size("placed") - 1
    twice = F.filter(
        "placed",
        lambda x, j: ((j > 0) & (F.get("placed", F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))
        | ((j < last) & (F.get("placed", F.least(j + 1, last))["h"] == x["h"])),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + 2))))
    found = sorted_.select(
        *names,
        "text_chars",
        F.when(F.col("placed").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        (F.col("text_chars") - dense(F.col("clean_text"))).cast("long").alias("lost_chars"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    return found.select(
        *carried,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        "clean_text",
        "lost_chars",
        (~failed & (F.col("lost_chars") <= rules.lost_share * F.col("text_chars"))).alias("kept"),
    )
