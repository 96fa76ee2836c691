r"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

A rule rejects a document by a condition over its text and its words. The rules run one
after another and stop at the first that rejects, so that what later rules measure isn't
measured, and their order decides the cost, never the verdict. The order comes from a sample
of rows, bounded by ``SAMPLE_ROWS``: each rule is timed on the sample's raw texts and its
rejections are counted; rules are tried in descending order of rejections per cost.

Words are ``[^\x20\x09-\x0D]+``. Windows of three words are compared by a 64-bit hash
chained over them (XXH64); two different windows of one text with equal hashes would
count as repeats, which at 10^5 words in a text happens once in 10^9 such texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of, written

#: Rows about which the cascade's order is estimated on; it affects speed alone.
SAMPLE_ROWS = 1000

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Mean characters of a word.
MIN_WORD_CHARS, MAX_WORD_CHARS = 3, 10
MAX_SYMBOLS_PERCENT = 10
#: Half, not the customary 30 %: one repeated line of three is no sign of junk in a short text.
MAX_DUP_LINES_PERCENT = 50
MIN_ALPHA_PERCENT = 80
MAX_BULLET_PERCENT = 90
MAX_ELLIPSIS_PERCENT = 30


def _contains(sorted_values: Column, value: Column) -> Column:
    """Whether a sorted array has the value: by a scan if it is short, else by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(31))])
    n = F.size(sorted_values)
    at = F.aggregate(
        steps, F.lit(0),
        lambda at, by: F.when((by <= n - at) & (F.get(sorted_values, at + by - 1) <= value), at + by).otherwise(at),
    )
    return F.when(n <= 16, F.array_contains(sorted_values, value)).otherwise(F.coalesce(F.get(sorted_values, at - 1) == value, F.lit(False)))


def repeat_words(words: Column) -> Column:
    """Words that stand in a window of three words found twice or more, the first one included."""

    def counted(hashes: Column) -> Column:
        return let(F.sort_array(hashes), lambda s: let(
            F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)) & ((i == 1) | (x != F.get(s, i - 2)))),
            lambda twice: F.when(F.size(twice) == 0, F.lit(0)).otherwise(covered(hashes, twice)),
        ))

    def covered(hashes: Column, twice: Column) -> Column:
        places = F.filter(F.transform(hashes, lambda x, i: F.when(_contains(twice, x), i)), lambda i: i.isNotNull())
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), i - F.get(p, k - 1)))), F.lit(0), lambda a, x: a + x
        ))

    return F.when(
        F.size(words) >= 3,
        let(
            F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
            counted,
        ),
    ).otherwise(F.lit(0)).cast("long")


#: A text's measures, by name.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


class Text:
    """A text's measures (columns), made when they are asked for. A null text has no words and no
    lines, so all are 0."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = F.coalesce(text, F.lit("")), words

    @property
    def lines(self) -> Column:
        """Lines with a word."""
        return F.filter(F.split(self.text, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\f\r", "    ")) != "")

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    @property
    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, "")).cast("long")

    @property
    def n_symbols(self) -> Column:
        return F.regexp_count(self.text, F.lit(r"[#*$%&|<>]")).cast("long")

    @property
    def n_lines(self) -> Column:
        return F.size(self.lines).cast("long")

    @property
    def n_dup_lines(self) -> Column:
        return let(self.lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))

    @property
    def n_repeat_words(self) -> Column:
        return repeat_words(self.words)


class Measured:
    """The same as columns of a measured table."""

    def __init__(self, text: Column, prefix: str):
        self.text = F.coalesce(text, F.lit(""))
        for name in MEASURES:
            setattr(self, name, F.col(prefix + name))


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with columns n_words, word_chars, n_symbols, n_lines (with a word),
    n_dup_lines, n_repeat_words (all long), each name after ``prefix``. Columns of those
    names are replaced."""
    text = F.col(f"`{text_col}`")
    return docs.withColumn(f"{prefix}words", words_of(text)).withColumns({prefix + m: getattr(Text(text, F.col(f"{prefix}words")), m) for m in MEASURES}).drop(f"{prefix}words")


@dataclass(frozen=True)
class Rule:
    """Rejects a text, given as ``Text`` or ``Measured``, where the condition is true (null: not)."""

    name: str
    rejects: Callable[[Text | Measured], Column]


def rules() -> list[Rule]:
    """The default rules. The thresholds are this module's constants."""
    return [
        Rule("few_words", lambda m: m.n_words < MIN_WORDS),
        Rule("repeated_words", lambda m: 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words),
        Rule("word_length", lambda m: let(m.word_chars, lambda n: (n < MIN_WORD_CHARS * m.n_words) | (n > MAX_WORD_CHARS * m.n_words))),
        Rule("symbols", lambda m: 100 * m.n_symbols > MAX_SYMBOLS_PERCENT * m.n_words),
        Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > MAX_DUP_LINES_PERCENT * m.n_lines),
        Rule("words_without_letters", lambda m: 100 * F.regexp_count(m.text, F.lit(r"(?<![^ \t-\r])[^ \t-\r\p{L}]++(?![^ \t-\r])")) > (100 - MIN_ALPHA_PERCENT) * m.n_words),
        # without a find there is nothing to compare with the lines
        Rule("bullets", lambda m: let(F.regexp_count(m.text, F.lit(r"(?m)^[ \t]*[-*•]")), lambda n: (n > 0) & (100 * n > MAX_BULLET_PERCENT * m.n_lines))),
        Rule("ellipses", lambda m: let(F.regexp_count(m.text, F.lit(r"(?m)(\.\.\.|…)[ \t]*$")), lambda n: (n > 0) & (100 * n > MAX_ELLIPSIS_PERCENT * m.n_lines))),
    ]


def verdict(own: list[Rule], of: Text | Measured) -> Column:
    """True where no rule rejects; the first that does ends the row's evaluation."""
    kept = F.lit(True)
    for r in reversed(own):
        kept = F.when(F.coalesce(r.rejects(of), F.lit(False)), F.lit(False)).otherwise(kept)
    return kept


def kept(text: Column, own: list[Rule]) -> Column:
    """The verdict on raw texts: the words are made once, all else by the rules that get to it."""
    return let(words_of(text), lambda w: verdict(own, Text(text, w)))


def ordered(docs: DataFrame, own: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on a sample of about ``sample_rows`` rows."""
    n = docs.count()
    if not n or len(own) < 2:
        return own
    text = F.col(f"`{text_col}`")
    sample = written(docs.select(text.alias("text")).where(F.rand(11) < min(1.0, sample_rows / n)), "rules-sample")

    def timed(keeps: Column) -> tuple[float, int]:
        took = []
        for _ in range(3):  # the first run also compiles
            began = time.perf_counter()
            got = sample.agg(F.count_if(~keeps).alias("n")).first()
            took.append(time.perf_counter() - began)
        return min(took[1:]), got["n"]

    base, score = timed(kept(F.col("text"), []))[0], {}
    for r in own:
        took, rejected = timed(kept(F.col("text"), [r]))
        score[r.name] = rejected / max(took - base, 1e-3)
    return sorted(own, key=lambda r: -score[r.name])


def judged(docs: DataFrame, text_col: str = "text", prefix: str = "", own: list[Rule] | None = None) -> DataFrame:
    """``docs`` with its measures, base_failed and kept, each name after ``prefix`` (columns of
    those names are replaced). All measures are asked for, so the cascade reads them.

    A null or empty text has no words and is rejected; repeated rows get the same
    verdict each; an empty table gives no rows; texts of any length are measured whole.
    """
    order = ordered(docs, own if own is not None else rules(), text_col)
    m = Measured(F.col(f"`{text_col}`"), prefix)
    base = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
    return measured(docs, text_col, prefix).withColumn(f"{prefix}base_failed", base).withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & verdict(order, m))


def accepted(docs: DataFrame, text_col: str = "text", own: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns as they are. Nulls, repeats, empty tables
    and long texts: as ``judged``."""
    return docs.where(kept(F.col(f"`{text_col}`"), ordered(docs, own if own is not None else rules(), text_col)))
