"""Operator 8: quality rules. A table of thresholds is compiled into one projection of built-in functions.

Defined results: a null text has no words, so it fails the base rule; a text that is all white space likewise. Rows
are judged one by one: repeated rows repeat their verdict, ties cannot arise, an empty table gives no rows. Extra
columns are kept by `kept_rows` and `apply_rules(..., keep=True)`; a count or verdict whose name an input column has is
then called rule_ and its name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
GRAM = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on with as was by are be this from or an at "
    "der die das und in zu den von mit ist ein eine im für auf des nicht sich dem auch als "
    "le la les de et des un une en est que dans pour qui par sur au du ne pas ou "
    "el los las y del una por con para se su al lo como más o no"
).split()
STOP_FORMS = list(dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))


@dataclass(frozen=True)
class Rule:
    """least <= 100 * numerator / denominator <= most, asked of texts of at least `words` words."""

    name: str
    numerator: str
    denominator: str
    least: int | None = None
    most: int | None = None
    words: int = 0

    def column(self) -> Column:
        n, d = 100 * F.col(f"metrics.{self.numerator}"), F.col(f"metrics.{self.denominator}")
        tests = [n >= self.least * d] if self.least is not None else []
        tests += [n <= self.most * d] if self.most is not None else []
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out | (F.col("metrics.n_words") < self.words) if self.words else out


#: Of every text; a text that fails one has failed the base.
BASE = (
    Rule("enough words", "n_words", "one", least=1000),
    Rule("repeated five-word windows", "n_repeat_words", "n_words", most=20),
)
#: The method's own thresholds, in hundredths.
THRESHOLDS = (
    Rule("mean word length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols a word", "n_symbols", "n_words", most=10),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=30),
    Rule("stop words", "n_stop", "n_words", least=4, words=40),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """The number of words that lie in a window of five which occurs twice or more in the text.

    Windows stand by their hashes; neighbours of one hash are compared by their words.
    """
    n = F.size(words)

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, j: F.when(j == 0, F.lit(GRAM)).otherwise(F.least(F.lit(GRAM), x - starts[j - 1])))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def twice(sorted_grams: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            def like(y: Column) -> Column:
                return (y["h"] == x["h"]) & (F.slice(words, y["i"] + 1, GRAM) == F.slice(words, x["i"] + 1, GRAM))

            before = F.when(j > 0, like(sorted_grams[j - 1])).otherwise(F.lit(False))
            after = F.when(j + 1 < F.size(sorted_grams), like(sorted_grams[j + 1])).otherwise(F.lit(False))
            return before | after

        return let(F.sort_array(F.transform(F.filter(sorted_grams, same), lambda x: x["i"])), covered)

    def of(grams: Column) -> Column:
        pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(F.sort_array(pairs), twice))

    grams = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[words[i + k] for k in range(GRAM)]))
    return F.when(n <= GRAM, F.lit(0)).otherwise(let(grams, of)).cast("bigint")


def _symbols(text: Column) -> Column:
    """How many symbols the text holds; a text without one costs a search only."""
    out = F.lit(0)
    for c in SYMBOLS:
        out = out + F.when(F.contains(text, F.lit(c)), F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).otherwise(F.lit(0))
    return out.cast("bigint")


def metrics(text: Column) -> Column:
    """A struct of all counts that the rules use, from one text column."""

    def lines_of(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    def words_of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            _repeated(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(STOP_FORMS))).cast("bigint").alias("n_stop"),
        )

    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.ltrim(s, F.lit(BLANKS)) != "")

    def flat(w: Column) -> Column:
        return let(let(lines, lines_of), lambda x: F.struct(*[w[c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_stop")], _symbols(text).alias("n_symbols"), x["n_lines"].alias("n_lines"), x["n_dup_lines"].alias("n_dup_lines"), F.lit(1).cast("bigint").alias("one")))

    return let(let(words, words_of), flat)


def judged(df: DataFrame, carried: list[str], text_column: str, thresholds: tuple[Rule, ...], base: tuple[Rule, ...]) -> DataFrame:
    """(c0, c1, ...: the carried columns, metrics: struct, base_failed, kept), so that no names can clash."""
    text = F.coalesce(df[text_column].cast("string"), F.lit(""))
    own = [f"c{k}" for k in range(len(carried))]
    # A generator of one row is a fence: what it makes is computed once, however often the rules refer to it.
    counted = df.select(*[df[c].alias(n) for c, n in zip(carried, own)], F.explode(F.array(metrics(text))).alias("metrics"))
    good, fine = F.lit(True), F.lit(True)
    for rule in base:
        good = good & rule.column()
    for rule in thresholds:
        fine = fine & rule.column()
    return counted.select(*own, "metrics", (~good).alias("base_failed"), (good & fine).alias("kept"))


def apply_rules(df: DataFrame, text_column: str = "text", thresholds: tuple[Rule, ...] = THRESHOLDS, base: tuple[Rule, ...] = BASE, keep: bool = False, id_column: str = "doc_id") -> DataFrame:
    """Counts, base_failed and kept for each row; with keep, all input columns as well."""
    own = df.columns if keep else [id_column]
    taken = {c.lower() for c in own}

    def name(c: str) -> str:
        while c.lower() in taken:
            c = f"rule_{c}"
        return c

    rows = judged(df, own, text_column, thresholds, base)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop"]
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], *[F.col(f"metrics.{c}").alias(name(c)) for c in counts], *[F.col(c).alias(name(c)) for c in ("base_failed", "kept")])


def kept_rows(df: DataFrame, text_column: str = "text", thresholds: tuple[Rule, ...] = THRESHOLDS, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The rows that the rules keep, with all columns of df and no others."""
    kept = judged(df, df.columns, text_column, thresholds, base).where("kept")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines FROM d),
g AS (SELECT doc_id, i, words[i:i + 4] AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM t) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(list_filter(words, lambda x: x IN (__STOP__))) AS BIGINT) AS n_stop
  FROM w LEFT JOIN r USING (doc_id))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND 100 * word_chars >= 200 * n_words AND 100 * word_chars <= 1500 * n_words
  AND 100 * n_symbols <= 10 * n_words AND 100 * n_dup_lines <= 30 * n_lines
  AND (100 * n_stop >= 4 * n_words OR n_words < 40) AS kept
FROM m
""".replace("__STOP__", ", ".join(f"'{w}'" for w in STOP_FORMS))
