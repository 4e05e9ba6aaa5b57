"""Operator 9: URL filters. Rules first, then naive Bayes over segmented host and path words.

Names of hosts are run together or hyphenated; a unigram model splits each label into words by the best path (Viterbi).
The unigram counts come from all URLs: from paths and from host labels with hyphens, whose words are told apart already;
a name that is run together is no word by itself, however often it stands. Naive Bayes is trained on all URLs too: a URL
whose segmented host holds one of the seed words is taken as an example of class block, any other as one of class allow, so that words which
go along with the seeds count as well. Counting runs on the cluster; the driver gets the VOCABULARY most frequent words
and their counts, and the totals of all words. Rarer words stay in tables on the cluster, which hosts (by the words that
they can be split into) and URLs (by their words) are joined with.

Defined results: a URL that is null or has no `://` has an empty host and path, no rule and the verdict of naive Bayes
for no words, which is the more frequent class (allow where all counts are zero). Rows are judged one by one; repeated
rows count as often as they stand. An empty table gives no rows. No input columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.common import cut

# The rules, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# Words that mark a host as unwanted.
SEEDS = "ads adult bet bets betting casino gambling malware phishing pills poker porn spam torrent viagra warez xxx".split()
# Frequent English words of host names, so that names are split where the corpus has only the whole.
COMMON = "best big blog book buy card cheap club daily farm fast free game games health home info life live mail media money music net new news now online page photo play real shop site sport store time top track travel video web win work world".split()

VOCABULARY = 50_000
LONGEST = 24
SEED_COUNT = 50
MEMO = 200_000
WORD = re.compile(r"[^\W\d_]+")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), upper, lower)
    return host, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest stands outermost
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


@dataclass
class Segmenter:
    """Viterbi over unigrams; unknown words cost more the longer they are."""

    counts: dict[str, int]
    rest: int = 0  # how often words without a count here stand
    memo: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        for w in (*SEEDS, *COMMON):
            self.counts[w] = self.counts.get(w, 0) + SEED_COUNT
        self.total = math.log(sum(self.counts.values()) + self.rest)
        self.cost = {w: self.total - math.log(n) for w, n in self.counts.items()}

    def label(self, text: str, rare: dict[str, int] | None = None) -> list[str]:
        """The words of a label; rare: counts of the other words that it holds."""
        if text in self.memo:
            return self.memo[text]
        cost = self.cost | {w: self.total - math.log(n) for w, n in rare.items() if w not in self.cost} if rare else self.cost
        best, back = [0.0] + [math.inf] * len(text), [0] * (len(text) + 1)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - LONGEST), j):
                c = best[i] + cost.get(text[i:j], self.total + 2.5 * (j - i))
                if c < best[j]:
                    best[j], back[j] = c, i
        out, j = [], len(text)
        while j:
            out.append(text[back[j] : j])
            j = back[j]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[text] = out[::-1]
        return self.memo[text]

    def parts(self, host: str) -> set[str]:
        """What a host's words without a count here could be."""
        return {label[i:j] for label in WORD.findall(host) for i in range(len(label)) for j in range(i + 1, min(len(label), i + LONGEST) + 1)} - self.cost.keys()

    def words(self, host: str, path: str, rare: dict[str, int] | None = None) -> tuple[list[str], list[str]]:
        return [w for label in WORD.findall(host) for w in self.label(label, rare)], [w.lower() for w in WORD.findall(path)]


@dataclass
class Bayes:
    """Multinomial naive Bayes with add-one smoothing."""

    allow: dict[str, int]
    block: dict[str, int]
    rows: tuple[int, int]  # allow, block
    rest: tuple[int, int, int] = (0, 0, 0)  # words without counts here, and how often they stand in either class

    def __post_init__(self):
        size = len({*self.allow, *self.block}) + self.rest[0] + 1
        self.totals = sum(self.allow.values()) + self.rest[1] + size, sum(self.block.values()) + self.rest[2] + size
        self.odds = {w: math.log((self.block.get(w, 0) + 1) / self.totals[1]) - math.log((self.allow.get(w, 0) + 1) / self.totals[0]) for w in {*self.allow, *self.block}}
        self.prior = math.log((self.rows[1] + 1) / (self.rows[0] + 2))

    def score(self, words: list[str]) -> float:
        """Log odds of block."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


def _with_rare(parsed: DataFrame, segmenter: Segmenter, counted: DataFrame) -> DataFrame:
    """parsed with a column rare: the words without a count in the segmenter that the host holds, and their counts."""

    def run(batches):
        for batch in batches:
            held = [(h, w) for h in batch.column(0).to_pylist() for w in sorted(segmenter.parts(h))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.string()) for k in (0, 1)], names=["host", "w"])

    parts = parsed.select("host").distinct().mapInArrow(run, "host string, w string")
    found = parts.join(counted, "w").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("rare"))
    return parsed.join(cut(found), "host", "left").select(*parsed.columns, "rare")


def _rare(batch: pa.RecordBatch, k: int) -> list[dict | None]:
    """Column k as dictionaries, nothing where there is no such column."""
    return [r and dict(r) for r in batch.column(k).to_pylist()] if batch.num_columns > k else [None] * batch.num_rows


def train(parsed: DataFrame, vocabulary: int = VOCABULARY) -> tuple[DataFrame, Segmenter, Bayes, DataFrame | None]:
    """parsed: host, path and others. Counts over all rows; at most `vocabulary` words of each kind come to the driver.

    Gives parsed (with a column rare at the end, if there are more words), the models of the frequent words, and the
    counts of all words (w, b in class block, n) if there are more than Bayes holds.
    """
    parted = F.array_join(F.filter(F.split("host", "[.]"), lambda label: F.contains(label, F.lit("-"))), " ")
    word = F.explode(F.split(F.concat_ws(" ", parted, F.lower("path")), r"[^\p{L}]+"))
    counted = cut(parsed.select(word.alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    top = {r["w"]: r["n"] for r in counted.orderBy(F.desc("n"), "w").limit(vocabulary).collect()}
    top |= {r["w"]: r["n"] for r in counted.where(F.col("w").isin(*SEEDS, *COMMON)).collect()}
    size, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    more, rest = size > len(top), total - sum(top.values())
    segmenter = Segmenter(top, rest)
    if more:
        parsed = _with_rare(parsed, segmenter, counted)
    seeds = set(SEEDS)

    def run(batches):
        for batch in batches:
            host, path = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found: Counter = Counter()
            for h, p, rare in zip(host, path, _rare(batch, 2)):
                words, more = segmenter.words(h, p, rare)
                block = not seeds.isdisjoint(words)
                found[None, block] += 1
                for w in (*words, *more):
                    found[w, block] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], names=["w", "block", "n"])

    sums = cut(parsed.select("host", "path", *["rare"] * more).mapInArrow(run, "w string, block boolean, n long").groupBy("w").agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"), F.sum("n").alias("n")))
    rows = sums.where("w IS NULL").collect()
    sums = sums.where("w IS NOT NULL")
    top = sums.orderBy(F.desc("n"), "w").limit(vocabulary).collect()
    size, block, total = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    block -= sum(r["b"] for r in top)
    rest = size - len(top), total - sum(r["n"] for r in top) - block, block
    n, b = (rows[0]["n"], rows[0]["b"]) if rows else (0, 0)
    bayes = Bayes({r["w"]: r["n"] - r["b"] for r in top if r["n"] > r["b"]}, {r["w"]: r["b"] for r in top if r["b"]}, (n - b, b), rest)
    return parsed, segmenter, bayes, sums if rest[0] else None


def _rare_odds(scored: DataFrame, bayes: Bayes, sums: DataFrame) -> DataFrame:
    """scored with the odds of its words without odds in the model, added up in an order-free way."""
    odds = F.log((F.col("b") + 1) / F.lit(bayes.totals[1])) - F.log((F.col("n") - F.col("b") + 1) / F.lit(bayes.totals[0]))
    urls = scored.select("host", "path", "other").where(F.size("other") > 0).dropDuplicates(["host", "path"])
    words = urls.select("host", "path", F.explode("other").alias("w")).join(sums, "w")
    more = words.groupBy("host", "path").agg(F.sum(odds.cast("decimal(28,18)")).cast("double").alias("more"))
    return scored.join(more, ["host", "path"], "left").withColumn("odds", F.col("odds") + F.coalesce("more", F.lit(0.0)))


def filter_urls(df: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, vocabulary: int = VOCABULARY) -> DataFrame:
    """(id_column, host, path, rule, verdict, block_odds) for each row; block_odds is what naive Bayes says."""
    host, path = split_url(df[url_column].cast("string"))
    parsed = df.select(F.col(id_column), host.alias("host"), path.alias("path"))
    parsed, segmenter, bayes, sums = train(parsed, vocabulary)

    def run(batches):
        for batch in batches:
            odds, other = [], []
            for h, p, rare in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _rare(batch, 3)):
                words, more = segmenter.words(h, p, rare)
                odds.append(bayes.score([*words, *more]))
                other.append([w for w in (*words, *more) if w not in bayes.odds])
            columns = [*batch.columns[:3], pa.array(odds, pa.float64()), pa.array(other, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns[: len(schema)], names=schema.names)

    fields = [T.StructField(id_column, df.schema[id_column].dataType), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("odds", T.DoubleType())]
    if sums is not None:
        fields.append(T.StructField("other", T.ArrayType(T.StringType())))
    schema = T.StructType(fields)
    scored = parsed.mapInArrow(run, schema)
    if sums is not None:
        scored = _rare_odds(scored, bayes, sums)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(id_column, "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("odds") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.round("odds", 6).alias("block_odds"))
