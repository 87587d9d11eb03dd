"""Operator 12 -- URL filter: rules, then host word segmentation and naive Bayes.

A rule names a host and a path; it fits that host and its subdomains where the url's path
starts with the rule's path.  The longest rule that fits (host and path together,
then the longer host) decides.  Other urls are judged by their words: every run of
letters in host and path is split by a unigram Viterbi search over a dictionary of
words (``freebets`` becomes ``free bets``), and a multinomial naive Bayes model
scores the words.  The dictionary and the model's allowed class are the words of all
page texts; its blocked class are the words of a labelled table of names, smoothed by
the allowed class (Dirichlet prior of ``smoothing`` words).  A url is
blocked if its log odds, from prior odds of ``prior``, are above zero.

Fixed rules of the model.  Words have at most 20 letters; a piece of L letters
that is no word has probability 26^-L / N, N the dictionary's total.  A run of more
than 63 letters (no host label is as long) is one unknown word.  Escapes ``%xx`` end
a run.  Page text is the html without ``<...>``, lower-cased, in runs of letters;
scripts count too.  Word weights are whole multiples of 2^-20, so sums do not
depend on their order.

Scale.  Hosts and runs are made distinct before they are joined, and urls meet the rules of
their host salted by path.  The dictionary is joined by piece, not broadcast; pieces of up to three letters, which
most runs hold, are salted.  Runs that make up more than 1/1024 of all runs (1024
at most) are broadcast with their weights, the others joined.  A run has at most
63 * 20 pieces.

Defined cases.  A null url or one without ``://`` has empty host and path and is allowed by the
method, as is any url without a word.  Repeated rows and null ids stay, one row each.  An empty
table gives no rows; without labelled names every url is allowed.  Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.common import stage, table

WORD, NAME, SALTS, HOT = 20, 63, 16, 1024
UNIT = 1 << 20
PRIOR, SMOOTHING, ALPHA = 0.05, 50.0, 0.5

# The contract's rules (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Labelled names, the classifier's bounded training table.  A caller passes its own.
LABELLED = [
    ("block", "online casino bonus"), ("block", "casino win jackpot"), ("block", "poker slots spin"), ("block", "sports bets odds"),
    ("block", "free bets tips"), ("block", "adult video tube"), ("block", "porn xxx cams"), ("block", "sex chat escort dates"),
    ("block", "cheap pills"), ("block", "viagra pharmacy discount"), ("block", "weight loss pills"), ("block", "payday loans fast cash"),
    ("block", "crypto giveaway prize"), ("block", "spam links"), ("block", "link farm backlinks"), ("block", "ads tracker"),
    ("block", "track clicks popup ads"), ("block", "keygen crack warez torrent"), ("block", "replica watches cheap"), ("block", "phishing malware spam"),
    ("allow", "daily news"), ("allow", "city library"), ("allow", "open university"), ("allow", "health guide"), ("allow", "science journal"),
    ("allow", "weather report"), ("allow", "travel blog"), ("allow", "cooking recipes"), ("allow", "school museum"), ("allow", "government portal"),
]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return pages.withColumn("host", _lower(host)).withColumn("path", F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0))


def best_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``urls`` with column ``best``: the rule that decides, as a struct, or null."""
    spark = urls.sparkSession
    table_ = spark.createDataFrame([(h, len(h) + len(p), len(h), p, v, h + p) for v, h, p in rules],
                                   "suffix string, size int, host_size int, at string, says string, rule string")
    deepest = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in range(1, deepest + 1))))
    fits = (urls.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(table_, "suffix")
            .groupBy("host").agg(F.collect_list(F.struct("size", "host_size", "says", "rule", "at")).alias("fits")))
    # hosts that some rule fits, once per salt: a frequent host is spread by its paths
    fits = fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = urls.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    out = salted.join(fits, ["host", "salt"], "left").drop("salt")
    return out.withColumn("best", F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["at"])))).drop("fits")


def words_of(texts: Column) -> Column:
    return F.regexp_extract_all(F.lower(texts), F.lit(r"\p{L}+"), F.lit(0))


def dictionary(texts: DataFrame, labelled: DataFrame) -> DataFrame:
    """(word, n_allow, n_block) for words of 1 to 20 letters: of column ``text`` and of the labelled names
    (columns verdict and name)."""
    ones = texts.select(F.explode(words_of("text")).alias("word"), F.lit(1).alias("n_allow"), F.lit(0).alias("n_block"))
    block = (F.col("verdict") == "block").cast("int")
    named = labelled.select(F.explode(words_of("name")).alias("word"), (1 - block).alias("n_allow"), block.alias("n_block"))
    return (ones.unionByName(named).where(F.length("word") <= WORD).groupBy("word")
            .agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")))


def best_split(run: str, known: dict[str, float], ln_total: float) -> list[str]:
    """The most probable words of a run; of equals the one whose last word is longest."""
    if len(run) > NAME:
        return [run]
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        top, cut = -math.inf, 0
        for start in range(max(0, end - WORD), end):
            p = known.get(run[start:end])
            p = best[start] + (p if p is not None else -ln_total - (end - start) * math.log(26))
            if p > top:
                top, cut = p, start
        best.append(top)
        back.append(cut)
    words, end = [], len(run)
    while end:
        words.append(run[back[end]:end])
        end = back[end]
    return words[::-1]


class Bayes:
    """Word weights of the naive Bayes model from the classes' totals."""

    def __init__(self, n_allow: int, n_block: int, n_words: int, smoothing: float = SMOOTHING, alpha: float = ALPHA):
        self.n_allow, self.n_block, self.smoothing, self.alpha = n_allow, n_block, smoothing, alpha
        self.allow_total = n_allow + alpha * (n_words + 1)
        self.ln_total = math.log(max(n_allow + n_block, 1))

    def weight(self, allow: int, block: int) -> int:
        p = (allow + self.alpha) / self.allow_total
        return round(math.log((block + self.smoothing * p) / ((self.n_block + self.smoothing) * p)) * UNIT)


def _segment(model: Bayes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, weight = [], []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = {x["piece"]: (x["n_allow"], x["n_block"]) for x in found}
                known = {w: math.log(a + b) - model.ln_total for w, (a, b) in counts.items()}
                words = best_split(text, known, model.ln_total)
                split.append(words)
                weight.append(sum(model.weight(*counts.get(w, (0, 0))) for w in words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string())), pa.array(weight, pa.int64())], ["run", "words", "weight"])
    return run


def segmented(runs: DataFrame, words: DataFrame, model: Bayes) -> DataFrame:
    """(run, words, weight) of distinct runs, by the dictionary entries of their pieces."""
    short = F.length("run") <= NAME
    starts = F.sequence(F.lit(1), F.length("run"))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(WORD), F.length("run") - i + 1)), lambda k: F.substr(F.col("run"), i, k))))
    asked = runs.select("run", F.explode(F.when(short, F.array_distinct(pieces)).otherwise(F.array(F.lit("")))).alias("piece"))
    often = F.length("piece") <= 3
    asked = asked.withColumn("salt", F.when(often, F.pmod(F.xxhash64("run"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    held = words.withColumnRenamed("word", "piece")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(often, F.lit(SALTS - 1)).otherwise(F.lit(0)))))
    entry = F.when(F.col("n_allow").isNotNull(), F.struct("piece", "n_allow", "n_block"))
    found = asked.join(held, ["piece", "salt"], "left").groupBy("run").agg(F.collect_list(entry).alias("found"))
    return found.mapInArrow(_segment(model), "run string, words array<string>, weight long")


def score_urls(urls: DataFrame, words: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(host, path, weight): log odds without the prior, in units of 2^-20, of distinct (host, path)
    rows that have a word; both arguments are staged tables."""
    total = words.agg(F.sum("n_allow"), F.sum("n_block"), F.count(F.lit(1))).first()
    model = Bayes(total[0] or 0, total[1] or 0, total[2], smoothing)

    def letters(c: str) -> Column:
        return words_of(F.regexp_replace(c, "%[0-9A-Fa-f]{2}", " "))

    runs = urls.select("host", "path", F.explode(F.concat(letters("host"), letters("path"))).alias("run"))
    uses = stage(runs.groupBy("run").agg(F.count(F.lit(1)).alias("uses")), "url-runs")
    n_uses = uses.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    weights = stage(segmented(uses, words, model).join(uses, "run"), "url-weights")
    hot = F.broadcast(weights.where(F.col("uses") * HOT > n_uses).select("run", "weight"))  # at most HOT rows
    cold = weights.where(F.col("uses") * HOT <= n_uses).select("run", F.col("weight").alias("cold"))
    marked = runs.join(hot, "run", "left")
    some = marked.where(F.col("weight").isNotNull()).groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    rest = (marked.where(F.col("weight").isNull()).select("host", "path", "run").join(cold, "run")
            .groupBy("host", "path").agg(F.sum("cold").alias("weight")))
    return some.unionByName(rest).groupBy("host", "path").agg(F.sum("weight").alias("weight"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], words: DataFrame, prior: float = PRIOR, smoothing: float = SMOOTHING) -> DataFrame:
    """``pages`` (columns url and others) with host, path, rule, verdict and score: the log odds
    of urls that no rule decides.  ``words`` is a staged ``dictionary``."""
    ruled = best_rules(split_url(pages), rules)
    open_ = stage(ruled.where(F.col("best").isNull()).select("host", "path").distinct(), "url-open")
    scores = score_urls(open_, words, smoothing).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "weight")
    odds = math.log(prior / (1 - prior))
    both = ruled.join(scores, F.col("best").isNull() & (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    score = F.when(F.col("best").isNull(), F.coalesce(F.col("weight") / UNIT, F.lit(0.0)) + odds)
    said = F.coalesce("best.says", F.when(score > 0, F.lit("block")).otherwise(F.lit("allow")))
    return both.select(*pages.columns, "host", "path", F.col("best.rule").alias("rule"), said.alias("verdict"), score.alias("score"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labelled = spark.createDataFrame(LABELLED, "verdict string, name string")
    text = F.regexp_replace("html", "<[^<>]*>", " ")
    words = stage(dictionary(pages.select(text.alias("text")), labelled), "url-words")
    return judge(pages.select("page_id", "url"), RULES, words).drop("url")
