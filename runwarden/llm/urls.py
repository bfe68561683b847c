"""URL filter: rules first; else host names are segmented into words and a multinomial naive Bayes scores host and path tokens.

A host's labels are cut at everything but letters, and each run of letters is segmented by the likeliest sequence of words under a
unigram model (Viterbi). The unigrams are counted over the words of all pages' paths and html; a short list of words that host names
are often made of is counted in. Substrings of the distinct runs are joined with the unigram table, so neither is collected, and a run's
own candidates alone come together for its Viterbi pass. Words of any length count: longer ones than STEM are looked up by their first STEM letters.

Naive Bayes learns from the pages themselves: a page that a rule decides is an example of the rule's verdict; of the others, one with a
word of SEEDS in its segmented host (a parameter: words that unwanted sites name themselves by) is an example of `block`, and the rest, which
nothing speaks against, are examples of `allow`. Every occurrence of a token counts, over all examples, by class; a page is blocked if its tokens' log odds are above zero.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, staged, table

#: (host, path prefix, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SEEDS = ("adult", "ads", "bet", "bets", "betting", "casino", "cheap", "gambling", "lottery", "pill", "pills", "poker", "porn", "sex", "slots", "spam", "spyware", "track", "tracker", "viagra", "warez", "xxx")
#: Words that host names are often made of; each counts PLAIN_COUNT times beside what the corpus has.
PLAIN = ("blog", "book", "buy", "city", "club", "data", "farm", "free", "game", "games", "health", "home", "info", "live", "mail", "market", "media", "music", "news", "online", "photo", "play", "shop", "site", "sport", "store", "tech", "travel", "video", "web", "win", "world")
PLAIN_COUNT = 50
#: Letters of a word that its places in a run are looked up by.
STEM = 20


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by host or subdomain and path prefix; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n): words of two letters or more in all paths and html texts, lower-cased, and the two lists.

    Hosts do not count: a concatenated name would be a word of its own.
    """
    text = F.concat_ws(" ", path_of(F.col("url")), F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{2,}"), F.lit(0))).alias("word"))
    known = pages.sparkSession.createDataFrame([(w, PLAIN_COUNT) for w in sorted({*SEEDS, *PLAIN})], "word string, n long")
    return words.groupBy("word").agg(F.count("*").alias("n")).unionByName(known).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(run: str, found: dict[tuple[int, int], int], total: float) -> list[str]:
    """The likeliest segmentation; an unknown string of k letters has a chance of 10 / (total * 10^k).

    The best unknown string that ends at a place begins where best[start] + start * log 10 is largest, so a pass is linear in letters and words found.
    """
    n, log_total, ten = len(run), math.log(total), math.log(10)
    ending: dict[int, list] = {}
    for (start, end), c in found.items():
        ending.setdefault(end, []).append((start, math.log(c)))
    best, back, far = [0.0] + [-math.inf] * n, [0] * (n + 1), 0
    for end in range(1, n + 1):
        best[end], back[end] = best[far] + ten * (1 - (end - far)) - log_total, far
        for start, log_c in sorted(ending.get(end, ())):
            if best[start] + log_c - log_total > best[end]:
                best[end], back[end] = best[start] + log_c - log_total, start
        if best[end] + end * ten > best[far] + far * ten:
            far = end
    out, at = [], n
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return out[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words): the segmentation of each distinct run of letters, from (run) and the unigram table."""
    words = staged(words, "unigrams")
    total = float(words.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0])
    runs = staged(runs.distinct(), "runs")
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    subs = starts.select("run", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(STEM), F.length("run") - F.col("i") + 1))).alias("k"))
    subs = subs.select("run", "i", F.expr("substring(run, i, k)").alias("stem"))
    hits = subs.join(words.select(F.left("word", F.lit(STEM)).alias("stem"), "word", "n"), "stem").where(F.expr("length(word) <= length(stem) or substring(run, i, length(word)) = word"))
    hits = hits.groupBy("run").agg(F.collect_list(F.struct("i", F.length("word").alias("k"), "n")).alias("hits"))

    @F.pandas_udf("array<string>")
    def cut(run: pd.Series, hits: pd.Series) -> pd.Series:
        found = ({(h["i"] - 1, h["i"] - 1 + h["k"]): h["n"] for h in hs} if hs is not None else {} for hs in hits)
        return pd.Series([viterbi(r, f, total) for r, f in zip(run, found, strict=True)])

    return runs.join(hits, "run", "left").select("run", cut("run", "hits").alias("words"))


def judged(pages: DataFrame, rules=RULES, seeds=SEEDS, smoothing: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds), a row per row of pages; log_odds is null where a rule fits.

    Null urls and urls without :// have empty host and path, no rule and no tokens: the method allows them unless most examples are of
    class `block`. Repeated rows stay rows; an empty table gives none; other columns than page_id, url and html are not looked at. Whole html
    texts are counted, split by the JVM into words: a text's words are in memory together. A run of n letters has up to 20 n substrings.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = staged(urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "urls")

    hosts = staged(urls.select("host").distinct(), "hosts")
    runs = hosts.select("host", F.explode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("run"))
    cut = segmented(runs.select("run"), unigrams(pages))
    host_words = runs.join(staged(cut, "segments"), "run").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("host_words"))
    named = hosts.join(host_words, "host", "left").select("host", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"))
    named = staged(named.withColumn("seed", F.arrays_overlap("host_words", F.array(*map(F.lit, seeds)))), "host-words")

    # A distinct (host, path) is scored once, however many pages have it.
    pairs = staged(urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.min("ruled").alias("ruled")), "pairs")
    path_words = F.regexp_extract_all(ascii_lower(F.col("path")), F.lit("[^/._\\-0-9]+"), F.lit(0))
    host_tokens = F.transform("host_words", lambda w: F.concat(F.lit("h:"), w))
    example = F.when(F.col("ruled").isNotNull(), F.col("ruled") == "block").otherwise(F.col("seed"))
    tokens = pairs.join(named, "host").select("host", "path", "n", example.alias("block"), F.concat(host_tokens, F.transform(path_words, lambda w: F.concat(F.lit("p:"), w))).alias("tokens"))
    tokens = staged(tokens, "tokens")
    prior = tokens.agg(F.coalesce(F.sum(F.when(F.col("block"), F.col("n"))), F.lit(0)).alias("b"), F.coalesce(F.sum(F.when(~F.col("block"), F.col("n"))), F.lit(0)).alias("a")).first()
    each = tokens.select("host", "path", "n", "block", F.explode("tokens").alias("token"))
    counts = staged(each.groupBy("token").agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(~F.col("block"), F.col("n")).otherwise(0)).alias("a")), "token-counts")
    sums = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    lb, la = math.log(sums[0] + smoothing * (sums[2] + 1)), math.log(sums[1] + smoothing * (sums[2] + 1))
    odds = F.log(F.col("b") + smoothing) - F.lit(lb) - F.log(F.col("a") + smoothing) + F.lit(la)
    weights = staged(counts.select("token", odds.alias("odds")), "token-odds")
    start = math.log((prior.b + 1) / (prior.a + 1))
    scores = each.join(weights, "token").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    scores = pairs.join(scores, ["host", "path"], "left").select("host", "path", (F.coalesce("odds", F.lit(0.0)) + F.lit(start)).alias("log_odds"))
    out = urls.join(staged(scores, "scores"), ["host", "path"])
    method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("log_odds")).alias("log_odds"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
