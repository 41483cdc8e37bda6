"""Mixing sources to target weights, with soft membership.

A naive-Bayes classifier over words and binned statistics of the text is counted from a
labelled table; it gives every document a posterior over domains. Its words are a table that the
documents' words are joined to, so their number is not limited. Nonnegative document rates
are then fitted by projected gradient descent on least squares, so that the expected tokens of
every domain meet their targets: the gradient of a document is its posterior times the
residuals, so each step needs one distributed sum per domain. Only built-in functions run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyorder.llm.common import stash

#: Expected labelled documents behind the classifier, bins per statistic. A word must be in SUPPORT
#: documents of a domain and there LIFT times (as a logarithm) as common as elsewhere; words that
#: only tell languages apart are not, and would count the same evidence again and again.
SAMPLE, BINS = 4000, 16
SUPPORT, LIFT = 3, 2.0
STEPS, TOLERANCE, KEPT = 1000, 2e-3, 5
N_STATS = 5


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tk, words, n_tokens and statistics s0.. of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("t"))
    rows = rows.withColumn("words", F.array_remove(F.split(F.lower("t"), r"[^a-z0-9\u0080-\uffff]+"), ""))
    rows = rows.withColumn("n_tokens", F.size("words").cast("long"))
    n = F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")
    stats = [
        F.length("t") / n,
        F.log2(n),
        F.regexp_count("t", F.lit(r"[$%&#*|!]")) / n,
        F.regexp_count("t", F.lit(r"[A-Z]{2}")) / n,
        F.size(F.array_distinct("words")) / n,
    ]
    return rows.select("doc_id", "tk", "words", "n_tokens", *[s.alias(f"s{j}") for j, s in enumerate(stats)])


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


class _Bayes:
    """Bernoulli naive Bayes: presence of lexicon words, and one bin of each statistic."""

    def __init__(self, marked: DataFrame, domains: list[str], bins: int):
        self.domains = domains
        totals = {r["domain"]: r["count"] for r in marked.groupBy("domain").count().collect()}
        n_d = [totals.get(d, 0) for d in domains]
        n = sum(n_d)
        spread = [k / bins for k in range(1, bins)]
        cuts = marked.agg(*[F.percentile_approx(f"s{j}", spread).alias(f"s{j}") for j in range(N_STATS)]).first()
        self.cuts = [sorted(set(c)) if c else [] for c in cuts]
        per_word = marked.select("domain", F.explode(F.array_distinct("words")).alias("f")).groupBy("f").agg(
            *[F.count(F.when(F.col("domain") == d, 1)).alias(f"c{k}") for k, d in enumerate(domains)]
        )
        telling, odds, absent = F.lit(False), [], []
        for k in range(len(domains)):
            inside, outside = F.col(f"c{k}"), sum([F.col(f"c{j}") for j in range(len(domains)) if j != k], F.lit(0))
            lift = F.log((inside + 0.5) / (n_d[k] + 1) / ((outside + 0.5) / (n - n_d[k] + 1)))
            telling = telling | ((inside >= SUPPORT) & (lift >= LIFT))
            p = (inside + 0.5) / (n_d[k] + 1)
            odds.append(F.log(p / (1 - p)).alias(f"w{k}"))
            absent.append(F.log(1 - p).alias(f"a{k}"))
        words = per_word.filter(telling).select("f", *odds, *absent)
        # the empty word, which no text has, stands for the document itself in the join
        zero = marked.sparkSession.range(1).select(F.lit("").alias("f"), *[F.lit(0.0).alias(f"{x}{k}") for x in "wa" for k in range(len(domains))])
        self.lexicon = stash(words.unionByName(zero), "mixing-words")
        none = self.lexicon.agg(*[F.sum(f"a{k}").alias(f"a{k}") for k in range(len(domains))]).first()
        self.start = [math.log((m + 1) / (n + len(domains))) + none[k] for k, m in enumerate(n_d)]
        found = marked.select("domain", *[c.alias(f"b{j}") for j, c in enumerate(self._bins())])
        by_bin = found.select("domain", F.posexplode(F.array(*[f"b{j}" for j in range(N_STATS)])).alias("stat", "bin")).groupBy("domain", "stat", "bin").count()
        counts = [[[0] * (len(c) + 1) for c in self.cuts] for _ in domains]
        for r in by_bin.collect():  # bins times statistics times domains
            counts[domains.index(r["domain"])][r["stat"]][r["bin"]] = r["count"]
        self.binned = [[[math.log((c + 0.5) / (n_d[k] + 0.5 * len(row))) for c in row] for row in counts[k]] for k in range(len(domains))]

    def _bins(self) -> list[Column]:
        return [sum([(F.col(f"s{j}") > x).cast("int") for x in c], F.lit(0)) for j, c in enumerate(self.cuts)]

    def posterior(self, rows: DataFrame) -> DataFrame:
        """doc_id, tk, n_tokens, p: the probabilities in the order of `domains`. Rows get a number
        and meet the lexicon word by word; their texts are not shuffled, and what a row's words
        give is added before its one row is."""
        d = range(len(self.domains))
        rows = rows.withColumns({"rid": F.monotonically_increasing_id(), **{f"b{j}": c for j, c in enumerate(self._bins())}})
        fixed = [sum([_literal(self.binned[k][j])[F.col(f"b{j}")] for j in range(N_STATS)], F.lit(self.start[k])).alias(f"r{k}") for k in d]
        keys = ["rid", "doc_id", "tk", "n_tokens", *[f"r{k}" for k in d]]
        terms = rows.select(*keys[:4], *fixed, F.explode(F.array_union("words", F.array(F.lit("")))).alias("f"))
        # no hint: Spark broadcasts the written lexicon if its size allows
        summed = terms.join(self.lexicon, "f").groupBy(*keys).agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in d])
        summed = summed.withColumn("raw", F.array(*[F.col(f"r{k}") + F.col(f"w{k}") for k in d]))
        summed = summed.withColumn("top", F.array_max("raw"))
        summed = summed.withColumn("odds", F.transform("raw", lambda x: F.exp(x - F.col("top"))))
        summed = summed.withColumn("all_odds", F.aggregate("odds", F.lit(0.0), lambda a, b: a + b))
        return summed.select("doc_id", "tk", "n_tokens", F.transform("odds", lambda x: x / F.col("all_odds")).alias("p"))


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tk, n_tokens, p (array over `domains`) of every row.

    labels: doc_id, domain. Other or null domains and null ids are left out; an id with several
    domains takes the smallest name. Above `sample` labelled ids a keyed part of that expected
    size is counted, all of the table is scored.
    """
    known = labels.filter(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = stash(known, "mixing-labels")
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * sample / n))
    taken = docs.join(known.select(F.col("doc_id").alias("__id"), F.col("domain").alias("__domain")), docs[id_col] == F.col("__id"))
    marked = stash(_described(taken.select(F.struct(id_col, "__domain").alias(id_col), text_col), id_col, text_col).withColumn("domain", F.col("doc_id.__domain")).drop("doc_id"), "mixing-sample")
    return _Bayes(marked, domains, bins).posterior(_described(docs, id_col, text_col))


def fit_rates(rows: DataFrame, weights: list[float], ridge: float = 1e-3, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """`rows` (n_tokens, p, ...) with a column rate >= 0.

    Minimises the squared distance of expected domain tokens, sum of rate * n_tokens * p, from
    weight * all tokens, each domain over the larger of what it holds and what it should hold,
    plus `ridge` times the token-weighted squared distance of rates from 1. So a domain counts
    the same however rare it is, and one that should hold nothing gets rates near 0 at any share.
    Steps have Barzilai-Borwein length, long and short by turns; one that does not lower the value
    is taken again, shorter. The state is written every KEPT steps; between, steps are columns.
    Ends where the projected gradient of every row with tokens is below `tolerance`; a fit that
    is not there after `steps` is an error.
    """
    d = len(weights)
    share = sum(weights) or 1.0
    goal = [w / share for w in weights]
    state = stash(rows.withColumn("rate", F.lit(1.0)), "mixing-rates")
    total = state.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return state
    mass = F.col("n_tokens") / float(total)
    p, rate, old = F.col("p"), F.col("rate"), F.col("old")
    flat = [*[F.sum(mass * p[k] * rate).alias(f"e{k}") for k in range(d)], F.sum(mass * F.pow(rate - old, 2)).alias("moved"), F.sum(mass * F.pow(rate - 1, 2)).alias("away")]
    # how far a step of length 1 from the old rate would go
    flat.append(F.max(F.when(F.col("n_tokens") > 0, F.abs(old - F.greatest(F.lit(0.0), old - F.col("slope"))))).alias("open"))
    shared = [F.sum(mass * p[j] * p[k]).alias(f"g{j}_{k}") for j in range(d) for k in range(d)]
    got = state.withColumn("old", rate).withColumn("slope", F.lit(0.0)).agg(*flat, *shared).first()
    gram = [[got[f"g{j}_{k}"] for k in range(d)] for j in range(d)]
    held = [max(got[k], goal[k]) for k in range(d)]
    scaled = lambda row: [(row[k] - goal[k]) / held[k] if held[k] > 0 else 0.0 for k in range(d)]
    worth = lambda e, row: sum(x * x * h for x, h in zip(e, held)) + ridge * row["away"]
    e, length = scaled(got), 1.0
    value = worth(e, got)
    for step in range(1, steps + 1):
        state = state.withColumn("old", rate).withColumn("slope", sum(p[k] * F.lit(e[k]) for k in range(d)) + ridge * (rate - 1))
        state = state.withColumn("rate", F.greatest(F.lit(0.0), old - length * F.col("slope")))
        if step % KEPT == 0:
            state = stash(state, "mixing-rates")
        got = state.agg(*flat).first()
        new = scaled(got)
        if got["open"] < tolerance or worth(new, got) > value:
            state = state.withColumn("rate", old)
            if got["open"] < tolerance:
                break
            length = max(1.0 if length > 1 else length / 2, length / 8)
            continue
        diff = [a - b for a, b in zip(new, e)]
        bend = sum(x * x * h for x, h in zip(diff, held))
        along, turned = bend + ridge * got["moved"], sum(diff[j] * diff[k] * gram[j][k] for j in range(d) for k in range(d)) + 2 * ridge * bend + ridge**2 * got["moved"]
        length = min(1e3, max(1e-2, along / turned if step % 2 else got["moved"] / along)) if along > 0 and turned > 0 else 1.0
        e, value = new, worth(new, got)
    else:
        raise RuntimeError(f"rates did not reach the tolerance of {tolerance} in {steps} steps")
    return stash(state.drop("old", "slope"), "mixing-rates")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, tk, n_tokens, p_<domain>..., rate, copies.

    copies is the rate rounded down or up by a keyed draw with that expectation. Null and empty
    texts have no tokens, weigh nothing and keep the rate that their posterior gives; repeated
    rows get equal rates; an empty table gives no rows, without labels all posteriors are equal.
    """
    domains = sorted(targets)
    rows = fit_rates(posteriors(docs, labels, domains, sample, id_col=id_col, text_col=text_col), [targets[x] for x in domains])
    draw = F.pmod(F.xxhash64("doc_id", "tk"), F.lit(1 << 40)) / float(1 << 40)
    return rows.select("doc_id", "tk", "n_tokens", *[F.col("p")[k].alias(f"p_{x}") for k, x in enumerate(domains)], "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies"))


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the table `labels`: toxic, else low or high quality."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    return labels.select("doc_id", kind.alias("domain"))
