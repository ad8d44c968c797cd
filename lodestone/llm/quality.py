"""Quality rules by weak supervision, in DataFrame expressions only.

Every rule votes on every document: keep (+1), reject (-1) or abstain (0). Nobody says which rules are right, so
expectation-maximisation fits a latent class model to the counts of the vote patterns: how often each rule rejects in
each class (abstentions carry no evidence), and the classes' shares. One class is good; there is a bad class for every
rule, started from documents that this rule rejects, since defects of different kinds don't come together. The
posterior probability of the good class replaces "all rules must pass".

A rule that rejects good documents at random and a rule that alone finds a kind of bad document give the same counts, so
a prior must tell them apart: a rule rejects NOISE of the good documents (weight RATE_WEIGHT of all documents), and
GOOD of all documents are good (weight SHARE_WEIGHT). Nothing else bounds a rate. Rounds end when the posterior likelihood has
stopped rising.

No rule knows words of any language.

Scale: votes and base figures come from one narrow pass over the texts; nothing but (pattern, count) is shuffled. There
are at most 3 ** 8 patterns however many documents there are, so the driver fits the model to their counts.

Edge cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows get equal answers;
an empty table gives an empty result; columns other than those named are carried only where the caller asks for it.
Equality of five-word windows is tested by their 64-bit hashes within one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved, words

WINDOW = 5
#: The prior: how often a rule rejects good documents, the share of good documents, and the weights of both.
NOISE, RATE_WEIGHT, GOOD, SHARE_WEIGHT = 0.001, 0.05, 0.9, 0.15
_OWN = "_lodestone_q_"  # prefix of scratch columns, so that no column of the caller's can clash


def _c(name: str) -> Column:
    return F.col(_OWN + name)


def with_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the figures that rules look at, in columns under a private prefix."""
    p = _OWN
    df = docs.withColumn(p + "text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    df = df.withColumn(p + "words", words(_c("text")))
    df = df.withColumns({
        p + "n_words": F.size(_c("words")).cast("long"),
        p + "n_distinct": F.size(F.array_distinct(_c("words"))).cast("long"),
        p + "word_chars": F.length(F.array_join(_c("words"), "")).cast("long"),
        p + "n_symbols": F.regexp_count(_c("text"), F.lit("[#*$%&|<>]")).cast("long"),
        p + "n_upper": F.regexp_count(_c("text"), F.lit("[A-Z]")).cast("long"),
        p + "n_shouts": F.regexp_count(_c("text"), F.lit("!")).cast("long"),
        p + "lines": F.filter(F.split(_c("text"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        p + "windows": F.transform(
            F.slice(_c("words"), 1, F.greatest(F.size(_c("words")) - (WINDOW - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *(F.get(_c("words"), i + k) for k in range(1, WINDOW))),
        ),
    })
    df = df.drop(p + "words", p + "text")
    # Windows are sorted with their positions only where some window comes twice.
    twice = F.size(F.array_distinct(_c("windows"))) < F.size(_c("windows"))
    df = df.withColumn(p + "sorted", F.when(twice, F.array_sort(F.transform(_c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn(p + "at", F.array_sort(F.transform(
        F.filter(_c("sorted"), lambda e, k: (F.get(_c("sorted"), k - 1)["h"] == e["h"]) | (F.get(_c("sorted"), k + 1)["h"] == e["h"])),
        lambda e: e["i"],
    )))
    # A repeated window covers five words, fewer where the next repeated window begins earlier.
    covered = F.transform(_c("at"), lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(_c("at"), k + 1) - x, F.lit(WINDOW))))
    df = df.withColumns({
        p + "n_lines": F.size(_c("lines")).cast("long"),
        p + "n_dup_lines": (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long"),
        p + "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    })
    return df.drop(*(p + x for x in ("lines", "windows", "sorted", "at")))


def rules() -> dict[str, tuple[Column, Column]]:
    """name: (rejects, accepts); neither: the rule abstains."""
    n = _c("n_words")
    per_word = lambda x: _c(x) / F.greatest(n, F.lit(1))
    dup = _c("n_dup_lines") / F.greatest(_c("n_lines"), F.lit(1))
    upper = _c("n_upper") / F.greatest(_c("word_chars"), F.lit(1))
    return {
        "length": (n < 10, n >= 20),
        "word_length": ((per_word("word_chars") < 2) | (per_word("word_chars") > 15), per_word("word_chars").between(3, 10)),
        "symbols": (per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.01),
        "duplicate_lines": (dup > 0.5, (dup == 0) & (_c("n_lines") >= 2)),
        "repeats": (per_word("n_repeat_words") > 0.2, per_word("n_repeat_words") < 0.05),
        "upper_case": (upper > 0.3, upper < 0.15),
        "shouting": (per_word("n_shouts") > 0.3, per_word("n_shouts") < 0.05),
        "stutter": ((n >= 10) & (n < 300) & (_c("n_distinct") <= 0.51 * n), (n >= 20) & (_c("n_distinct") >= 0.6 * n)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 5000, rise: float = 1e-10) -> dict:
    """Expectation-maximisation over (votes, count) pairs, at most 3 ** len(names) of them, until a round raises the mean
    log posterior of a document by less than rise.

    Returns the share of good documents, each rule's rate of rejection among them, the posterior of every pattern, and the
    log posterior after each round. Prior weights are shares of the number of documents, so the fit doesn't depend on the
    size of the input.
    """
    if not patterns:
        return {"good": GOOD, "rejects": dict.fromkeys(names, NOISE), "p_good": {}, "trace": []}
    votes, n = np.array([v for v, _ in patterns]), np.array([n for _, n in patterns], float)
    rejected, accepted, k = (votes < 0).astype(float), (votes > 0).astype(float), len(names)
    n /= n.sum()
    prior = np.vstack([np.full(k, NOISE), np.where(np.eye(k) > 0, 0.9, 0.1)])  # classes by rules, the good one first
    weight = np.r_[RATE_WEIGHT, np.full(k, 1e-4)][:, None]
    rates, shares = prior.copy(), np.r_[GOOD, np.full(k, (1 - GOOD) / k)]
    rates[0] *= 10
    trace: list[float] = []
    while True:
        odds = np.log(shares)[:, None] + np.log(rates) @ rejected.T + np.log1p(-rates) @ accepted.T
        top = odds.max(0)
        p = np.exp(odds - top)
        # Of the bad classes' shares only the sum has a prior, and each a trace that keeps it above zero.
        believed = (weight * (prior * np.log(rates) + (1 - prior) * np.log1p(-rates))).sum() + SHARE_WEIGHT * (GOOD * np.log(shares[0]) + (1 - GOOD) * np.log(1 - shares[0]))
        trace.append(float(n @ (top + np.log(p.sum(0))) + believed))
        p /= p.sum(0)
        if len(trace) > rounds or len(trace) > 1 and trace[-1] - trace[-2] < rise:
            break
        mine = p * n
        good = (mine[0].sum() + SHARE_WEIGHT * GOOD) / (1 + SHARE_WEIGHT)
        bad = mine[1:].sum(1) + 1e-9
        shares = np.r_[good, (1 - good) * bad / bad.sum()]
        r, a = mine @ rejected, mine @ accepted
        rates = (r + weight * prior) / (r + a + weight)
    return {"good": float(shares[0]), "rejects": dict(zip(names, rates[0].tolist(), strict=True)), "p_good": {v: float(x) for (v, _), x in zip(patterns, p[0], strict=True)}, "trace": trace}


def _code(votes: list[Column]) -> Column:
    """A pattern of votes as one number."""
    return sum(((v.cast("int") + 1) * 3**i for i, v in enumerate(votes)), F.lit(0))


def judged(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The columns of docs named in carry, with figures, posterior and verdict under private names.

    They are written to the shared folder once, so that no text is read or judged twice.
    """
    named = rules()
    votes = {f"{_OWN}v_{x}": F.when(no, -1).when(yes, 1).otherwise(0).cast("byte") for x, (no, yes) in named.items()}
    table = with_figures(docs, text).withColumns(votes)
    table = saved(table.select(*(f"`{x}`" for x in table.columns if x in carry or x.startswith(_OWN))), "quality")
    seen = sorted((tuple(r[v] for v in votes), r["n"]) for r in table.groupBy(*votes).agg(F.count("*").alias("n")).collect())  # at most 3 ** 8
    model = fit(seen, list(votes))
    coded = [(sum((x + 1) * 3**i for i, x in enumerate(v)), p) for v, p in model["p_good"].items()]
    known = docs.sparkSession.createDataFrame(coded, f"{_OWN}code int, {_OWN}p double")
    base_failed = (_c("n_words") < 10) | (100 * _c("n_repeat_words") > 20 * _c("n_words"))
    # At most 3 ** 8 rows.
    table = table.withColumn(_OWN + "code", _code([F.col(v) for v in votes])).join(F.broadcast(known), _OWN + "code", "left")
    return table.withColumns({_OWN + "base_failed": base_failed, _OWN + "kept": ~base_failed & (_c("p") >= 0.5)})


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the figures, base_failed, the posterior p_good and kept."""
    df = judged(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"])
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return df.select("doc_id", *(_c(x).alias(x) for x in figures), _c("p").alias("p_good"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    return judged(docs, text, docs.columns).filter(_c("kept")).select(*(f"`{x}`" for x in docs.columns))
