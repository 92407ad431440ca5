"""Quality rules that vote, and a label model that weighs them. DataFrame functions only.

Counts are taken from whole texts inside the row, without exploding words. Each rule votes for a good text (1), a bad one (-1) or
abstains (0). Expectation-maximisation over the table of vote patterns (at most 3 to the number of rules, whatever the corpus)
estimates how often each rule gives each vote on good and on bad texts; a text's posterior probability of being good decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

#: White space between words, and characters that count as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rounds of expectation-maximisation at most, and the change of any log-odds below which it ends.
ROUNDS, SETTLED = 40, 1e-3
#: Pseudo-counts: rows that say a good text gets good votes and a bad one bad votes.
TRUST = 2.0


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts (longs) and what the rules look at; null texts count as empty. Other columns stay.

    Columns of these names in the input are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim("_text", F.lit(BLANKS))
    out = docs.withColumn("_text", text).withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANKS}]+", -1)))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    # most characters are small letters: the others are counted in what is left without them
    out = out.withColumn("_joined", F.array_join("_words", "")).withColumn("_rest", F.regexp_replace("_joined", "[a-z]+", ""))
    windows = F.when(
        F.size("_words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_lines", lines).withColumn("_windows", windows)
    # equal windows stand next to each other once sorted
    by_hash = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), by_hash))
    twice = F.filter(
        "_sorted",
        lambda e, k: F.coalesce(F.get("_sorted", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["h"] == e["h"], F.lit(False)),
    )
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")),
    )["n"]
    rest = F.col("_rest")
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length("_joined").cast("long"),
            "n_symbols": _without(rest, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_n_lines": F.size("_lines"),
            "_distinct": F.size(F.array_distinct("_words")),
            "_exclaimed": _without(rest, "!"),
            "_stops": _without(rest, ".,;:?"),
            "_upper": _without(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_lower": F.length("_joined") - F.length(rest),
            "_digits": _without(rest, "0123456789"),
        }
    )
    with_symbol = F.size(F.filter("_words", lambda w: F.length(F.translate(w, SYMBOLS, "")) < F.length(w)))
    out = out.withColumn("_bare", F.when(F.col("n_symbols") > 0, with_symbol).otherwise(0))
    return out.drop("_text", "_words", "_lines", "_windows", "_sorted", "_at", "_joined", "_rest")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: each is bad if the first condition holds, else good if the second holds, else abstains."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    letters = F.greatest(c("_upper") + c("_lower"), F.lit(1))
    return {
        "v_length": _vote(c("n_words") < 10, c("n_words") >= 60),
        "v_word_length": _vote((c("word_chars") > 14 * n) | (2 * c("word_chars") < 5 * n), c("word_chars").between(3 * n, 9 * n)),
        "v_symbols": _vote(10 * c("n_symbols") > n, 100 * c("n_symbols") <= n),
        "v_symbol_words": _vote(10 * c("_bare") > n, 100 * c("_bare") <= n),
        "v_lines": _vote((c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > 3 * c("_n_lines")), (c("n_dup_lines") == 0) & (c("_n_lines") > 2)),
        "v_repeats": _vote(5 * c("n_repeat_words") > n, 50 * c("n_repeat_words") <= n),
        "v_distinct": _vote((6 * c("_distinct") < n) & (n < 2000), 3 * c("_distinct") > n),
        "v_capitals": _vote(2 * c("_upper") > letters, 8 * c("_upper") < letters),
        "v_shouting": _vote(5 * c("_exclaimed") > n, 50 * c("_exclaimed") <= n),
        "v_digits": _vote(5 * c("_digits") > c("word_chars") + 1, 20 * c("_digits") <= c("word_chars")),
    }


def _posterior(weights: list[float]) -> Column:
    """Probability that the text is good, of its votes; weights: log-odds of each rule's votes -1, 0, 1 in turn, then those of any text.

    The weights are one constant array, so that every round runs the same generated code.
    """
    held = F.array(*(F.lit(w) for w in weights))
    score = F.aggregate(F.transform("votes", lambda v, k: F.get(held, k * 3 + v + 1)), F.get(held, F.lit(len(weights) - 1)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-score))


def _smoothed(counts: dict, rules: int) -> list[float]:
    """Weights of the expected counts (rule, vote) -> (good, bad)."""
    out = []
    for k in range(rules):
        share = []
        for y in (1, 0):
            trust = {-1: TRUST * (1 - y), 0: TRUST / 2, 1: TRUST * y}
            n = {x: counts.get((k, x), (0.0, 0.0))[1 - y] + trust[x] + 0.05 for x in (-1, 0, 1)}
            share.append({x: n[x] / sum(n.values()) for x in n})
        out += [math.log(share[0][x] / share[1][x]) for x in (-1, 0, 1)]
    good, bad = (sum(counts.get((0, x), (0.0, 0.0))[y] for x in (-1, 0, 1)) + TRUST for y in (0, 1))
    return [*out, math.log(good / bad)]


def fit(patterns: DataFrame, rules: int) -> list[float]:
    """Expectation-maximisation over patterns(votes, n): each round sums the expected counts of each rule's votes in both classes."""
    good = F.when(F.array_min("votes") == -1, 0.1).otherwise(0.9)  # where it starts from
    weights: list[float] = []
    for _ in range(ROUNDS):
        each = patterns.select("n", good.alias("good"), F.posexplode("votes").alias("k", "v")).groupBy("k", "v")
        rows = each.agg(F.sum(F.col("n") * F.col("good")), F.sum(F.col("n") * (1 - F.col("good")))).collect()  # 3 rows a rule
        new = _smoothed({(r[0], r[1]): (r[2], r[3]) for r in rows}, rules)
        change = max((abs(a - b) for a, b in zip(new, weights, strict=True)), default=1.0) if weights else 1.0
        weights, good = new, _posterior(new)
        if change < SETTLED:
            break
    return weights


def _judge(named: DataFrame, weights: list[float]) -> DataFrame:
    out = named.withColumns({"base_failed": base_failed(), "p_quality": _posterior(weights)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= 0.5)).drop("votes")


def _voted(named: DataFrame) -> DataFrame:
    """Adds base counts and votes to named(text, ...), and drops the text.

    They pass through an explode of one element: a filter or grouping above it cannot pull the counting, many times over, into itself.
    """
    carried = [c for c in named.columns if c != "text"]
    counted = measured(named).select(*carried, *COUNTS, F.array(*votes().values()).alias("votes"))
    return counted.select(*carried, F.explode(F.array(F.struct(*COUNTS, "votes"))).alias("_v")).select(*carried, "_v.*")


def _fitted(voted: DataFrame) -> list[float]:
    patterns = stage(voted.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), "patterns")
    weights = fit(patterns, len(votes()))
    drop_stage(patterns)
    return weights


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base counts, base_failed, p_quality (posterior), kept.

    Null and empty texts have no words, so they fail the base rules. Repeated rows stay repeated, empty tables stay empty. Other
    columns are not read. Very long texts are counted whole.
    """
    voted = stage(_voted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "votes")  # numbers only, no text
    return _judge(voted, _fitted(voted)).select("id", *COUNTS, "base_failed", "p_quality", "kept")


def accepted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns.

    Texts are read twice, for the votes and for the verdict, and written nowhere.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    voted = _voted(docs.select(whole, F.col(text_col).alias("text")))
    return _judge(voted, _fitted(voted)).filter("kept").select("row.*")
