"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate each rule is on either class, and a document stays if the posterior probability that it is good is at least one half.

No label is read. The votes of all documents are counted by pattern (at most 3 to the power of the number of rules, whatever the size of the corpus), EM runs over these counts, and the posterior is a column expression again, so that the texts are never shuffled.

What the classes mean is settled by the start and by imagined votes: each rule is taken to blame half of the bad documents that it votes on and 2 % of the good ones, and these votes weigh as much as WEIGHT of all documents. The share is the same at every size, so that a table and its copies give one model; where few documents are bad, it keeps the class "bad" from settling on some harmless kind of documents. Beyond that the accuracies are free: a rule that blames good and bad documents alike gets no say, whereas the blame of one that is seldom wrong is enough. Rules that overlap tie kinds of junk together into one class.

Null and empty texts have no words and fail the base rule; other columns of the input, whatever their names, pass through; repeated rows get the same verdict, and so do all documents with one pattern of votes; a posterior of exactly one half keeps a document. Whole texts are counted, however long they are. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, cut, let, window_hashes, word_hashes, words, written

GOOD, BAD = 1, -1
#: What is imagined of each rule and of the share of good documents before the votes are seen, and how much it weighs, as a share of all documents.
BLAMES_GOOD, BLAMES_BAD, PRIOR = 0.02, 0.5, 0.9
WEIGHT = 0.005


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains. Both are SQL over the columns of signals()."""

    name: str
    bad: str
    good: str = "FALSE"


RULES = (
    Rule("symbols", "n_symbols > 0.05 * word_chars", "n_symbols < 0.01 * word_chars"),
    Rule("mark_runs", "n_mark_runs > 0.1 * n_words", "n_mark_runs < 0.02 * n_words"),
    Rule("repeats", "n_repeat_words > 0.1 * n_words", "n_words >= 30 AND n_repeat_words < 0.05 * n_words"),
    Rule("capitals", "n_capitals > 0.4 * word_chars", "n_capitals < 0.1 * word_chars"),
    Rule("lines", "n_lines >= 4 AND n_dup_lines > 0.3 * n_lines", "n_lines >= 4 AND n_dup_lines < 0.1 * n_lines"),
    # Distinct words grow with the number of words up to some 3,000, then with its square root.
    Rule("variety", "n_words >= 30 AND n_distinct < 0.35 * least(n_words, sqrt(3000 * n_words))", "n_words >= 30 AND n_distinct > 0.55 * least(n_words, sqrt(3000 * n_words))"),
    Rule("word_length", "word_chars < 3.5 * n_words OR word_chars > 8 * n_words", "word_chars > 4 * n_words AND word_chars < 7 * n_words"),
    Rule("length", "n_words < 20", "n_words >= 50"),
)


def repeated_words(grams: Column, n: int) -> Column:
    """Number of words that lie in windows of n words found twice or more, the first find included. grams: window_hashes()."""

    def twice(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(starts, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(let(ordered, twice), covered)).cast("long")


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns row (a struct of all columns of df) and the counts that rules read, all long."""
    held = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.coalesce(df[text], F.lit("")).alias("text"))
    held = held.select("row", "text", words(F.col("text")).alias("words"))
    held = held.select("row", "text", F.length(F.array_join("words", "")).alias("word_chars"), word_hashes(F.col("words")).alias("hashes"))
    held = held.select("row", "text", "word_chars", "hashes", window_hashes(F.col("hashes"), 5).alias("grams"), F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]")).alias("lines"))
    counts = {
        "n_words": F.size("hashes"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("grams"), 5),
        "n_lines": F.size("lines"),
        "n_distinct": F.size(F.array_distinct("hashes")),
        "n_capitals": F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")),
        "n_mark_runs": F.regexp_count("text", F.lit("[#*$%&<>!?]{2,}| [|] ")),
    }
    return held.select("row", *[c.cast("long").alias(k) for k, c in counts.items()])


BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """An array of 1, -1 or 0 for each rule."""
    return F.array(*[F.expr(f"CASE WHEN {r.bad} THEN {BAD} WHEN {r.good} THEN {GOOD} ELSE 0 END").cast("int") for r in rules])


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; on_good, on_bad: how often a rule that votes is right about good and about bad ones."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: Column) -> Column:
        """Probability that a document with these votes is good."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, (a, b) in enumerate(zip(self.on_good, self.on_bad, strict=True)):
            v = F.get(votes, F.lit(j))
            odds = odds + F.when(v == GOOD, math.log(a / (1 - b))).when(v == BAD, math.log((1 - a) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 300, tolerance: float = 1e-9, weight: float = WEIGHT) -> LabelModel:
    """EM over (votes, number of documents). blames: for the classes bad and good, how often each rule blames a document that it votes on."""
    total = sum(n for _, n in patterns)
    imagined = weight * total
    prior, start = PRIOR, (BLAMES_BAD, BLAMES_GOOD)
    blames = [[x] * n_rules for x in start]
    for _ in range(rounds if total else 0):
        bad = [[imagined * x] * n_rules for x in start]
        all_votes = [[imagined] * n_rules for _ in start]
        good = imagined * PRIOR
        for v, n in patterns:
            odds = math.log(prior / (1 - prior))
            odds += sum(math.log(blames[1][j] / blames[0][j]) if x == BAD else math.log((1 - blames[1][j]) / (1 - blames[0][j])) for j, x in enumerate(v) if x)
            p = 1 / (1 + math.exp(-odds))
            good += n * p
            for c, share in enumerate((n * (1 - p), n * p)):
                for j, x in enumerate(v):
                    if x:
                        all_votes[c][j] += share
                        bad[c][j] += share * (x == BAD)
        was = [prior, *blames[0], *blames[1]]
        prior = good / (total + imagined)
        blames = [[b / a for b, a in zip(bad[c], all_votes[c], strict=True)] for c in (0, 1)]
        if max(abs(a - b) for a, b in zip(was, [prior, *blames[0], *blames[1]], strict=True)) < tolerance:
            break
    return LabelModel(prior, tuple(1 - x for x in blames[1]), tuple(blames[0]))


def fit_corpus(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """The model of all documents of counted, a result of signals(). The driver gets one row for each pattern of votes, at most 3 ** len(rules)."""
    patterns = counted.groupBy(votes(rules).alias("votes")).agg(F.count("*").alias("n")).collect()
    return fit(sorted((tuple(r["votes"]), r["n"]) for r in patterns), len(rules))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of all columns of df, or of those in carry), the counts of signals(), votes, quality (posterior probability), base_failed and kept, for each row of df. One pass over the texts: the counts, and what is carried, are written to the shared folder before the model is fitted."""
    counted = signals(df, text)
    if carry is not None:
        counted = counted.withColumn("row", F.struct(*[F.col("row").getField(c) for c in carry]))
    # Nested projections would be merged, and each count computed as often as the rules name it.
    counted = cut(counted) if carry is not None else written(counted)
    model = fit_corpus(counted, rules)
    judged = counted.withColumn("votes", votes(rules))
    judged = judged.withColumn("quality", model.posterior(F.col("votes"))).withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of df that are kept, with the columns of df."""
    return judge(df, text, rules, threshold).where("kept").select("row.*")
