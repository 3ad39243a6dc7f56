"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). Expectation-maximisation over the counts of
vote patterns estimates how often each rule votes which way on good and on bad documents - its accuracies - and how
many documents are good. The posterior probability of being good then decides, instead of a demand that all rules
pass: one objection that good documents also meet is forgiven, several that bad ones meet together are not. What is
assumed of rules is that they err independently and say no more of bad to good documents than to bad ones; a rule
for which the estimates say otherwise is taken to say nothing. Documents that fail the base rules are out anyway
and don't take part in the estimates.

Everything per document is Spark's built-in functions. The only rows that reach the driver are the vote
patterns with their counts, at most 3 to the power of the number of rules.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged alike,
one by one; an empty table gives no rows; a text of any length is measured whole, in one task; input columns of any
name, but for the text, travel in the struct ``doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import storage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
STOPS = r"[.!?]"
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of words
WINDOW = 8
#: Words of a stretch in which different words are counted, so that variety doesn't fall with length.
STRETCH = 50
ROUNDS = 100
KEEP_FROM = 0.5
#: Frequent function words of English, French, Spanish and German.
COMMON = (
    "the", "and", "of", "to", "in", "is", "that", "with", "was", "for", "on", "de", "la", "le", "les", "et", "des", "en", "que", "est",
    "el", "los", "y", "del", "las", "un", "una", "der", "die", "und", "das", "ist", "von", "zu", "den", "mit", "ein",
)
#: Rejected texts whose hashes may be broadcast (16 bytes each); more are met by a shuffle.
BROADCAST_ROWS = 500_000


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def _rules() -> dict[str, Column]:
    """The vote of each rule."""
    words, lines = F.col("n_words"), F.col("n_lines")
    mean_length, repeated, symbols = _share("word_chars", "n_words"), _share("n_repeat_words", "n_words"), _share("n_symbols", "n_words")
    same_lines, variety, common, stops = _share("n_dup_lines", "n_lines"), _share("n_kinds", "n_words"), _share("n_common", "n_words"), _share("n_stops", "n_words")
    return {
        "length": _vote(words < 50, words >= 100),
        "repetition": _vote(repeated > 0.1, (repeated == 0) & (words >= 50)),
        "symbols": _vote(symbols > 0.1, symbols < 0.01),
        "lines": _vote(same_lines > 0.2, (same_lines == 0) & (lines >= 3)),
        "word_length": _vote((mean_length < 4) | (mean_length > 7.5), mean_length.between(4.5, 6.5)),
        "variety": _vote(variety < 0.6, variety > 0.7),
        "common_words": _vote(common < 0.05, common > 0.1),
        "sentences": _vote((stops < 0.01) | (stops > 0.3), stops.between(0.03, 0.2)),
    }


def _bound(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions refer to but never evaluate again, not even inside a lambda."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return frame.withColumn("made", F.explode(F.array(made))).select(*frame.columns, "made.*")


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``windows`` is an array in word order."""
    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def words(p: Column) -> Column:
        reach = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def let(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    return let(let(ordered, starts), words)


def measure(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``doc`` (all input columns that it carries) and the counts that the rules use; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("doc"), text.alias("body"))
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    rows = _bound(rows, words=F.array_remove(F.split("body", SPACES), ""), lines=lines)
    rows = rows.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("body", SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split("body", STOPS, -1)) - 1).cast("long").alias("n_stops"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*COMMON))).cast("long").alias("n_common"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    rows = _bound(rows, word=F.col("hashes")).drop("hashes")
    stretches = F.when(F.col("n_words") > 0, F.sequence(F.lit(1), F.col("n_words").cast("int"), F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
    kinds = F.aggregate(stretches, F.lit(0).cast("long"), lambda n, i: n + F.size(F.array_distinct(F.slice("word", i, F.lit(STRETCH)))))
    rows = rows.withColumn("n_kinds", kinds)
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get("word", i + k) for k in range(WINDOW))))
    rows = _bound(rows, windows=windows).drop("word")
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("n_repeat_words", F.when(some, _covered(F.col("windows"))).otherwise(0).cast("long")).drop("windows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[dict[int, float]]]]:
    """EM over (votes, count): the share of good documents, and how each rule votes on bad [0] and good [1] ones."""
    total = sum(c for _, c in patterns)
    if not total:
        return 0.5, []
    # where EM starts: the balance of a document's votes
    good = [min(0.95, max(0.05, 0.5 + 0.5 * sum(v) / max(1, sum(map(abs, v))))) for v, _ in patterns]
    for _ in range(ROUNDS):
        prior = sum(g * c for g, (_, c) in zip(good, patterns, strict=True)) / total
        voting = []
        for j in range(len(patterns[0][0])):
            sums = [dict.fromkeys((-1, 0, 1), 0.5) for _ in (0, 1)]  # half a pseudo-vote each
            for g, (votes, c) in zip(good, patterns, strict=True):
                sums[1][votes[j]] += g * c
                sums[0][votes[j]] += (1 - g) * c
            if sums[0][-1] * sum(sums[1].values()) < sums[1][-1] * sum(sums[0].values()):
                sums = [{v: sums[0][v] + sums[1][v] for v in sums[0]}] * 2
            voting.append([{v: n / sum(s.values()) for v, n in s.items()} for s in sums])
        good = [posterior(votes, prior, voting) for votes, _ in patterns]
    return prior, voting


def posterior(votes: tuple[int, ...], prior: float, voting: list[list[dict[int, float]]]) -> float:
    """P(good | votes)."""
    yes, no = prior, 1 - prior
    for v, (bad, good) in zip(votes, voting, strict=True):
        yes, no = yes * good[v], no * bad[v]
    return yes / (yes + no)


def judge(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """``doc``, the measures, ``base_failed``, ``quality`` (posterior) and ``kept`` for every document.

    ``carried``: the columns in ``doc``, all but the text if not given. Measures are stored between fitting and judging.
    """
    rules = _rules()
    carried = [c for c in docs.columns if c != "text"] if carried is None else carried
    rows = storage.cut(measure(docs, carried).select("*", F.struct(*(c.alias(n) for n, c in rules.items())).alias("votes")), "votes")
    counted = rows.where(~F.col("base_failed")).groupBy("votes").count().collect()  # at most 3 ** len(rules) rows
    prior, voting = fit(sorted((tuple(x.votes), x["count"]) for x in counted))
    good, bad = F.lit(float(prior)), F.lit(float(1 - prior))
    for name, (on_bad, on_good) in zip(rules, voting, strict=False):  # none where there are no documents
        vote = F.col(f"votes.{name}")
        good, bad = (p * F.when(vote > 0, r[1]).when(vote < 0, r[-1]).otherwise(r[0]) for p, r in ((good, on_good), (bad, on_bad)))
    rows = rows.withColumn("quality", good / (good + bad))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept.

    A verdict depends on the text alone, so rejected texts are told by two hashes. While they are few, no text moves.
    """
    def told(text: Column) -> dict[str, Column]:
        return {"a": F.xxhash64(text), "b": F.hash(text)}

    keyed = docs.select("text").withColumns(told(F.col("text")))
    rejected = storage.cut(judge(keyed, ["a", "b"]).where(~F.col("kept")).select("doc.*").distinct(), "rejected")
    few = rejected.count() <= BROADCAST_ROWS
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in told(F.col("text")).items()))
    return rows.join(F.broadcast(rejected) if few else rejected.hint("merge"), ["a", "b"], "left_anti").select("row.*")
