"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Every rule says good (1), bad (-1) or nothing (0) about a text, from its own evidence alone. Texts
with the same votes are counted together (at most 3 to the number of rules patterns), and the model is
fitted on these counts: the share of good texts, and for each rule how often it votes good or bad on
good texts and on bad ones. So a bad vote that good texts get as well weighs little, and several good
votes can outweigh it. The fit is one SQL expression over the patterns, so neither the rows nor the
fit leave the engine, and no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import ids_and_texts, written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ROUNDS = 30
#: Before any fit: how often a rule votes bad, abstains or votes good on good texts and on bad ones, and
#: the share of good texts; texts that each outcome counts as seen beside those of the corpus; bounds of the share.
ON_GOOD, ON_BAD, SHARE = (0.05, 0.25, 0.7), (0.35, 0.4, 0.25), 0.5
SEEN, BOUNDS = 1.0, (0.05, 0.95)
#: Fixed list: common words of the languages that the rules know.
STOP_WORDS = tuple(sorted(set((
    "the of and to in a is that it for on with as was at by not this but from "
    "de la que el en y los se del las un por con no una su para es al lo "
    "le les des et est du dans qui sur pas il au ne ce elle ou une "
    "der die und das den von zu mit sich ein eine ist im dem nicht als auf für"
).split())))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound once; a plain reference might be computed per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs again."""

    def repeated(ordered: Column) -> Column:
        own = lambda k: F.get(ordered, k)["h"]
        same = lambda k: (own(k) == own(k - 1)) | (own(k) == own(k + 1))
        at = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: F.coalesce(same(k), (own(k) == own(k + 1)), F.lit(False))),
            lambda k: F.get(ordered, k)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, repeated))


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, _covered)).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts that the rules look at, one row per row of docs."""
    texts = ids_and_texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    words = F.filter(F.split("text", BLANK), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = F.length("text")
    without = lambda signs: length - F.length(F.translate("text", signs, ""))
    is_stop = lambda w: F.lower(F.translate(w, ".,;:!?", "")).isin(*STOP_WORDS)
    per_word = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(F.filter(w, is_stop)).cast("long").alias("n_stop"),
        F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}+[.,;:!?]?$"))).cast("long").alias("n_plain"),
    ))
    per_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: y.rlike(r"[.!?:;][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
    ))
    return texts.select(
        "doc_id", per_word.alias("w"), per_line.alias("x"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"), without("!").cast("long").alias("n_shouts"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    ).select("doc_id", "w.*", "x.*", "word_chars", "n_symbols", "n_shouts", "n_upper")


def votes() -> dict[str, Column]:
    """The rules: vote 1 (good), -1 (bad) or 0 (abstains) from the columns of `features`; each looks at one thing."""
    n, chars, lines = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))

    def vote(bad: Column, good: Column = F.lit(False)) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    symbols, shouts, upper = F.col("n_symbols") / n, F.col("n_shouts") / n, F.col("n_upper") / chars
    again, twice, ended = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines, F.col("n_ended") / lines
    mean, variety, stop, plain = F.col("word_chars") / n, F.col("n_distinct") / n, F.col("n_stop") / n, F.col("n_plain") / n
    return {
        "symbols": vote(symbols > 0.15),
        "shouts": vote(shouts > 0.2),
        "upper_case": vote(upper > 0.3),
        "repeated_words": vote(again > 0.3),
        "repeated_lines": vote(twice > 0.4),
        "line_ends": vote((ended < 0.1) & (n > 100), ended > 0.7),
        "word_length": vote((mean < 2) | (mean > 14), (mean > 3.5) & (mean < 8)),
        "variety": vote((variety < 0.2) & (n > 50), variety > 0.5),
        "stop_words": vote((stop < 0.1) & (n > 50), (stop > 0.15) & (stop < 0.6)),
        "plain_words": vote(plain < 0.6, plain > 0.9),
    }


# A model is one array: the share of good texts, then for each rule six probabilities, those of a bad
# vote, none and a good vote on good texts and the same three on bad ones.


def _posterior(model: Column, pattern: Column) -> Column:
    """Probability of a good text given its votes."""
    chance = lambda j, v, bad: F.get(model, j * 6 + v + 2 + 3 * bad)
    odds = F.transform(pattern, lambda v, j: F.log(chance(j, v, 0) / chance(j, v, 1)))
    share = F.get(model, F.lit(0))
    return 1.0 / (1.0 + F.exp(-F.aggregate(odds, F.log(share / (1.0 - share)), lambda s, t: s + t)))


def _fitted(patterns: Column, n_rules: int, rounds: int) -> Column:
    """The model after so many rounds over array<struct<votes, n>>."""

    def total(weighed: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(weighed, F.lit(0.0), lambda s, p: s + of(p))

    def probability(weighed: Column, sums: Column, k: Column) -> Column:
        rule, outcome, is_good = F.floor(k / 6).cast("int"), (k % 3) - 1, k % 6 < 3
        seen = total(weighed, lambda p: F.when(F.get(p["votes"], rule) == outcome, F.when(is_good, p["g"]).otherwise(p["b"])).otherwise(0.0))
        return (seen + SEEN) / (F.when(is_good, sums["g"]).otherwise(sums["b"]) + 3 * SEEN)

    def renewed(weighed: Column) -> Column:
        sums = F.struct(total(weighed, lambda p: p["g"]).alias("g"), total(weighed, lambda p: p["b"]).alias("b"))
        return let(sums, lambda t: F.concat(
            F.array(F.least(F.lit(BOUNDS[1]), F.greatest(F.lit(BOUNDS[0]), t["g"] / F.greatest(t["g"] + t["b"], F.lit(1.0))))),
            F.transform(F.sequence(F.lit(0), F.lit(6 * n_rules - 1)), lambda k: probability(weighed, t, k))))

    def step(model: Column, _: Column) -> Column:
        judged = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), _posterior(model, p["votes"]).alias("good")))
        weighed = F.transform(judged, lambda p: F.struct(p["votes"].alias("votes"), (p["n"] * p["good"]).alias("g"), (p["n"] * (1.0 - p["good"])).alias("b")))
        return let(weighed, renewed)

    start = F.array(F.lit(SHARE), *[F.lit(p) for _ in range(n_rules) for p in (*ON_GOOD, *ON_BAD)])
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def quality_votes(docs: DataFrame, threshold: float = 0.5, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, votes, good (posterior probability) and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept:
    not base_failed and good >= threshold. Missing texts count as empty: no words, hence
    base_failed. Every row is judged by itself; repeated rows and missing ids stay as they
    are, other columns are not read, and an empty table gives no rows.
    """
    rules = votes()
    counted = features(docs, id_col, text_col)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = written(counted.withColumns({"base_failed": base_failed, "votes": F.array(*rules.values())}), "votes")
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    # One row: at most 3 ** rules patterns, in a fixed order so that sums do not vary.
    fitted = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p")).withColumn("model", _fitted(F.col("p"), len(rules), rounds))
    judged = fitted.select(F.explode("p").alias("p"), "model").select(F.col("p.votes").alias("votes"), _posterior(F.col("model"), F.col("p.votes")).alias("good"))
    return voted.join(F.broadcast(written(judged, "model")), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("good") >= threshold))
