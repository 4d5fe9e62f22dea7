"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far to trust them, a posterior decides."""

from __future__ import annotations

import math
import re
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import col, free, query, read, stage, stream_udf

# Common function words of the four languages of the corpus.
FUNCTION_WORDS = {
    "en": "a an and are as at be by for from had has have he her his i in is it not of on or that the they this to was were which with you",
    "de": "als am auf auch aus bei das dem den der des die ein eine einen er es für ich im in ist mit nicht sich sie sind und von war wie zu",
    "fr": "au aux avec ce dans de des du elle en est et il je la le les mais ne nous on ou par pas pour que qui se sont sur un une vous",
    "es": "al como con de del el en era es esta este ha la las lo los más no o para pero por que se si son su sus un una y",
}
FUNCTION = frozenset(w.encode() for words in FUNCTION_WORDS.values() for w in words.split())
_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CLOSERS = (b".", b"!", b"?", b":", b";", b'"', b")", "…".encode(), "»".encode())
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = BASE + ("n_lines", "n_closed_lines", "n_distinct_words", "n_function_words", "n_letters", "n_line_words")


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of one whole text in UTF-8; linear in its length.

    ``n_repeat_words`` are the words inside five-word windows that occur twice or more, the first occurrence included.
    """
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    characters = sum(map(len, words))
    plain = text.isascii()
    if not plain:
        kept = text.translate(None, _BLANKS)
        characters = len(kept.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(words)
    letters = sum(map(str.isalpha, text.decode("utf-8", "replace"))) if not plain else len(text) - len(text.translate(None, _LETTERS))
    repeated = 0
    if n >= 10 or n > 5 and len(distinct) < n:
        windows = list(zip(words, islice(words, 1, None), islice(words, 2, None), islice(words, 3, None), islice(words, 4, None)))
        if len(set(windows)) < len(windows):
            seen, inside = {}, bytearray(n)
            for i, w in enumerate(windows):
                first = seen.setdefault(w, i)
                if first != i:
                    inside[first:first + 5] = inside[i:i + 5] = b"\1\1\1\1\1"
            repeated = inside.count(1)
    function = sum(map(FUNCTION.__contains__, words))
    closed = sum(x.rstrip().endswith(_CLOSERS) for x in lines)
    return (n, characters, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated,
            len(lines), closed, len(distinct), function, letters, max(len(x.split()) for x in lines) if len(lines) > 1 else n)


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_MEASURED = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"


def measures(text: Column) -> Column:
    """A struct of MEASURES of a text; all 0 for NULL."""
    def measured(batches):
        import pandas as pd

        for texts in batches:
            yield pd.DataFrame([measure(t) if t is not None else (0,) * len(MEASURES) for t in texts], columns=list(MEASURES))

    return stream_udf(measured, _MEASURED, frame=True)(F.encode(text, "utf-8"))


# name → (bad, good) as SQL over the measures; neither: the rule abstains. Ratios are written without division.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 10", "n_words >= 40"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "2 * word_chars BETWEEN 6 * n_words AND 18 * n_words AND n_words >= 20"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 2 * n_words AND n_words >= 20"),
    "duplicate_lines": ("n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines", "n_lines > 2 AND n_dup_lines = 0"),
    "function_words": ("n_words >= 20 AND 25 * n_function_words < n_words", "n_words >= 20 AND 8 * n_function_words >= n_words"),
    "closed_lines": ("n_lines > 1 AND 4 * n_closed_lines < n_lines OR n_lines = 1 AND n_closed_lines = 0 AND n_words >= 10", "5 * n_closed_lines >= 4 * n_lines AND n_lines > 0"),
    "letters": ("10 * n_letters < 7 * word_chars", "20 * n_letters >= 18 * word_chars AND n_words > 0"),
    "variety": ("n_words >= 50 AND 10 * n_distinct_words < 2 * n_words", "n_words >= 20 AND 3 * n_distinct_words >= n_words"),
}
GOOD_PRIOR = 0.85
SMOOTHING = 1.0
THRESHOLD = 0.5
ROUNDS = 200


def pattern(measured: str, rules: dict[str, tuple[str, str]] = RULES) -> Column:
    """The votes of all rules as one string of '-' (bad), '+' (good) and '0' (abstains), in the order of ``rules``."""
    def on(sql: str) -> Column:
        return F.expr(re.sub(r"[a-z_]+", lambda m: f"{measured}.{m[0]}" if m[0] in MEASURES else m[0], sql))

    return F.concat(*[F.when(on(bad), "-").when(on(good), "+").otherwise("0") for bad, good in rules.values()])


def voted(docs: DataFrame, text: str, rules=RULES) -> DataFrame:
    """``docs`` with the struct of measures and the vote pattern as the last two columns, under free names."""
    measured = free(docs, "_measured_")
    return docs.withColumn(measured, measures(col(text))).withColumn(free(docs, "_votes_"), pattern(measured, rules))


def expectation_maximisation(counts: dict[str, int], prior: float = GOOD_PRIOR, smoothing: float = SMOOTHING, rounds: int = ROUNDS) -> tuple[dict[str, float], dict]:
    """Posterior probability of 'good' for each vote pattern, and the fitted rates.

    Two classes, rules independent given the class; each rule has a rate of '-', '0' and '+' for either
    class. Start: share of good votes. A rule that abstains carries no evidence, so only votes enter a
    posterior: a rule's accuracy is its rate among its votes. Smoothed, so an empty table gives the prior.
    """
    patterns = sorted(counts)
    k = len(patterns[0]) if patterns else 0
    good = {p: (p.count("+") + prior) / (p.count("+") + p.count("-") + 1) for p in patterns}
    share, rates = prior, []
    for _ in range(rounds):
        total = sum(counts.values())
        share = (sum(counts[p] * good[p] for p in patterns) + 2 * smoothing * prior) / (total + 2 * smoothing)
        rates = []
        for i in range(k):
            of = {}
            for c, side in (("good", True), ("bad", False)):
                plus = sum(counts[p] * (good[p] if side else 1 - good[p]) for p in patterns if p[i] == "+") + smoothing * (3 if side else 1)
                minus = sum(counts[p] * (good[p] if side else 1 - good[p]) for p in patterns if p[i] == "-") + smoothing * (1 if side else 3)
                of[c] = plus / (plus + minus)
            rates.append(of)
        change = 0.0
        for p in patterns:
            odds = math.log(share / (1 - share))
            for i, v in enumerate(p):
                if v == "+":
                    odds += math.log(rates[i]["good"] / rates[i]["bad"])
                elif v == "-":
                    odds += math.log((1 - rates[i]["good"]) / (1 - rates[i]["bad"]))
            new = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            change, good[p] = max(change, abs(new - good[p])), new
        if change < 1e-9:
            break
    return good, {"good_share": share, "rates": rates}


def fit(votes: DataFrame) -> dict[str, float]:
    """Posterior by pattern (the last column). Spark counts the patterns of all rows; at most 3 to the number of rules of them reach the driver."""
    counts = {r[0]: r[1] for r in votes.groupBy(F.col(votes.columns[-1])).count().collect()}
    return expectation_maximisation(counts)[0]


def judged(votes: DataFrame, threshold: float) -> tuple[DataFrame, dict[str, Column]]:
    """``votes`` joined to the posteriors of the patterns (a table of that bounded size), and the columns of the verdict."""
    measured, pattern_ = votes.columns[-2:]
    name, value = free(votes, "_pattern_"), free(votes, "_posterior_")
    table = votes.sparkSession.createDataFrame(sorted(fit(votes).items()), f"`{name}` string, `{value}` double")
    m = F.col(measured)
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return votes.join(F.broadcast(table), F.col(pattern_) == F.col(name), "left"), {
        "votes": F.col(pattern_), "posterior": F.col(value), "base_failed": failed, "kept": ~failed & (F.col(value) >= threshold)}


def quality(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the MEASURES, ``votes``, ``posterior``, ``base_failed`` and ``kept``; the text itself is dropped.

    Meant for a scored table: the measures are written once and both the counting and the scoring read them.
    NULL and blank texts have no words, fail the base and are not kept. Equal rows get equal results; an
    empty table gives none. Clashing input columns keep their names, the new ones get an underscore.
    """
    kept = [c for c in docs.columns if c != text]
    votes = stage(voted(docs, text).drop(text), "votes")
    rows, verdict = judged(votes, threshold)
    new = {n: F.col(votes.columns[-2])[n] for n in MEASURES} | verdict
    return rows.select(*[col(c) for c in kept], *[v.alias(free(docs.drop(text), n)) for n, v in new.items()])


def keep_good(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged.

    Measuring costs far more than writing, so the rows are written once with their votes, which are counted and then filtered from the files.
    NULL and blank texts are not kept, repeated rows are kept or not together, an empty table stays empty.
    """
    rows, verdict = judged(stage(voted(docs, text), "voted"), threshold)
    return rows.where(verdict["kept"]).select(*[col(c) for c in docs.columns])


@query("op1_quality_votes")
def op1(spark, root):
    out = quality(read(spark, root, "documents").select("doc_id", "text"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "votes", "posterior")
