"""Quality rules by weak supervision.

Each rule votes for a document (+), weakly (-) or strongly (=) against it, or abstains (0).  Expectation-maximisation over
all documents estimates how often documents are good and how often good and bad ones get each vote of each rule; a
document's posterior probability of being good decides, so a rule that also votes against clean documents is overruled
where it stands alone.  Cut-offs on one count, or on counts of which one follows from another, are votes of one rule:
symbols other than bars, bars, and repetition of lines or of words.  So no evidence counts twice.

What is assumed, not estimated: strong cut-offs lie so far out that at most STRICT of the good documents pass them; a bad
document is one that some rule votes against.  Without the first, a kind of junk that one rule alone sees could not be told
from noise of that rule; without the second, the estimates would be free to call any share of clean documents bad.

Documents with the same votes share a posterior, so the estimation works on the counts of vote patterns: at most 4 to
the number of rules, whatever the number of documents.

Features come from one pass over the text.  Words are runs outside 0x20 and 0x09-0x0D; a null or empty text has none
and all its features are 0; it fails.  Votes compare counts, so no feature is divided by zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomweave.llm.wordhash import Words, mix, slices, span_hashes, U

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_shouts", "n_bars", "n_digits")
SYMBOLS = b"#*$%&|<>"
#: rule -> (strongly against, weakly against, for), as SQL on the features, the first that holds; none: it abstains.
RULES = {
    "length": ("n_words < 20", "n_words < 50", "n_words >= 100"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars < 3 * n_words OR word_chars > 10 * n_words", "2 * word_chars >= 7 * n_words AND word_chars <= 9 * n_words"),
    "symbols": ("10 * (n_symbols - n_bars) > 3 * n_words", "10 * (n_symbols - n_bars) > n_words", "50 * (n_symbols - n_bars) <= n_words"),
    "bars": ("5 * n_bars > n_words", "20 * n_bars > n_words", "50 * n_bars <= n_words"),
    "capitals": ("2 * n_upper > n_letters", "10 * n_upper > 3 * n_letters", "5 * n_upper <= n_letters"),
    "shouting": ("5 * n_shouts > n_words", "10 * n_shouts > n_words", "50 * n_shouts <= n_words"),
    "repetition": ("2 * n_repeat_words > n_words OR n_dup_lines >= 3 AND n_dup_lines * 40 > n_words", "10 * n_repeat_words > n_words OR n_dup_lines >= 1", "20 * n_repeat_words <= n_words"),
    "digits": ("2 * n_digits > word_chars", "4 * n_digits > word_chars", "10 * n_digits <= word_chars"),
}
VOTES = "+-="  # and 0, which says nothing

#: Bounds of the estimates, only away from 0 and 1, so that no vote alone is certain.
WITHIN = (0.001, 0.998)
STRICT = 0.0005
#: Where the estimation starts: the share of good documents, and how often these and bad ones get each of VOTES.
SHARE, GOOD, BAD = 0.8, (0.995, 0.0045, STRICT), (0.6, 0.2, 0.2)


def _features(batch: pa.RecordBatch) -> list[np.ndarray]:
    words = Words(batch.column("text"))
    raw, at = words.raw, words.at

    def count(mark: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mark, dtype=np.int64)][at])

    inside = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122))
    # Lines with a word, equal to one before in the same text.
    n = batch.num_rows
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.r_[at[:-1][np.diff(at) > 0], breaks + 1])
    starts = starts[starts < len(raw)]
    ends = np.r_[starts[1:], len(raw)].astype(np.int64)
    ends -= (raw[ends - 1] == 10) if len(raw) else 0
    holds = np.r_[0, np.cumsum(inside, dtype=np.int64)]
    good = holds[ends] > holds[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[good], ends[good]
    text = np.searchsorted(at, starts, "right") - 1
    lines = mix(span_hashes(raw, starts, ends)) + mix(text.astype(U))
    dup_lines = np.bincount(text, minlength=n) - np.bincount(text[np.unique(lines, return_index=True)[1]], minlength=n)
    # Words in windows of three that the text holds twice or more.
    grams, whole = words.windows(3)
    repeat = np.zeros(len(words.starts) + 1, dtype=np.int64)
    if len(grams):
        owner = words.text_of_word()
        grams = (mix(grams) + mix(owner[: len(grams)].astype(U)))[whole]
        _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
        first = np.flatnonzero(whole)[counts[inverse] > 1]
        np.add.at(repeat, first, 1)
        np.add.at(repeat, first + 3, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(repeat)[:-1] > 0)]
    return [words.counts(), count(inside & ((raw & 0xC0) != 0x80)), count(symbol[raw]), dup_lines, np.diff(covered[words.first]),
            count(letter), count(upper), count(raw == 33), count(raw == 124), count((raw >= 48) & (raw <= 57))]


def with_features(docs: DataFrame, text: str = "text", carry: bool = True) -> DataFrame:
    """The FEATURES of each row; carry: also a struct ``row`` of all columns."""
    rows = docs.select(*([F.struct("*").alias("row")] if carry else []), F.col(text).alias("text"))
    schema = rows.select(*(["row"] if carry else []), *(F.lit(0).cast("long").alias(c) for c in FEATURES)).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                made = [pa.array(np.ascontiguousarray(x, dtype=np.int64)) for x in _features(part)]
                kept = [part.column("row")] if carry else []
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*(["row"] if carry else []), *FEATURES])

    return rows.mapInArrow(run, schema)


def votes() -> Column:
    """One character a rule: + for, - weakly against, = strongly against, 0 abstains."""
    return F.concat(*(F.expr(f"CASE WHEN {strong} THEN '=' WHEN {weak} THEN '-' WHEN {good} THEN '+' ELSE '0' END") for strong, weak, good in RULES.values()))


def _shares(cast: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """(rule, vote): how the votes of each rule are shared out among the documents of this weight."""
    n = np.einsum("vpr,p->rv", cast, weight)
    n = np.clip(n / np.maximum(n.sum(1, keepdims=True), 1e-9), *WITHIN)
    n[:, 2] = np.minimum(n[:, 2], most)
    return n / n.sum(1, keepdims=True)


def estimate(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """The posterior probability of being good for each vote pattern, from the number of documents with it."""
    if not counts:
        return {}
    patterns = list(counts)
    cast = np.array([[[c == v for c in p] for p in patterns] for v in VOTES], dtype=float)
    weight, seen = np.array([counts[p] for p in patterns], dtype=float), cast[1:].any((0, 2))
    share, good, bad = SHARE, np.tile(GOOD, (cast.shape[2], 1)), np.tile(BAD, (cast.shape[2], 1))
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + np.einsum("vpr,rv->p", cast, np.log(good) - np.log(bad))
        posterior = np.where(seen, 1 / (1 + np.exp(np.clip(-odds, -500, 500))), 1.0)
        share = float(np.clip((weight * posterior).sum() / weight.sum(), *WITHIN))
        good, bad = _shares(cast, weight * posterior, STRICT), _shares(cast, weight * (1 - posterior), 1.0)
    return dict(zip(patterns, posterior.tolist()))


def judge(docs: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """All columns of docs in a struct ``row``, the FEATURES, votes, posterior and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows; such rows are not kept.
    """
    patterns = with_features(docs, text, carry=False).select(votes().alias("votes")).groupBy("votes").count()
    found = estimate({r["votes"]: r["count"] for r in patterns.collect()})  # at most 4 ** len(RULES) rows
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(found.items()) or [("", 0.0)], "votes string, posterior double"))  # as bounded
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return (with_features(docs, text).withColumn("votes", votes()).join(table, "votes", "left")
            .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= least)))
