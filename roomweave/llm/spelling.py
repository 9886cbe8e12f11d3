"""Groups of spelling variants, by partition-and-enumerate signatures of letter multisets.

A word's letters are a multiset, that is a binary vector with a place for the first, second, ... of each letter.  One
edited code point changes at most two places.  The letters are partitioned into ``parts`` of about equal weight; at
most two places differ, so at most two parts do, and leaving out every one part (an insertion, a deletion, or a
replacement within the part) and every two parts (a replacement across them) leaves a rest that both words have.  The
enumerated rests are signatures, and words with an equal one are joined.  A signature carries the letters that stay in
their order, and for two parts also where letters went, since one edit changes neither; so anagrams part company
before the join.  Edit distance verifies each candidate, and each near pair is accepted from one signature only: across
two parts if its letters lie in different ones, else from the one part.

Signatures are rows of 64-bit hashes in an equi-join of which adaptive execution splits a hot key; nothing is gathered
a group.  Partitions follow the letters' counts, of which there is a row a code point at most.
"""

from __future__ import annotations

from itertools import combinations
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomweave.llm.storage import checkpointed

LETTERS = "A-Za-zÀ-ÿ"
GONE = "\u0001"  # stands where a letter went


def ascii_lower(word: Column) -> Column:
    """A-Z as a-z, all else unchanged."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, ascii_uppercase, ascii_lowercase))


def runs(docs: DataFrame, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text", letters: str = LETTERS) -> DataFrame:
    """(doc_id, run): every maximal run of at least min_chars letters, A-Z as a-z. A null or empty text has none."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{letters}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    return found.select("doc_id", ascii_lower(F.col("run")).alias("run"))


def vocabulary(found: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the column run: words long enough and found often enough. Partial sums meet, not occurrences."""
    long = found.where(F.char_length("run") >= min_chars)
    return long.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def partition_letters(words: DataFrame, parts: int) -> list[str]:
    """The letters of all words in so many strings, the most frequent first to the one of least weight."""
    counts = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()  # a row a code point
    weight, held = [0] * parts, [""] * parts
    for c, n in sorted(((r.c, r.n) for r in counts), key=lambda x: (-x[1], x[0])):
        k = weight.index(min(weight))
        weight[k] += n
        held[k] += c
    return held


def signatures(word: Column, held: list[str]) -> Column:
    """An array of 64-bit signatures; the lowest bit tells those that leave out two parts."""
    sign = lambda k, rest, two: F.shiftleft(F.xxhash64(F.lit(k), rest), 1).bitwiseOR(F.lit(two).cast("long"))
    one = [sign(k, F.translate(word, part, "") if part else word, 0) for k, part in enumerate(held)]
    two = []
    for k, (a, b) in enumerate(combinations([p for p in held if p], 2)):
        rest = F.translate(word, a + b, GONE * len(a + b))
        two.append(F.when(rest != word, sign(k, rest, 1)))  # without such a letter there is none to replace
    return F.array_compact(F.array(*one, *two))


def near_pairs(words: DataFrame, parts: int = 7) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of distinct words of (word, n) that one inserted, deleted or replaced code point tells apart."""
    held = partition_letters(words, parts)
    signed = words.select("word", "n", F.explode(signatures(F.col("word"), held)).alias("sig"))
    a, b = (signed.select("sig", F.col("word").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    letters = "".join(held)
    part_of = lambda w: F.translate(w, letters, "".join(chr(ord("A") + k) * len(x) for k, x in enumerate(held)))
    near = (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    once = (F.col("sig").bitwiseAND(F.lit(1)) == 0) | (part_of(F.col("a")) != part_of(F.col("b"))) if letters else F.lit(True)
    return a.join(b, "sig").where(near & once).select("a", "n_a", "b", "n_b")


def _last(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, to): where the arrows end. They never meet in a ring; their lengths double a round."""
    ends = checkpointed(forms.select("word", F.col("to").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = checkpointed(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ends.where("moved").isEmpty():
            return ends.select("word", "root")
        ends = ends.drop("moved")


def group_variants(words: DataFrame, ratio: int = 2, parts: int = 7) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n), a row a distinct word, of which the n of several rows are added; other columns go.

    form: the near word of largest n, of equals the first in code-point order, if its n is at least ``ratio`` times
    (over 1) the word's, else null. root: where forms lead to in the end; the word itself if it has none.  Rows without
    a word or without a count go; an empty table gives an empty one.
    """
    words = checkpointed(words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    both = near_pairs(words, parts).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                                                             F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best.near", (-F.col("best.less")).alias("near_n"))
    led = F.col("near_n") >= ratio * F.col("n")
    formed = checkpointed(joined.select("word", F.when(led, F.col("near")).alias("form"), "n", "n_near", F.when(led, F.col("near_n")).alias("form_n")))
    roots = _last(formed.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
