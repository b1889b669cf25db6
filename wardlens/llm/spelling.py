"""Grouping of spelling variants by an index of variable-length grams.

The words of a corpus are counted; those that are long and frequent enough are
joined with all words one insertion, deletion or replacement away, and each
points at the most frequent of these if that one is much more frequent.

The index: grams of 2 to ``LONGEST_GRAM`` characters are counted over the
words, and the frequent ones make the dictionary.  A word has one gram at each
place: it grows while what it has is a frequent gram, so common beginnings
give longer and rarer grams.  It never grows beyond half the word, so that two
grams of a word always lie apart.

The bound: a character that is changed touches the grams that cover it.  No
place is covered by both of two grams that lie apart, so one edit affects one
of them at most, and a near word has the other whole, as far from its
beginning as here or as far from its end.  Each word therefore merges two
lists of the index only, the shortest two that lie apart, by place and word
length; what they hold is verified.  Words longer than ``LONG`` have two
halves for grams.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.storage import discard, stored

#: Words have so many characters and occurrences at least; the form of a word occurs so many times as often at least.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
LONGEST_GRAM = 6
#: A gram is frequent if it occurs more often than this in the words, and than its share of so many entries of the dictionary, which bounds that.
FREQUENT, DICTIONARY = 16, 200_000
LONG = 32
#: One run in so many, by its checksum, loses a character.
DAMAGED = 97
#: Distinct grams that a task counts before it sends them on.
COUNTED = 300_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- words -----------------------------------------------------------------------------------

def damaged(doc_id: Column, run: Column) -> Column:
    """The run as it is counted: where ``DAMAGED`` divides the checksum of ``<doc_id>:<run>``, less the character at its remainder by the length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(DAMAGED)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the long and frequent words of ``docs(doc_id, text, ...)``: runs of Latin letters in lower case (A to Z only)."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(
        F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    # One character may go, and no shorter run can become a word.
    words = runs.where(F.length("run") >= LEAST_LENGTH).select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- grams -----------------------------------------------------------------------------------

def gram_counts(words: DataFrame) -> DataFrame:
    """``(gram, n)``: how often each gram of 2 to ``LONGEST_GRAM`` characters occurs in the distinct words."""
    def send(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                if len(word) <= LONG:
                    counts.update(word[i:j] for i in range(len(word) - 1) for j in range(i + 2, min(i + LONGEST_GRAM, len(word)) + 1))
                    if len(counts) > COUNTED:
                        yield send(counts)
                        counts.clear()
        yield send(counts)
    return words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame) -> dict[str, int]:
    """The frequent grams with their counts, ``DICTIONARY`` at most: so many cannot each have more than that share of all occurrences."""
    counts = stored(gram_counts(words), "grams")
    least = max(FREQUENT, -(-(counts.agg(F.sum("n")).first()[0] or 0) // DICTIONARY))
    rows = counts.where(F.col("n") > least).toArrow()
    discard(counts)
    return dict(zip(rows.column("gram").to_pylist(), rows.column("n").to_pylist(), strict=True))


def grams(word: str, longest: int, frequent: Collection[str]) -> Iterator[tuple[str, int]]:
    """The gram at each place of the word: it grows while it is frequent, to ``longest`` characters at most."""
    for i in range(len(word) - 1):
        j = i + 2
        while j < len(word) and j - i < longest and word[i:j] in frequent:
            j += 1
        yield word[i:j], i


def grams_for(word: str, length: int, frequent: Collection[str]) -> Iterator[tuple[str, int]]:
    """The grams by which a word of ``length`` characters, the word's own or one more, would find this one."""
    half = length // 2
    if length <= LONG:
        yield from grams(word, half, frequent)
    else:
        yield word[:half], 0
        start = half - (length - len(word))
        yield word[start:], start


def two_apart(own: list[tuple[str, int]], sizes: Mapping[str, int]) -> list[tuple[str, int]]:
    """Two grams that have no place in common, of the smallest lists together: any one edit leaves one of them whole."""
    best, least = None, math.inf
    before, cost = [], math.inf
    ends = sorted(range(len(own)), key=lambda k: own[k][1] + len(own[k][0]))
    k = 0
    for gram, at in own:
        while k < len(ends) and own[ends[k]][1] + len(own[ends[k]][0]) <= at:
            if sizes.get(own[ends[k]][0], 0) < cost:
                before, cost = [own[ends[k]]], sizes.get(own[ends[k]][0], 0)
            k += 1
        if cost + sizes.get(gram, 0) < least:
            best, least = [*before, (gram, at)], cost + sizes.get(gram, 0)
    return best


def _entries(words: DataFrame, frequent, asks: bool) -> DataFrame:
    """``(key, word, n)``: the lists that a word asks for, or those it is in.  A key stands for a gram, its place and the length of the word it is in."""
    names = ["word", "n", "gram", "at", "size"]

    def of(word: str) -> set[tuple[str, int, int]]:
        if not asks:
            return {(g, at, len(word)) for length in (len(word), len(word) + 1) for g, at in grams_for(word, length, frequent.value)}
        two = two_apart(list(grams_for(word, len(word), frequent.value)), frequent.value)
        # A word of the same length has the gram at its place; a shorter one there, or one place before if the edit is further left.
        return {(g, at - back, len(word) - less) for g, at in two for less, back in ((0, 0), (1, 0), (1, 1)) if at >= back and len(word) - less >= LEAST_LENGTH}

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 500):
                rows, which = [], []
                for k, word in enumerate(batch.column("word").slice(i, 500).to_pylist()):
                    own = of(word)
                    rows += own
                    which += [i + k] * len(own)
                at = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), pa.array([r[0] for r in rows], pa.string()),
                                                  pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=names)
    return words.select("word", "n").mapInArrow(run, "word string, n long, gram string, at int, size int") \
        .select(F.xxhash64("gram", "at", "size").alias("key"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``: each pair of ``words(word, n)`` that one edit parts, once, the longer word (of one length, the later) first."""
    frequent = words.sparkSession.sparkContext.broadcast(dictionary(words))
    asking = _entries(words, frequent, True)
    listed = _entries(words, frequent, False).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    first = (F.length("word") > F.length("other")) | (F.col("word") > F.col("other"))
    return asking.join(listed, "key").where(first & (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)) \
        .select("word", "n", "other", "other_n").distinct()


# --- forms -----------------------------------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` -> ``(word, root)``: forms are followed to the last, twice as far in each round.

    Each form is more frequent than its word, so there is no way round and the
    rounds are few: the logarithm of the steps, which are at most that of the
    largest count.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after.select("word", "root")
        now._stored_at = after._stored_at
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each word of ``docs(doc_id, text, ...)``.

    ``form`` is the most frequent near word (of equally frequent ones, the
    smallest) if it occurs at least ``TIMES`` times as often as the word, else
    null; ``root`` is what following forms ends at.  A null text has no words;
    a null doc_id counts as an empty string in the checksum that damages runs.
    Repeated rows count each.  Other columns are ignored.  An empty table, or
    one without frequent words, gives an empty result.
    """
    words = stored(word_counts(docs), "words")
    pairs = stored(near_pairs(words), "near")
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b"))
    much = -F.col("b.m") >= TIMES * F.col("n")
    best = stored(best.select("word", "n_near", F.when(much, F.col("b.other")).alias("form"), F.when(much, -F.col("b.m")).alias("form_n")), "best")
    discard(pairs)
    roots = _roots(best.where("form is not null"))
    return words.join(best, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
