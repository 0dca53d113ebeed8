"""Spelling variants: words one letter apart, found in frequency-vector tries.

A word's letters fall into 16 groups, of about equal frequency, four in each
quarter.  The four quarter counts (``QUARTERS``) are the key of a subtree; below
it words are arranged by the counts of the 16 groups, one level a group.  Two
words one letter apart differ by at most one surplus and one deficit in either
vector, so a word looks into the subtrees of at most 21 keys; as nearness holds
both ways, only the keys from its own upward, 11, are visited.  In a subtree a
depth-first search goes down with a budget of one surplus and one deficit, for
many words at a time; words of the leaves it reaches are verified letter by letter.

Words reach their subtrees by one shuffle, sorted, so that a task first reads a
subtree's words and then streams those that look into it.  A subtree of more than
``SUBTREE`` words is dealt to several parts, each of which sees all its visitors.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

#: Fixed values of the contract: the letters of a run, and which of its letters are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

GROUPS, QUARTERS = 16, 4
#: Words of a subtree's part, visitors searched at once, trie nodes of one step of the search.
SUBTREE, VISITORS, FRONTIER = 100_000, 4_096, 1 << 18
#: Words that a task counts before it passes them on.
COUNTED = 200_000


def _counts(slip: int, min_length: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total = re.compile(LETTERS), Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()

        for batch in batches:
            for id_, text in zip(batch["id"].to_pylist(), batch["text"]):
                text = text.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(b"" if id_ is None else str(id_).encode())
                prefix = zlib.crc32(b":", prefix)
                for word, n in Counter(run.findall(text.translate(LOWER))).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % slip == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1 :]
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield from out()
        yield from out()

    return count


def word_counts(docs: DataFrame, slip: int = 199, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, with a planted slip in one of ``slip``
    (by the CRC of doc_id and run); of at least ``min_length`` letters and ``min_count`` occurrences.
    A null doc_id counts as empty, a null text has no runs."""
    found = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(_counts(slip, min_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Words:
    """Words as one array of code points with offsets."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)

    def group_counts(self, group: np.ndarray) -> np.ndarray:
        """Letters of each group (code point -> group) in each word, as a row a word."""
        place = np.repeat(np.arange(len(self.words)), self.length) * GROUPS + group[self.code]
        return np.bincount(place, minlength=len(self.words) * GROUPS).reshape(-1, GROUPS)


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of each code point: letters in order of frequency, each to the group with the fewest so far.

    The counts are one row a letter, of which there are 90."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(Words(batch["word"].to_pylist()).code, minlength=256)
        letter = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(letter), pa.array(total[letter])], ["letter", "n"])

    sums = words.select("word").mapInArrow(count, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    group, load = np.zeros(256, np.int64), np.zeros(GROUPS, np.int64)
    for letter, n in sorted(map(tuple, sums.collect()), key=lambda x: (-x[1], x[0])):
        group[letter] = load.argmin()
        load[group[letter]] += n
    return group


def _keys(quarters: np.ndarray) -> np.ndarray:
    """Quarter counts as one number; counts beyond 16 bits share numbers, which only adds to what is verified."""
    key = np.zeros(quarters.shape[:-1], np.uint64)
    for i in range(QUARTERS):
        key = key * np.uint64(65536) + (quarters[..., i] % 65536).astype(np.uint64)
    return key.astype(np.int64)


def _moves() -> np.ndarray:
    """The quarter vectors' differences of a budget of one surplus and one deficit: none, +1, -1, or both."""
    one = np.eye(QUARTERS, dtype=np.int64)
    both = [a - b for a in one for b in one if (a != b).any()]
    return np.array([np.zeros(QUARTERS, np.int64), *one, *-one, *both])


def _routes(group: np.ndarray):
    """Each word to its own subtree (visit 0) and as a visitor (1) to all keys from its own upward."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch["word"].to_pylist())
            quarters = words.group_counts(group).reshape(-1, QUARTERS, GROUPS // QUARTERS).sum(axis=2)
            own = _keys(quarters)
            seen = quarters[:, None, :] + _moves()[None]
            keys = _keys(seen)
            good = (seen >= 0).all(axis=2) & (keys >= own[:, None])
            row, move = np.nonzero(good)
            at = np.concatenate([np.arange(len(own)), row])
            visit = np.repeat(np.array([0, 1], np.int8), [len(own), len(row)])
            key = np.concatenate([own, keys[row, move]])
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(visit), batch["word"].take(pick), batch["n"].take(pick)], ["key", "visit", "word", "n"])

    return route


class Trie:
    """The words of a subtree, arranged by the successive counts of the letter groups.

    Level by level, ``keys`` has (parent node, count) of each node in order, so
    that a child is found by binary search; leaves are ranges of ``order``."""

    def __init__(self, words: list[str], n: list[int], group: np.ndarray):
        self.text, self.n = Words(words), np.array(n, np.int64)
        counts = self.text.group_counts(group)
        self.order = np.lexsort(counts.T[::-1])
        counts = counts[self.order]
        node, new = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        new[:1] = True
        self.keys = []
        for level in range(GROUPS):
            new[1:] |= counts[1:, level] != counts[:-1, level]
            self.keys.append((node[new] << 32) + counts[new, level])
            node = np.cumsum(new) - 1
        self.first = np.append(np.flatnonzero(new), len(words))

    def leaves(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(visitor, leaf) of the leaves within budget of the visitors' counts, depth first in blocks of nodes."""
        n = len(counts)
        none = np.zeros(n, np.int64)
        stack = [(0, np.arange(n), none, none, none)]  # level, visitor, node, surplus, deficit spent
        while stack:
            level, who, node, surplus, deficit = stack.pop()
            if level == GROUPS:
                yield who, node
                continue
            if len(who) > FRONTIER:
                half = len(who) // 2
                stack += [(level, who[half:], node[half:], surplus[half:], deficit[half:]), (level, who[:half], node[:half], surplus[:half], deficit[:half])]
                continue
            keys, want = self.keys[level], counts[who, level]
            found = []
            for step in (0, 1, -1):
                can = np.flatnonzero((surplus < 1) if step > 0 else ((deficit < 1) & (want > 0)) if step else np.ones(len(who), bool))
                key = (node[can] << 32) + want[can] + step
                child = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[child] == key
                can = can[hit]
                found.append((who[can], child[hit], surplus[can] + (step > 0), deficit[can] + (step < 0)))
            who, node, surplus, deficit = (np.concatenate(x) for x in zip(*found))
            if len(who):
                stack.append((level + 1, who, node, surplus, deficit))


def _run(a: Words, b: Words, i: np.ndarray, j: np.ndarray, from_i: np.ndarray, from_j: np.ndarray) -> np.ndarray:
    """How many letters agree, from the given places to the end of the shorter rest."""
    same = np.zeros(len(i), np.int64)
    rest = np.minimum(a.length[i] - from_i, b.length[j] - from_j)
    at_i, at_j = a.start[i] + from_i, b.start[j] + from_j
    alive = np.flatnonzero(rest > 0)
    while len(alive):
        alive = alive[a.code[at_i[alive] + same[alive]] == b.code[at_j[alive] + same[alive]]]
        same[alive] += 1
        alive = alive[same[alive] < rest[alive]]
    return same


def one_apart(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Do words a[i] and b[j] differ by exactly one inserted, deleted or replaced letter?"""
    more = a.length[i] - b.length[j]
    zero = np.zeros(len(i), np.int64)
    head = _run(a, b, i, j, zero, zero)
    skip_i, skip_j = (more >= 0).astype(np.int64), (more <= 0).astype(np.int64)  # the odd letter, in the longer or in both
    from_i, from_j = head + skip_i, head + skip_j
    close = (np.abs(more) <= 1) & (from_i <= a.length[i]) & (from_j <= b.length[j])
    near = np.zeros(len(i), bool)
    k = np.flatnonzero(close)
    tail = _run(a, b, i[k], j[k], from_i[k], from_j[k])
    near[k] = tail == a.length[i[k]] - from_i[k]
    return near


def _pairs(group: np.ndarray):
    def visit(trie: Trie, words: list[str], n: list[int], own: np.ndarray) -> pa.RecordBatch:
        visitors, count = Words(words), np.array(n, np.int64)
        parts = []
        for who, leaf in trie.leaves(visitors.group_counts(group)):
            size = trie.first[leaf + 1] - trie.first[leaf]
            who = np.repeat(who, size)
            place = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(trie.first[leaf], size)
            at = trie.order[place]
            near = one_apart(visitors, trie.text, who, at)
            parts.append((who[near], at[near]))
        who, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        # within one subtree each pair is met from both sides: once is enough
        keep = np.fromiter((not same or words[i] < trie.text.words[j] for i, j, same in zip(who, at, own[who])), bool, len(who))
        who, at = who[keep], at[keep]
        a, b = pa.array(words).take(pa.array(who)), pa.array(trie.text.words).take(pa.array(at))
        return pa.RecordBatch.from_arrays([a, pa.array(count[who]), b, pa.array(trie.n[at])], ["word", "n", "other", "other_n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, trie, words, ns = None, None, [], []
        for batch in batches:
            key, part, kind = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "part", "visit"))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for start, end in zip([0, *edge], [*edge, len(key)]):
                if (key[start], part[start]) != here:
                    here, trie, words, ns = (key[start], part[start]), None, [], []
                piece = batch.slice(start, end - start)
                if kind[start] == 0:
                    words += piece["word"].to_pylist()
                    ns += piece["n"].to_pylist()
                    continue
                if words:
                    trie, words, ns = Trie(words, ns, group), [], []
                for at in range(0, len(piece) if trie else 0, VISITORS):
                    some = piece.slice(at, VISITORS)
                    names = some["word"].to_pylist()
                    quarters = Words(names).group_counts(group).reshape(-1, QUARTERS, GROUPS // QUARTERS).sum(axis=2)
                    yield visit(trie, names, some["n"].to_pylist(), _keys(quarters) == here[0])

    return search


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of words (distinct, with counts n) one letter apart, once."""
    group = letter_groups(words)
    routed = words.select("word", "n").mapInArrow(_routes(group), "key long, visit byte, word string, n long")
    # subtrees of more than SUBTREE words: at most one row for so many words
    large = routed.filter("visit = 0").groupBy("key").agg(F.ceil(F.count("*") / SUBTREE).cast("int").alias("parts")).filter("parts > 1")
    routed = routed.join(F.broadcast(large), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = routed.withColumn("part", F.explode(F.when(F.col("visit") == 0, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    together = dealt.select("key", "part", "visit", "word", "n").repartition("key", "part").sortWithinPartitions("key", "part", "visit")
    return together.mapInArrow(_pairs(group), "word string, n long, other string, other_n long")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: the end of each word's chain of forms (``links``: word, form).

    Each round doubles the length followed.  Counts rise fivefold a step, so a
    chain of 64-bit counts has at most 27 steps and five rounds are enough."""
    ends = links.withColumnRenamed("form", "root")
    for round_ in range(5):
        ends = scratch.stage(ends, f"ends-{round_}")
        step = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = ends.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return ends


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with counts n.

    ``form``: the word's most frequent near word (ties: least in code-point order),
    if it occurs at least ``factor`` times as often (``factor`` of 2 or more); ``root``:
    the last of the chain of forms, the word itself without one.  Words of any
    length, also empty ones, take part; null words are left out; other columns are ignored.
    """
    if factor < 5:
        raise ValueError("chains of forms are followed for 27 steps, which a factor under 5 could exceed")
    spark: SparkSession = words.sparkSession
    scratch = Scratch(spark, "spelling")
    words = scratch.stage(words.filter(F.col("word").isNotNull()).select("word", "n"), "words")
    pairs = near_words(words)
    ways = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    both = pairs.select(F.explode(ways).alias("p")).select("p.*")
    # a word has at most some thousand near words: its length times the alphabet
    top = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("other_n").alias("best_n"), F.min_by("other", F.struct(-F.col("other_n"), "other")).alias("best"))
    joined = words.join(top, "word", "left").withColumn("far", F.col("best_n") >= factor * F.col("n"))
    near = scratch.stage(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("far"), F.col("best")).alias("form"), F.when(F.col("far"), F.col("best_n")).alias("form_n")),
        "near",
    )
    ends = roots(near.filter(F.col("form").isNotNull()).select("word", "form"), scratch)
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame) -> DataFrame:
    """The variants among all words of ``docs`` (doc_id, text), of 6 letters and 5 occurrences at least.

    Null and empty texts have no words; a null doc_id counts as empty where slips
    are planted; repeated rows count each; an empty table gives no words."""
    return spelling_variants(word_counts(docs))
