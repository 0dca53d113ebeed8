"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments.  Of two fingerprints that
differ in two bits at most, some segment is equal in both while the next one
(cyclically) differs in one bit at most: if a segment holds both errors, the
one after it is followed by the third, and if two hold one each, the segment
left is followed by one of them.  So each segment gives keys made of its own
bits and of a fuzzy index of the next one: the numbers of the codewords of the
binary Golay code (23, 12) that lie near it.  The code is perfect with radius
3: a segment nearer than that to its codeword shares it with all neighbours
at one bit; one at distance 3 takes the five codewords at distance 4 too, and
then two segments that differ in one bit always share an index.

Fingerprints that meet under a key are compared bit by bit.  Keys with many
fingerprints go another exact way, linear in their number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, keeps_columns

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: (bits, shift) of the segments.
SEGMENTS = ((22, 42), (21, 21), (21, 0))
#: Generator polynomial of the binary Golay code: x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
#: Keys with more fingerprints than this are linked without pairs.
MAX_PAIRED = 32

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _bits(h: list[int]) -> int:
    """Bits set in over half of the 64-bit numbers."""
    # in slices, so that a very long text takes little memory
    count = np.zeros(64, dtype=np.int64)
    a = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(a), 65536):
        count += np.unpackbits(a[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles; of a text without words: 0."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    if len(w) <= shingle:
        return _bits([xxhash.xxh64_intdigest(b" ".join(w), SEED)])
    digest = xxhash.xxh64_intdigest
    line, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[: len(w) - shingle].tolist()]
    return _bits([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, t, fp) per row of ``docs``: id, hash of the text, fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["id", "t", "fp"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    return rows.mapInArrow(of, "id long, t long, fp long")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: up to six patterns that turn a word into a near codeword, and their number."""
    patterns = np.zeros((2048, 6), dtype=np.int64)
    number = np.zeros(2048, dtype=np.int64)
    weight = np.full(2048, 9)
    for k in range(5):
        for places in combinations(range(23), k):
            p = sum(1 << i for i in places)
            s = int(_syndrome(np.array([p]))[0])
            if weight[s] >= 3:  # the nearest codeword; those at 4 only beside one at 3
                weight[s] = min(weight[s], k)
                patterns[s, number[s]] = p
                number[s] += 1
    return patterns, number


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for i in range(22, 10, -1):
        v = np.where(v >> i & 1, v ^ (GENERATOR << (i - 11)), v)
    return v


def golay_indices(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``v`` (23-bit words) and the 12-bit indices of their near codewords."""
    patterns, number = golay_tables()
    s = _syndrome(v)
    rows = np.repeat(np.arange(len(v)), number[s])
    turn = np.arange(len(rows)) - np.repeat(np.cumsum(number[s]) - number[s], number[s])
    return rows, (v[rows] ^ patterns[s[rows], turn]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``fps`` (unsigned 64-bit) and their keys; fingerprints within two bits share one at least."""
    parts = [((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for bits, shift in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        r, index = golay_indices(parts[(i + 1) % 3])
        rows.append(r)
        keys.append((i << 34) | (exact[r] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    return fps.select("fp").mapInArrow(of, "key long, fp long")


def _paired(keyed: DataFrame) -> DataFrame:
    """Links (u, v) among the at most MAX_PAIRED fingerprints of each key."""
    pairs = F.flatten(
        F.transform("fps", lambda x, i: F.transform(F.filter(F.slice("fps", i + 2, MAX_PAIRED), lambda y: F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS), lambda y: F.struct(x.alias("u"), y.alias("v"))))
    )
    return keyed.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select(F.explode(pairs).alias("e")).select("e.u", "e.v")


def _starred(fps: DataFrame) -> DataFrame:
    """Links that connect all of ``fps`` within two bits, without pairs.

    Two fingerprints within two bits have a common neighbour within one bit of
    each.  Each meets its 64 neighbours and itself; those who meet are within
    two bits of each other, and each links to the least of them.
    """
    masks = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    met = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("at"))
    least = met.groupBy("at").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select(F.col("at").alias("to"), "v")
    return met.join(least, F.col("at") == F.col("to")).where("fp <> v").select(F.col("fp").alias("u"), "v")


def fingerprint_components(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, root): root is the least fingerprint reachable over links of two bits; unlinked ones are left out."""
    keyed = scratch.stage(_keyed(prints.select("fp").distinct()), "keyed")
    sizes = scratch.stage(keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    paired = _paired(keyed.join(sizes.where(F.col("n") <= MAX_PAIRED), F.col("key") == F.col("k")).select("key", "fp"))
    crowded = keyed.join(sizes.where(F.col("n") > MAX_PAIRED), F.col("key") == F.col("k")).select("fp").distinct()
    links = paired.unionByName(_starred(crowded))
    return components(links, scratch).withColumnsRenamed({"node": "fp"})


def simhash_components(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """(id, t, fp, component_id) per row of ``docs``.

    ``component_id`` is the least id reachable over links of at most two
    differing bits.  Null and blank texts have fingerprint 0 and link like any
    other; equal texts share a component; a null id never names a component
    unless no row of it has another.  Repeated rows come back repeated, an
    empty table empty; other columns don't matter.
    """
    return _rooted(docs, id, text, shingle, scratch).drop("root")


def _rooted(docs: DataFrame, id: str, text: str, shingle: int, scratch: Scratch | None = None) -> DataFrame:
    """(id, t, fp, root, component_id): ``root`` tells components apart also where they share an id."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.stage(fingerprints(docs, id, text, shingle), "prints")
    roots = fingerprint_components(prints, scratch).withColumnRenamed("fp", "f")
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    rooted = scratch.stage(firsts.join(roots, F.col("fp") == F.col("f"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = scratch.stage(rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id"), "named")
    return prints.join(named, F.col("fp") == F.col("f")).drop("f")


@keeps_columns
def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, that of the least id; columns as given.

    Of rows with this id, the one whose text has the least hash stays.  A
    document with a null id stays only where its component has no other.
    Components that share an id keep a row each.
    """
    rows = _rooted(docs, id, text, shingle)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first")
    place = lambda id, t: [id.isNull().alias("_none"), F.coalesce(id, F.lit(0)).alias("_id"), t.alias("_t")]
    keep = rows.groupBy("root").agg(first).select(*place(F.col("first.id"), F.col("first.t")))
    # repeated rows go before the texts move; the join takes the texts where that has brought them
    key = ["_none", "_id", "_t"]
    once = docs.select("*", *place(F.col(id).cast("long"), F.xxhash64(F.col(text)))).dropDuplicates(key)
    return once.join(keep, key, "left_semi").select(*docs.columns)


def near_dedup_report(docs: DataFrame) -> DataFrame:
    return simhash_components(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
