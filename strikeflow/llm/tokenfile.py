"""Token ids of a corpus in compressed files, in document order.

A file row, the *record*, holds whole consecutive documents of about
RECORD_TOKENS tokens: their ids and lengths, the number of tokens before the
record in the corpus, and the tokens as independent range-coded blocks
(``rans``) with checkpoints and checksums.  The frequency table of the whole
corpus is written beside the records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .shared import Scratch, workers_quiet

RECORD_TOKENS = 8 * rans.BLOCK
END_ID = 2
#: Distinct words whose ids a worker keeps at a time, in about 40 bytes each.
WORDS_KEPT = 1 << 21
#: Bytes of texts whose words are looked up, and the new ones encoded, together.
BYTES_TOGETHER = 1 << 24
#: New words in one text, and such texts that are encoded by one call.
WORDS_TOGETHER = 256
TEXTS_TOGETHER = 128
#: A space in the names of byte-level tokens.
BYTE_SPACE = "\u0120"

_PLAIN = "part int, seq int, before long, n long, ids array<long>, sizes array<long>, tokens binary"
_CODED = "start long, n long, ids array<long>, sizes array<long>, blocks array<binary>"


class WordIds:
    """Ids of words led by one space, four bytes each, by the word without it; none for what can't be cut off.

    The tokenizer never joins over a lone space between other characters, so a
    text may be cut there and each piece encoded once.  For the same reason the
    new words of many texts are encoded as a few long texts, and cut before each id
    whose token begins with a space.  Words and ids are Arrow arrays, in which the
    distinct words of many texts are looked up together.
    """

    def __init__(self, path: str):
        workers_quiet()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith(BYTE_SPACE)]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, new: pa.Array) -> None:
        """Encode words that aren't kept yet, together; one by one if the ids can't be told apart."""
        given = new.to_numpy(zero_copy_only=False).tolist()
        # a piece with white space at an end, or of nothing else, can't be cut off
        good = np.array([w != "" and not w[0].isspace() and not w[-1].isspace() for w in given], dtype=bool)
        words = given if good.all() else [given[k] for k in np.flatnonzero(good).tolist()]
        found = [np.zeros(0, dtype="<u4")]
        for i in range(0, len(words), WORDS_TOGETHER * TEXTS_TOGETHER):
            some = words[i : i + WORDS_TOGETHER * TEXTS_TOGETHER]
            joined = [" " + " ".join(some[j : j + WORDS_TOGETHER]) for j in range(0, len(some), WORDS_TOGETHER)]
            found += [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(found)
        sizes, starts = np.zeros(len(given) + 1, dtype="<i8"), np.flatnonzero(self.leads[ids])
        if len(starts) == len(words) and (not words or starts[0] == 0):
            sizes[1:][good] = np.diff(starts, append=len(ids))
        else:
            singly = [self.whole(" " + w) for w in words]
            ids, sizes[1:][good] = np.array([*chain.from_iterable(singly)], dtype="<u4"), [*map(len, singly)]
        learnt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(given), [None, pa.py_buffer(4 * np.cumsum(sizes)), pa.py_buffer(ids)])
        self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, learnt])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text.  A word is looked up once, however often the texts have it."""
        if len(self.words) > WORDS_KEPT:
            self.forget()
        if not len(texts):
            return []
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = pc.split_pattern(texts, " ")
        sizes = parts.value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        flat = parts.flatten().dictionary_encode()
        words, at = flat.dictionary.cast(pa.large_string()), flat.indices.to_numpy()
        # the first word of a text is not led by a space
        firsts = words.take(pa.array(at[ends - sizes])).to_pylist()
        cut = (sizes > 1) & np.array([w != "" and not w[-1].isspace() for w in firsts])
        led = np.repeat(cut, sizes)
        led[ends - sizes] = False
        used = np.zeros(len(words), dtype=bool)
        used[at[led]] = True
        place = pc.index_in(words, self.words).fill_null(-1).to_numpy().copy()
        new = used & (place < 0)
        place[new] = len(self.words) + np.arange(new.sum())
        self.learn(words.filter(pa.array(new)))
        known = self.ids.take(pa.array(place, mask=place < 0))
        odd = used & (pc.binary_length(known).fill_null(0).to_numpy() == 0)
        cut &= np.add.reduceat(odd[at] & led, ends - sizes, dtype=int) == 0
        ids = known.fill_null(b"").take(flat.indices)
        stops, data = np.frombuffer(ids.buffers()[1], "<i8"), (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        spans = zip(cut.tolist(), firsts, stops[ends - sizes + 1].tolist(), stops[ends].tolist())
        return [np.frombuffer(_bytes(self.whole(w)) + data[i:j] if c else _bytes(self.whole(t.as_py())), "<u4") for t, (c, w, i, j) in zip(texts, spans)]


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _record(part: int, seq: int, before: int, ids: list, sizes: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate(tokens).astype("<u4")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([_narrow(flat)], pa.binary()),
        ],
        ["part", "seq", "before", "n", "ids", "sizes", "tokens"],
    )


def _narrow(flat: np.ndarray) -> bytes:
    """The ids as 16-bit numbers where all fit, marked by a leading byte."""
    return b"\x02" + flat.astype("<u2").tobytes() if not len(flat) or flat.max() < 1 << 16 else b"\x04" + flat.tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where texts begin and end that make BYTES_TOGETHER, or one text more."""
    begun, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
        size += n
        if size >= BYTES_TOGETHER or i == len(texts):
            yield begun, i
            begun, size = i, 0


def encode_records(docs: DataFrame, path: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Records of plain ids in ascending order of ``id``; part is the place of the sorted partition."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _word_ids(path), TaskContext.get().partitionId()
        ids, sizes, tokens, n, seq, before = [], [], [], 0, 0, 0
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            for begun, done in _together(b.column(1)):
                for i, found in zip(b.column(0)[begun:done].to_pylist(), words.encode_all(b.column(1)[begun:done])):
                    ids.append(i)
                    sizes.append(len(found) + 1)
                    tokens += [found, end]
                    n += len(found) + 1
                    if n >= RECORD_TOKENS:
                        yield _record(part, seq, before, ids, sizes, tokens)
                        ids, sizes, tokens, n, seq, before = [], [], [], 0, seq + 1, before + n
        if ids:
            yield _record(part, seq, before, ids, sizes, tokens)

    return rows.mapInArrow(of, _PLAIN)


def count_tokens(records: DataFrame) -> dict[int, int]:
    """Occurrences of each id; as many rows reach the driver as the vocabulary has ids."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for data in b.column(0):
                found = np.bincount(_wide(data.as_py()))
                total = np.pad(total, (0, max(0, len(found) - len(total))))
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = records.select("tokens").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.collect()}


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> None:
    """Write ``folder``/records and ``folder``/table.

    Each text, null as the empty one, becomes its ids and ``end_id``.  Documents
    come in ascending order of ``id`` (null first), ties by text; repeated rows
    are written as often.  An empty table gives no records and an empty
    frequency table.  Other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    records = scratch.stage(encode_records(docs, tokenizer, end_id, id, text), "plain")
    counts = count_tokens(records)
    dense = np.zeros(max(counts, default=-1) + 1, dtype=np.int64)
    dense[list(counts)] = list(counts.values())
    freq = rans.quantise(dense)
    spark.createDataFrame([(freq.astype("<u4").tobytes(),)], "freq binary").coalesce(1).write.parquet(f"{folder}/table")

    # one row per partition
    parts = records.groupBy("part").agg(F.sum("n").alias("n")).withColumn("offset", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    placed = records.join(F.broadcast(parts.select(F.col("part").alias("p"), "offset")), F.col("part") == F.col("p"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        for b in batches:
            blocks = [rans.encode(table, _wide(x.as_py())) for x in b.column(4)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(blocks, pa.list_(pa.binary()))], ["start", "n", "ids", "sizes", "blocks"])

    coded = placed.select((F.col("before") + F.col("offset")).alias("start"), "n", "ids", "sizes", "tokens").mapInArrow(of, _CODED)
    coded.write.option("compression", "uncompressed").parquet(f"{folder}/records")
    scratch.drop("plain")


def read_table(spark: SparkSession, folder: str) -> np.ndarray:
    """The frequency table: four bytes for each id of the vocabulary."""
    return np.frombuffer(spark.read.schema("freq binary").parquet(f"{folder}/table").first()["freq"], "<u4")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, tokens: array of int) of each document, decoded and checked."""
    return _read(spark, folder, lambda t: t.astype(np.int32).tolist(), pa.list_(pa.int32()), "tokens array<int>")


def _read(spark: SparkSession, folder: str, value, kind: pa.DataType, column: str) -> DataFrame:
    freq = read_table(spark, folder)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        for b in batches:
            for start, n, ids, sizes, blocks in zip(*(b.column(i) for i in range(5))):
                tokens = rans.decode(table, blocks.as_py())
                sizes = np.array(sizes.as_py(), dtype=np.int64)
                ends = np.cumsum(sizes)
                if len(tokens) != n.as_py() or len(tokens) != ends[-1]:
                    raise ValueError("a record of token ids is incomplete")
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(start.as_py() + ends - sizes), pa.array(sizes), pa.array([value(tokens[e - s : e]) for s, e in zip(sizes, ends)], kind)],
                    ["doc_id", "start", "n_tokens", column.split()[0]],
                )

    return spark.read.schema(_CODED).parquet(f"{folder}/records").mapInArrow(of, f"doc_id long, start long, n_tokens long, {column}")


def token_file_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files, read them back: per document its place, length and checksum."""
    spark = docs.sparkSession
    folder = Scratch(spark, "tokenfile").root
    write_token_files(docs, folder, tokenizer)
    return _read(spark, folder, lambda t: zlib.crc32(t.astype("<u4").tobytes()), pa.int64(), "ids_crc32 long")
