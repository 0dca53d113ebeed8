"""SentencePiece encoding as a relational lattice, and decoding.

A text becomes *units*, the longest stretches that no piece of the model can
reach across; the same units occur again and again.  The units that are new in
an input split become rows ahead of the texts that are made of them.  Their
substrings, as long as the longest piece at most, are exploded and equi-joined
to the piece table by a broadcast join; the matches are the edges of the units'
lattices.  The lattices are folded, those of a length side by side: for a
unigram model to the path of the greatest sum of scores (Viterbi), for a BPE
model to the path that its merges take, the best-scored neighbours first.
Characters that no piece covers become byte pieces, or the unknown id where the
model has none.

Texts and units stay in their input split from reading to writing, so nothing
is shuffled, and the rows' order tells which text needs which units.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keeps_columns

SPACE = "▁"
#: Units of more code points are segmented by ``segment``.
LONG = 48
#: Units whose edges a task holds, and cells of the lattices that it folds side by side.
UNITS_TOGETHER = 1 << 15
CELLS = 1 << 19
#: Words of an input split that a task remembers; about 100 MB with their units.
WORDS_TOGETHER = 250_000
#: Code points of texts whose new units come ahead of them together.
CHARS_TOGETHER = 1 << 21
_KEY = 64  # edge key: start * _KEY + length
_BITS = 20  # of a piece's id, and of its rank
#: The value of no edge.
NONE = np.iinfo(np.int64).max
#: Ways to cut units, the finest first; one is used if no piece reaches across its cuts.
_UNITS = (
    rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*[^{SPACE}\p{{L}}\p{{M}}\n]+|{SPACE}+|\n",
    rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n",
    rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+",
)


@dataclass(frozen=True)
class Model:
    """What encoding needs of a model file; ``pieces`` has (id, score) of every ordinary piece."""

    kind: str
    pieces: dict[str, tuple[int, float]]
    spelled: tuple[str | int | None, ...]  # by id: the piece, the byte's value, or None
    bytes_at: int | None
    unknown: int
    unit: str
    longest: int


def load(path: str) -> Model:
    """Read a model file; its normalisation must be the identity with a leading space."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    if sp.encode("  Ａ ", out_type=str) != [*sp.encode("  Ａ", out_type=str), SPACE]:
        raise ValueError("the model changes texts before it encodes them")
    n = sp.get_piece_size()
    pieces, spelled = {}, []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            spelled.append(int(piece[3:5], 16))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            spelled.append(None)
        else:
            spelled.append(piece)
            pieces[piece] = (i, sp.get_score(i))
    first = next((i for i in range(n) if sp.is_byte(i)), None)
    # a unigram model's scores are logarithms of probabilities; a BPE model's are the merges' ranks, whole numbers
    kind = "bpe" if all(s == int(s) for _, s in pieces.values()) else "unigram"
    return make_model(kind, pieces, tuple(spelled), first, sp.unk_id())


def make_model(kind: str, pieces: dict[str, tuple[int, float]], spelled: tuple = (), bytes_at: int | None = None, unknown: int = 0) -> Model:
    if max(i for i, _ in pieces.values()) >> _BITS or len({s for _, s in pieces.values()}) >> _BITS:
        raise ValueError(f"ids and ranks of the model's pieces take more than {_BITS} bits")
    return Model(kind, pieces, spelled, bytes_at, unknown, next(u for u in _UNITS if _never_cuts(u, pieces)), max(map(len, pieces)))


def _never_cuts(unit: str, pieces: dict) -> bool:
    """Whether the pieces stay whole; a cut depends on the two characters beside it and on spaces before them only."""
    cut = regex.compile(unit)
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    return all(len(cut.findall(x)) == 1 for x in pairs) and all(len(cut.findall(p)) == 1 for p in pieces)


def spaced(text: str) -> str:
    """The text with its spaces made visible and one put in front; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def segment(unit: str, model: Model) -> list[int]:
    """Ids of one unit, by the same rule as the lattice; for units too long for it."""
    cuts = _merged(unit, model) if model.kind == "bpe" else _best(unit, model)
    ids: list[int] = []
    for a, b in zip(cuts, cuts[1:]):
        found = model.pieces.get(unit[a:b])
        ids += [found[0]] if found else _unknown(unit[a:b], model)
    return ids


def _unknown(char: str, model: Model) -> list[int]:
    return [model.unknown] if model.bytes_at is None else [model.bytes_at + x for x in char.encode("utf-8", "surrogatepass")]


def _merged(unit: str, model: Model) -> list[int]:
    n = len(unit)
    right, left, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] < n:
            end = right[right[i]]
            found = model.pieces.get(unit[i:end]) if end - i <= model.longest else None
            if found:
                heapq.heappush(heap, (-found[1], i, end))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = right[i]
        if not live[i] or j >= n or right[j] != end:
            continue
        live[j], right[i] = False, end
        if end < n:
            left[end] = i
        offer(left[i])
        offer(i)
    return [*(i for i in range(n) if live[i]), n]


def _best(unit: str, model: Model) -> list[int]:
    low = min(s for _, s in model.pieces.values()) - 10
    score, back = [0.0], [0]
    for e in range(1, len(unit) + 1):
        found = [(score[e - 1] + low, -1)]
        for k in range(1, min(e, model.longest) + 1):
            if piece := model.pieces.get(unit[e - k : e]):
                found = [f for f in found if not (f[1] == -1 and k == 1 and f[0] == score[e - 1] + low)]
                found.append((score[e - k] + piece[1], -k))
        s, k = max(found)
        score.append(s)
        back.append(e + k)
    cuts = [len(unit)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _merge(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The path that merges the best-ranked neighbours first, the left of equals, of many lattices side by side.

    ``edges`` has the value of the piece by unit, start and length, NONE for
    no piece; the answer has, by unit and start, whether a cut is there and
    where the next one is.
    """
    n, longest = edges.shape[1], edges.shape[2] - 1
    ranks = edges >> _BITS
    ends, starts = np.tile(np.arange(1, n + 1), (len(edges), 1)), np.tile(np.arange(-1, n), (len(edges), 1))
    cuts, best = np.ones((len(edges), n), dtype=bool), np.full((len(edges), n), NONE >> _BITS)
    best[:, : n - 1] = ranks[:, : n - 1, min(2, longest)] if longest > 1 else NONE >> _BITS
    live = np.arange(len(edges))
    while len(live):
        at = best[live].argmin(axis=1)
        more = best[live, at] < NONE >> _BITS
        live, at = live[more], at[more]
        gone = ends[live, at]
        end = ends[live, gone]
        ends[live, at], starts[live, end], cuts[live, gone], best[live, gone] = end, at, False, NONE >> _BITS
        after = np.where(end < n, ends[live, np.minimum(end, n - 1)], n + longest) - at
        best[live, at] = ranks[live, at, np.where(after <= longest, after, 0)]
        before = starts[live, at]
        some = before >= 0
        rows, before, span = live[some], before[some], (end - before)[some]
        best[rows, before] = ranks[rows, before, np.where(span <= longest, span, 0)]
    return cuts, ends


def _viterbi(edges: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_merge``: the path of the greatest sum of scores; of equals that whose last piece is the shorter."""
    n, longest, rows = edges.shape[1], edges.shape[2] - 1, np.arange(len(edges))
    of = np.append(scores, -np.inf)[np.minimum(edges >> _BITS, len(scores))]
    of[:, :, 1] = np.where(edges[:, :, 1] == NONE, scores[-1] - 10, of[:, :, 1])
    score, back = np.full((len(edges), n + 1), -np.inf), np.zeros((len(edges), n + 1), dtype=int)
    score[:, 0] = 0
    for end in range(1, n + 1):
        for k in range(1, min(longest, end) + 1):
            found = score[:, end - k] + of[:, end - k, k]
            better = found > score[:, end]
            score[better, end], back[better, end] = found[better], end - k
    cuts, ends, end = np.zeros((len(edges), n), dtype=bool), np.zeros((len(edges), n), dtype=int), np.full(len(edges), n)
    while len(rows):
        start = back[rows, end]
        cuts[rows, start], ends[rows, start] = True, end
        rows, end = rows[start > 0], start[start > 0]
    return cuts, ends


def _fold(units: list[str], of: np.ndarray, edges: np.ndarray, model: Model) -> dict[str, bytes]:
    """Ids of each unit, four bytes each; ``of`` has the unit's place for each edge.  Units of a length are folded side by side."""
    found, sizes = {}, np.fromiter(map(len, units), int, len(units))
    start, length, value = edges >> (2 * _BITS + 6), edges >> 2 * _BITS & _KEY - 1, edges & (1 << 2 * _BITS) - 1
    scores = np.array(ranked(model))
    size = sizes[of]
    by_size = np.argsort(size, kind="stable")
    for n in np.unique(sizes):
        own, longest = np.flatnonzero(sizes == n), min(int(n), model.longest)
        mine = by_size[slice(*(np.searchsorted(size, n, side, by_size) for side in ("left", "right")))]
        together = max(1, CELLS // (n * (longest + 1)))
        for i in range(0, len(own), together):
            some = own[i : i + together]
            e = mine[slice(*np.searchsorted(of[mine], [some[0], some[-1] + 1]))]
            lattice = np.full((len(some), n, longest + 1), NONE)
            lattice[np.searchsorted(some, of[e]), start[e], length[e]] = value[e]
            cuts, ends = _merge(lattice) if model.kind == "bpe" else _viterbi(lattice, scores)
            unit, at = np.nonzero(cuts)
            path = lattice[unit, at, ends[unit, at] - at]
            data, stops = (path & (1 << _BITS) - 1).astype("<i4").tobytes(), np.cumsum([0, *(4 * cuts.sum(axis=1))]).tolist()
            found.update(zip([units[u] for u in some], [data[a:b] for a, b in zip(stops, stops[1:])]))
            for u in np.unique(unit[path == NONE]):
                name, here = units[some[u]], slice(*np.searchsorted(unit, [u, u + 1]))
                ids = [[v & (1 << _BITS) - 1] if v != NONE else _unknown(name[a], model) for a, v in zip(at[here].tolist(), path[here].tolist())]
                found[name] = np.array(sum(ids, []), "<i4").tobytes()
    return found


def ranked(model: Model) -> list[float]:
    """The model's scores, best first; a piece's rank is its score's place."""
    return sorted({s for _, s in model.pieces.values()}, reverse=True)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, value) with rank and id in one number; as many rows as the model has pieces."""
    rank = {s: r for r, s in enumerate(ranked(model))}
    return spark.createDataFrame([(p, rank[s] << _BITS | i) for p, (i, s) in model.pieces.items()], "piece string, value long")


def _edges(rows: DataFrame, model: Model) -> DataFrame:
    """Each row with a ``_unit`` becomes the edges of the unit's lattice, in the order of the rows.

    ``_edge`` packs start, length and value of a piece.  The first row of a
    unit is there without a piece too, and it alone keeps the unit's name;
    ``_row`` numbers the given rows within their partition.  Nothing is
    shuffled: the substrings meet the piece table, which is as large as the
    model, by a broadcast join.
    """
    pieces = piece_table(rows.sparkSession, model).select(F.col("piece").alias("_piece"), F.col("value").alias("_value"))
    size, longest = F.length("_unit"), min(LONG, model.longest)
    substrings = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .select("*", F.explode_outer(F.sequence(F.lit(0), size - 1)).alias("_s"))
        .select("*", F.explode_outer(F.when(size.isNotNull(), F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("_s"))))).alias("_k"))
        .withColumn("_of", F.substring("_unit", F.col("_s") + 1, F.col("_k")))
    )
    first = (F.col("_s") == 0) & (F.col("_k") == 1)
    edge = F.shiftleft((F.col("_s") * _KEY + F.col("_k")).cast("long"), 2 * _BITS).bitwiseOR(F.col("_value"))
    return (
        substrings.join(F.broadcast(pieces), F.col("_of") == F.col("_piece"), "left")
        .where(F.col("_value").isNotNull() | first | F.col("_unit").isNull())
        .select(*(f"`{c}`" for c in rows.columns if c != "_unit"), "_row", F.when(first, F.col("_unit")).alias("_unit"), edge.alias("_edge"))
    )


def _folds(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[dict[str, bytes], pa.RecordBatch | None]]:
    """In the order of ``_edges``' rows: the ids of units, and the rows between them that are none."""
    last, units, firsts, edges = None, [], [], []

    def folded(whole: bool) -> dict[str, bytes]:
        # the last unit may go on in the next batch
        nonlocal units, firsts, edges
        first, edge = np.concatenate(firsts), np.concatenate(edges)
        to = len(first) if whole else int(np.flatnonzero(first)[-1])
        has = np.flatnonzero(edge[:to] >= 0)
        keep = len(units) - int(first[to:].sum())
        found = _fold(units[:keep], (np.cumsum(first[:to]) - 1)[has], edge[has], model)
        units, firsts, edges = units[keep:], [first[to:]], [edge[to:]]
        return found

    for b in batches:
        if not b.num_rows:
            continue
        row, name = b.column("_row").to_numpy(), b.column("_unit")
        edge = b.column("_edge").fill_null(-1).to_numpy()
        first = name.is_valid().to_numpy(zero_copy_only=False)
        other = ~first & (edge < 0)
        if (np.diff(row, prepend=row[0] - (first | other)[0] if last is None else last) != (first | other)).any():
            raise ValueError("the edges of the lattices have lost their order")
        last = row[-1]
        bounds = [0, *(np.flatnonzero(np.diff(other)) + 1).tolist(), len(row)]
        for i, j in zip(bounds, bounds[1:]):
            if other[i]:
                yield folded(True) if units else {}, b.slice(i, j - i)
                continue
            units += name.slice(i, j - i).drop_null().to_pylist()
            firsts.append(first[i:j])
            edges.append(edge[i:j])
            if len(units) > UNITS_TOGETHER:
                yield folded(False), None
    if units:
        yield folded(True), None


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) of non-empty units, by the lattice; those over LONG code points by ``segment``."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in _folds(batches, model):
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), _lists(list(found.values()))], ["unit", "ids"])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([segment(u.as_py(), model) for u in b.column(0)], pa.list_(pa.int32()))], ["unit", "ids"])

    rows, kind = units.select(F.col("unit").alias("_unit")), "unit string, ids array<int>"
    found = _edges(rows.where(F.length("_unit") <= LONG), model).mapInArrow(short, kind)
    return found.unionByName(rows.where(F.length("_unit") > LONG).mapInArrow(long, kind))


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _words(text: str | None) -> list[str]:
    """What stands between the lone spaces of a text; one with spaces side by side or at an end is one word."""
    if not text:
        return []
    return [text] if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text else text.split(" ")


def _cut(word: str, find: Callable[[str], list[str]]) -> list[str]:
    """Units of a word; one of letters alone is never cut."""
    return [SPACE + word] if word.isalpha() else find(spaced(word))


def _units_of(docs: DataFrame, text: str, model: Model, together: int = WORDS_TOGETHER) -> DataFrame:
    """``docs``, and rows of nulls with a ``_unit`` each: what the texts after them are made of, but for units over LONG.

    What is known to be out already is kept up to ``together`` words of a
    split, then forgotten, so that memory doesn't follow the split's vocabulary.
    """
    unit = model.unit

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, out = regex.compile(unit).findall, set(), set()
        for b in batches:
            names, kinds = [*b.schema.names, "_unit"], b.schema.types
            new, begun, size = {}, 0, 0
            for i, t in enumerate(b.column(text)):
                t = t.as_py()
                for w in filterfalse(seen.__contains__, _words(t)):
                    new.update((u, None) for u in _cut(w, find) if u not in out and len(u) <= LONG)
                    if len(w) < LONG:
                        seen.add(w)
                size += len(t or "")
                if size < CHARS_TOGETHER and len(seen) < together and i < b.num_rows - 1:
                    continue
                if new:
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(new), k) for k in kinds), pa.array(list(new), pa.string())], names)
                here = b.slice(begun, i + 1 - begun)
                yield pa.RecordBatch.from_arrays([*here.columns, pa.nulls(len(here), pa.string())], names)
                out.update(new)
                if len(seen) >= together:
                    seen.clear()
                    out.clear()
                new, begun, size = {}, i + 1, 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(of, f"{schema}, _unit string")


class _WordIds(dict):
    """Ids of words, four bytes each, put together from those of their units when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.units, self.find = model, {}, regex.compile(model.unit).findall

    def __missing__(self, word: str) -> bytes:
        found = b"".join([self.units[u] if len(u) <= LONG else np.array(segment(u, self.model), "<i4").tobytes() for u in _cut(word, self.find)])
        if len(word) < LONG:
            self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.units.clear()


def _encoded(docs: DataFrame, model: Model, text: str, into: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch], kind: str) -> DataFrame:
    """What ``finish`` makes of the rows of ``docs`` and their ids; it has the columns of ``kind``."""
    together = WORDS_TOGETHER
    rows = docs.select(*(f"`{c}`" for c in docs.columns if c != into or c == text))
    names = [c for c in rows.columns if c != into]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordIds(model)
        for found, b in _folds(batches, model):
            words.units.update(found)
            if b is None:
                continue
            out = []
            for t in b.column(text):
                out.append(b"".join(map(words.__getitem__, _words(t.as_py()))))
                # as _units_of, after the same text
                if len(words) >= together:
                    words.forget()
            yield finish(pa.RecordBatch.from_arrays([*(b.column(n) for n in names), _lists(out)], [*names, into]))

    return _edges(_units_of(rows, text, model, together), model).mapInArrow(of, kind)


@keeps_columns
def encode(docs: DataFrame, model: Model, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with column ``into``: the ids of the text, those of the model's own encoder.

    A null or empty text has no ids.  Equal texts get equal ids, repeated rows
    stay, an empty table stays empty.  Other columns pass through, but for one
    named like ``into``, which is replaced.
    """
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != into] + [f"`{into}` array<int>"])
    return _encoded(docs, model, text, into, lambda b: b, kind)


def decode_ids(ids: list[int], model: Model) -> str:
    """The text of ids: control ids give nothing, bytes that aren't UTF-8 the replacement character."""
    out, raw = [], bytearray()
    for i in ids:
        piece = model.spelled[i] if 0 <= i < len(model.spelled) else None
        if isinstance(piece, int):
            raw.append(piece)
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        if piece is not None:
            out.append(piece.replace(SPACE, " "))
        elif i == model.unknown:
            out.append(" ⁇ ")
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    return re.sub(r"\A ", "", "".join(out))


def decode(encoded: DataFrame, model: Model, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with column ``into``: the text of the ids; null ids give the empty text."""
    names = [c for c in encoded.columns if c != into]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(x or [], model) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != into)
    return encoded.select(*names).mapInArrow(of, f"{fields}, `{into}` string")


def _spelling(model: Model) -> pa.LargeBinaryArray:
    """Bytes of each id, and of one more that stands for ids the model doesn't have; control ids have none."""
    spelled = [bytes([x]) if isinstance(x, int) else (x or "").replace(SPACE, " ").encode() for x in model.spelled]
    if model.unknown < len(spelled) and model.spelled[model.unknown] is None:
        spelled[model.unknown] = " ⁇ ".encode()
    return pa.array([*spelled, b""], pa.large_binary())


def _texts(lists: pa.ListArray, model: Model, spelling: pa.LargeBinaryArray) -> list[str]:
    """``decode_ids`` of each list, put together from the bytes of all of them at once."""
    ids = lists.flatten().to_numpy()
    if not len(ids):
        return [""] * len(lists)
    found = spelling.take(pa.array(np.where((ids >= 0) & (ids < len(spelling)), ids, len(spelling) - 1)))
    stops, ends = np.frombuffer(found.buffers()[1], "<i8"), np.cumsum([0, *lists.value_lengths().to_pylist()])
    data, cuts = (found.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), stops[ends].tolist()
    # an id without bytes parts those beside it
    silent = np.diff(np.cumsum(np.append(0, np.diff(stops) == 0))[ends]).tolist()
    return [decode_ids(x.as_py(), model) if n else data[a:b].decode("utf-8", "replace").removeprefix(" ") for x, n, a, b in zip(lists, silent, cuts, cuts[1:])]


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """Per document: its ids, their number, and the SHA-256 of the text that they decode to."""
    model = load(path)
    spelling = _spelling(model)

    def report(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = _texts(b.column("ids"), model, spelling)
        given = [(t or "").replace(SPACE, " ") for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("ids"), b.column("ids").value_lengths().cast(pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                pa.array([a == g for a, g in zip(texts, given)], pa.bool_()),
            ],
            ["doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip"],
        )

    kind = "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"
    return _encoded(docs.select("doc_id", "text"), model, "text", "ids", report, kind)
