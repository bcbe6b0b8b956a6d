"""Long stretches of text that stand verbatim in more than one document.

Content-defined chunking with a gear rolling hash: every window of ``length`` characters has
its lowest gear hash (over ``GRAM`` characters) among its first ``reach`` grams as anchor, and
its chunk runs from there to the end of the next anchor's gram, or on to the least length that
every window with this anchor holds, known by a 64-bit digest.
Both depend on the window's own characters only, since 2 * reach + GRAM <= length, so an
insertion changes no chunk beyond it, and equal windows have equal chunks.

1. The texts are read once for their chunks. One shuffle of digests finds the chunks that more
   than one text holds. The surroundings of a chunk (all the windows it belongs to, which follow
   one another) are digested along.
2. Where all texts that share a chunk also share its surroundings, all those windows are
   shared and the stretch is known without reading a text again.
3. Elsewhere (edges of shared stretches, boilerplate among different texts) the texts are
   read once more and every window of such an anchor is compared by a 128-bit digest.

What several texts of a slice of a task hold is settled in that slice, and one of them goes on
for all, so a chunk or window that a third of all texts hold arrives as one row per slice, not
per text. Texts that are exact copies are chunked once per task and stand for one text, known
by 125 bits of hash; their documents are shared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import durable, spread

LENGTH = 300
GRAM = 32
#: The places that need a second look are broadcast up to this many, 8 bytes each, in up to this many texts, else joined.
BROADCAST_PLACES = 2_000_000
BROADCAST_TEXTS = 500_000
#: So many of the most frequent texts are joined by broadcast; each other one has less than a thousandth of all rows.
HOT_TEXTS = 1_000
#: Windows of a text digested together, and chunks or windows in a slice; both bound memory only.
PIECE = 1_000_000
SLICE_ROWS = 200_000

_U = np.uint64
_BASE = (_U(0xD6E8FEB86659FD93), _U(0xA3B195354A39B70D))
_UNDO = tuple(_U(pow(int(b), -1, 2**64)) for b in _BASE)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each code point."""
    x = (x.astype(np.uint64) + _U(salt + 1)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _power(lane: int, n: int, undo: bool) -> np.ndarray:
    """The first ``n`` powers of a lane's base, or of its inverse modulo 2^64."""
    have = _powers.get((lane, undo))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, (_UNDO if undo else _BASE)[lane])
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[(lane, undo)] = have
    return have[:n]


class Digester:
    """Digests of any stretches of one text: differences of a running polynomial sum."""

    def __init__(self, points: np.ndarray, lane: int):
        self.lane, n = lane, len(points)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(points, lane) * _power(lane, n, False), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * _power(self.lane, len(self.sums), True)[start]
        x ^= x >> _U(31)
        return (x + (end - start).astype(np.uint64)) * _U(0x94D049BB133111EB)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gear(points: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at the end of every gram: h(i) = 2 h(i-1) + g(i), all at once by doubling."""
    h = (_mix(points, 7) >> _U(32)).astype(np.uint32)
    s = 1
    while s < GRAM:
        more = h.copy()
        more[s:] += h[:-s] << np.uint32(s)
        h, s = more, 2 * s
    return h[GRAM - 1 :]


def anchors(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the anchor grams, and for each the first window whose own anchor it is.

    A window's anchor is the last lowest gear hash of its first ``reach`` grams, so equal windows
    have equal anchors whatever stands around them. Windows are named by their start.
    """
    if len(points) < GRAM + reach - 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    h = gear(points)
    m = len(h)
    low = (h.astype(np.uint64) << _U(32)) | np.arange(m - 1, -1, -1, dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
    at = (m - 1) - (low & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], first


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pieces(points: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """A text in parts whose windows together are the text's, each once: ``(first window, characters)``."""
    for at in range(0, len(points) - length + 1, PIECE):
        yield at, points[at : at + PIECE + length - 1]


def chunks(points: np.ndarray, length: int, reach: int) -> list[tuple[np.ndarray, ...]]:
    """Digest, digest of the surroundings, first and last window of each chunk, piece by piece."""
    least = length - reach + 1
    out = []
    for start, part in pieces(points, length):
        at, first = anchors(part, reach)
        last = np.minimum(first[1:] - 1, len(part) - length)
        keep = last >= first[:-1]
        a, b, lo, last = at[:-1][keep], at[1:][keep], first[:-1][keep], last[keep]
        d = Digester(part, 0)
        out.append((_signed(d.of(a, np.maximum(b + GRAM, a + least))), _signed(d.of(lo, last + length)), lo + start, last + start))
    return out


# Kinds of rows: a document; a chunk to be compared, or one that stands for differing surroundings; windows known
# to be shared; windows to be compared one by one.
_DOC, _CHUNK, _MIXED, _WHOLE, _EDGE = range(5)
#: The lowest bits of a text's second hash are free for the kind of a row; texts are known by 125 bits.
_KIND_BITS = 3


def settled(keys: tuple[np.ndarray, ...], text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a slice by key: ``(order, start of each group in it, whether several texts are in the group)``."""
    order = np.lexsort((text, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(order))
    return order, start, text[order[start]] != text[order[end - 1]]


def joined_windows(text: np.ndarray, lo: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows with those of a text that follow one another put together."""
    if not len(text):
        return text, lo, last
    order = np.lexsort((lo, text))
    text, lo, last = text[order], lo[order], last[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (lo[1:] > last[:-1] + 1)
    start = np.flatnonzero(new)
    return text[start], lo[start], last[np.append(start[1:], len(order)) - 1]


def _settled_chunks(digest: np.ndarray, around: np.ndarray, text: np.ndarray, lo: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Rows ``(kind, digest, around, text, lo, last)`` of a slice's chunks.

    Of a chunk that several texts of the slice hold one row goes on; their windows are known to be shared
    if the surroundings are equal, else to be compared.
    """
    order, start, many = settled((digest,), text)
    group = np.cumsum(np.bincount(start, minlength=len(order))) - 1
    uniform = np.minimum.reduceat(around[order], start) == np.maximum.reduceat(around[order], start)
    # in the order of texts, so that what a text's rows have in common lies together
    alone = np.sort(order[~many[group]])
    first = np.sort(order[start[many]])
    uniform_at = np.empty(len(order), bool)
    uniform_at[order] = uniform[group]
    rows = [
        (np.full(len(alone), _CHUNK, np.int8), digest[alone], around[alone], text[alone], lo[alone], last[alone]),
        (np.where(uniform_at[first], _CHUNK, _MIXED).astype(np.int8), digest[first], around[first], text[first], lo[first], last[first]),
    ]
    for kind, which in ((_WHOLE, uniform), (_EDGE, ~uniform)):
        own = order[(many & which)[group]]
        t, a, b = joined_windows(text[own], lo[own], last[own])
        zero = np.zeros(len(t), np.int64)
        rows.append((np.full(len(t), kind, np.int8), _signed(_mix(t, 5) ^ _mix(a, 6)), zero, t, a, b))
    return rows


def chunk_texts(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """``(key, around, cid, tag, at, doc)`` of ``docs`` ``(id, text, cid, cid2)``: a row per document, and rows per chunk
    and text (see :func:`_settled_chunks`). ``key`` is a chunk's digest, and else spreads the rows; ``tag`` is ``cid2``
    with the kind in its lowest bits, ``at`` the first and the last window, ``doc`` ``(id, n)``. So packed, rows are short."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        number = 0
        for batch in batches:
            ids, texts, cid, cid2 = (batch.column(i) for i in range(4))
            hashes = [np.asarray(c) for c in (cid, cid2)]
            sizes = np.zeros(batch.num_rows, np.int32)
            held: list[tuple[int, tuple[np.ndarray, ...]]] = []
            size = 0
            for k in range(batch.num_rows):
                points = code_points(texts[k].as_py())
                sizes[k] = len(points)
                name = (int(hashes[0][k]), int(hashes[1][k]))
                if name in met:
                    continue
                met.add(name)
                for c in chunks(points, length, reach):
                    held.append((k, c))
                    size += len(c[0])
                if size > SLICE_ROWS:
                    yield chunk_rows(held, ids, hashes)
                    held, size = [], 0
            if size:
                yield chunk_rows(held, ids, hashes)
            n = batch.num_rows
            zero = np.zeros(n, np.int64)
            spread_by = _signed(_mix(np.arange(number, number + n), 9) ^ hashes[0].view(_U))
            number += n
            doc = pa.StructArray.from_arrays([ids, pa.array(sizes)], names=["id", "n"])
            yield pa.RecordBatch.from_arrays([*map(pa.array, (spread_by, zero, hashes[0], hashes[1] | _DOC, zero)), doc], names=_NAMES)

    def chunk_rows(held: list[tuple[int, tuple[np.ndarray, ...]]], ids: pa.Array, hashes: list[np.ndarray]) -> pa.RecordBatch:
        digest, around, lo, last = (np.concatenate([c[i] for _, c in held]) for i in range(4))
        text = np.repeat(np.array([k for k, _ in held], dtype=np.int64), [len(c[0]) for _, c in held])
        parts = _settled_chunks(digest, around, text, lo, last)
        kind, key, around, text, lo, last = (np.concatenate([p[i] for p in parts]) for i in range(6))
        cols = [key, around, hashes[0][text], hashes[1][text] | kind, lo << 32 | last]
        none = pa.nulls(len(kind), pa.struct([("id", ids.type), ("n", pa.int32())]))
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), none], names=_NAMES)

    return docs.select("id", "text", "cid", "cid2").mapInArrow(
        run, f"key long, around long, cid long, tag long, at long, doc struct<id:{id_type},n:int>"
    )


_NAMES = ["key", "around", "cid", "tag", "at", "doc"]


def kind_of(tag: Column) -> Column:
    return tag.bitwiseAND((1 << _KIND_BITS) - 1)


def name_of(tag: Column) -> Column:
    return tag.bitwiseAND(-(1 << _KIND_BITS))


def compared_chunks(rows: DataFrame) -> DataFrame:
    """Of :func:`chunk_texts` the documents, and the windows that are shared or to be compared: ``(kind, cid, cid2, lo, last, id, n)``."""
    own = kind_of(F.col("tag"))
    chunk = own.isin(_CHUNK, _MIXED)
    w = Window.partitionBy("key")
    of = lambda c: F.when(chunk, F.col(c))
    marked = rows.withColumns({
        "_many": F.min(of("cid")).over(w) != F.max(of("cid")).over(w),
        "_same": (F.min(of("around")).over(w) == F.max(of("around")).over(w)) & (F.max(F.when(chunk, own == _MIXED)).over(w) == F.lit(False)),
    })
    kind = F.when(chunk, F.when(F.col("_same"), _WHOLE).otherwise(_EDGE)).otherwise(own).cast("tinyint")
    lo, last = F.shiftright("at", 32).cast("int").alias("lo"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("last")
    return marked.filter(~chunk | F.col("_many")).select(kind.alias("kind"), "cid", name_of(F.col("tag")).alias("cid2"), lo, last, "doc.id", "doc.n")


def window_digests(texts: DataFrame, length: int) -> DataFrame:
    """``(w0, w1, cid, tag, lo)``: the windows in the listed ranges ``places`` of ``texts`` ``(text, cid, cid2, places)``,
    ``(lo, last)`` each, every window a row with its digest; ranges that several texts of a slice hold
    come out settled, told by an odd ``tag`` and with the last window in ``w1``, and one of those texts'
    windows for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            hashes = [np.asarray(batch.column(i)) for i in (1, 2)]
            places = batch.column(3)
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for k in range(batch.num_rows):
                name = (int(hashes[0][k]), int(hashes[1][k]))
                if name in met:
                    continue
                met.add(name)
                points = code_points(batch.column(0)[k].as_py())
                flat = places[k].values
                lo, last = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                for start, part in pieces(points, length):
                    a, b = np.maximum(lo - start, 0), np.minimum(last - start, PIECE - 1)
                    keep = b >= a
                    if not keep.any():
                        continue
                    a, n = a[keep], (b - a + 1)[keep]
                    at = np.unique(np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                    w0, w1 = (_signed(Digester(part, lane).of(at, at + length)) for lane in (0, 1))
                    held.append((w0, w1, np.full(len(at), k, dtype=np.int64), at + start))
                    size += len(at)
                    if size > SLICE_ROWS:
                        yield window_rows(held, hashes)
                        held, size = [], 0
            if held:
                yield window_rows(held, hashes)

    def window_rows(held: list[tuple[np.ndarray, ...]], hashes: list[np.ndarray]) -> pa.RecordBatch:
        w0, w1, text, at = (np.concatenate([h[i] for h in held]) for i in range(4))
        order, start, many = settled((w1, w0), text)
        group = np.cumsum(np.bincount(start, minlength=len(order))) - 1
        on = np.sort(np.concatenate([order[~many[group]], order[start[many]]]))
        t, a, b = joined_windows(*(x[order[many[group]]] for x in (text, at, at)))
        text = np.concatenate([text[on], t])
        tag = hashes[1][text] | np.repeat([0, 1], [len(on), len(t)])
        cols = [
            np.concatenate([w0[on], _signed(_mix(t, 5) ^ _mix(a, 6))]), np.concatenate([w1[on], b]), hashes[0][text], tag,
            np.concatenate([at[on], a]).astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["w0", "w1", "cid", "tag", "lo"])

    return texts.select("text", "cid", "cid2", "places").mapInArrow(run, "w0 long, w1 long, cid long, tag long, lo int")


def compared_windows(rows: DataFrame) -> DataFrame:
    """Of :func:`window_digests` the ranges of windows that are shared: ``(cid, cid2, lo, last)``."""
    w = Window.partitionBy("w0", "w1")
    settled = kind_of(F.col("tag")) == 1
    of = F.when(~settled, F.col("cid"))
    marked = rows.withColumn("_many", F.min(of).over(w) != F.max(of).over(w)).filter(settled | F.col("_many"))
    return marked.select("cid", name_of(F.col("tag")).alias("cid2"), "lo", F.when(settled, F.col("w1")).otherwise(F.col("lo")).cast("int").alias("last"))


def shared_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """``(id_col, span_start, span_end)``: each maximal run of characters of a row in which every
    character lies in a stretch of at least ``length`` characters that stands verbatim in the text
    of another row.

    Characters are Unicode code points from 0, the end is exclusive, nothing is normalised.
    Rows with equal texts of ``length`` or more are shared as a whole; a stretch that repeats
    only within one row is not shared. Null, empty and shorter texts give no rows, nor does an
    empty table; rows count one by one, even under a repeated or null id. Other columns are not
    read. ``length`` must be 100 or more.
    """
    reach = (length - GRAM + 1) // 2
    if reach < GRAM:
        raise ValueError("length must be at least 100")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.filter(F.char_length("text") >= length).withColumns({"cid": F.xxhash64("text"), "cid2": name_of(F.xxhash64(F.lit(1), "text"))})
    text = ["cid", "cid2"]

    known = durable(compared_chunks(chunk_texts(spread(src), length, reach)))
    whole = known.filter(F.col("kind") == _WHOLE).select(*text, "lo", "last")
    edges = durable(known.filter(F.col("kind") == _EDGE).groupBy(*text).agg(F.collect_list(F.struct("lo", "last")).alias("places")))
    n_texts, n_places = edges.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    few = F.broadcast(edges) if n_texts <= BROADCAST_TEXTS and n_places <= BROADCAST_PLACES else edges
    partly = compared_windows(window_digests(spread(src).select(*text, "text").join(few, text), length))

    w = Window.partitionBy(*text).orderBy("s", "e")
    runs = (
        whole.unionByName(partly)
        .select(*text, F.col("lo").alias("s"), (F.col("last") + length).alias("e"))
        .withColumn("upto", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("run", F.sum(F.when(F.col("s") <= F.col("upto"), 0).otherwise(1)).over(w))
        .groupBy(*text, "run")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select(*text, "s", "e")
    )
    rows = known.filter(F.col("kind") == _DOC).select("id", *text, "n")
    copies = rows.groupBy(*text).agg(F.count("*").alias("k"), F.max("n").alias("n")).filter("k > 1")
    hot = F.broadcast(copies.orderBy(F.col("k").desc()).limit(HOT_TEXTS).select(*text))
    alone = runs.join(copies, text, "left_anti").unionByName(copies.select(*text, F.lit(0).alias("s"), F.col("n").alias("e")))
    found = rows.join(hot, text, "left_anti").join(alone, text).select("id", "s", "e")
    found = found.unionByName(rows.join(hot, text, "left_semi").select("id", F.lit(0).alias("s"), F.col("n").alias("e")))
    return found.select(F.col("id").alias(id_col), F.col("s").cast("long").alias("span_start"), F.col("e").cast("long").alias("span_end"))


def shared_share(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_chars, shared_chars)`` of every row of ``docs`` with a unique id: how much of it
    is shared, 0 where nothing is or the text is null (``n_chars`` 0)."""
    per = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    size = docs.select(id_col, F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    return size.join(per, id_col, "left").select(id_col, "n_chars", F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"))
