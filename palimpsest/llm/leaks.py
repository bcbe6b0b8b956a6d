"""Passages of evaluation items inside documents.

Template canonicalisation: in a word stream, numbers, units and names become typed
placeholders (*slots*) and only wording that items share stays literal. The types follow from
rules and from counts over all items:

* a number begins with a digit;
* a unit is a word that nearly always follows a number in the items, or any word that is not
  literal and follows a number within the window;
* a word is literal if at least ``LITERAL_ITEMS`` items use it, it is neither number nor unit,
  and some item writes it in lower case (a word that is always capitalised is a proper name);
* every other word is a name.

Windows of ``WORDS`` consecutive words of the documents are hash-joined with those of the
items by their templates. A pair that joins is then checked slot by slot:

* all slots equal an item's: its words stand verbatim in the document (:func:`leaked_items`);
* the slots are filled consistently (slots of the window that are equal in the item are equal
  in the document, and different ones differ): an item was re-parameterised
  (:func:`reparameterised_members`).

A template depends on the window's own words only, so equal windows have equal templates.
Items are the small, stated query set. Their windows are held in blocks of at most
``BLOCK_WINDOWS``, which bounds the memory of a task and nothing else: types are counted over
all items before, and the documents are read once for all blocks. Documents are never
shuffled. Item windows of one wording are one entry of the join, so what is looked at grows
with what is found and not with the number of items that share a wording.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import spread

WORDS = 12
#: Windows of items in one block, about 250 bytes each; it bounds memory only.
BLOCK_WINDOWS = 200_000
#: A word that fewer of all items use is a name.
LITERAL_ITEMS = 3
#: A word that follows a number in so many items, and in this share of its uses, is a unit.
UNIT_ITEMS = 3
UNIT_SHARE = 0.8
#: Literal words that a window needs to speak of re-parameterisation.
LITERALS = 5
#: Characters of text looked at together, and words remembered; they bound memory only.
SLICE_CHARS = 1_000_000
MEMO_WORDS = 400_000

# Commands that go with their arguments.
_REFERENCE = re.compile(r"\\(?:citep|citet|cite|eqref|ref|label)(?![A-Za-z])\*?(?:\[[^\]]*\]|\{[^{}]*\})*")
_COMMAND = re.compile(r"\\[A-Za-z]+")
_WORD = re.compile(r"[^\W_]+")

_U = np.uint64
# A word's code is a hash with its type in the two lowest bits; it is negative for a word that no item has.
_NAME, _NUMBER, _UNIT, _LITERAL = range(4)
_MULTIPLIER = _U(0x9E6C63D0876A9A47)
_TOP = _U(pow(0x9E6C63D0876A9A47, WORDS - 1, 2**64))


def plain(text: str | None) -> str:
    """A text without reference commands and command names, in compatibility form."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", _REFERENCE.sub(" ", text))
    return text


def words_of(text: str | None) -> list[str]:
    """The words of a text as the items and documents are compared by, in their own case."""
    return _WORD.findall(plain(text))


def _words_one_by_one(text: str | None) -> Iterator[str]:
    """:func:`words_of` for texts too long for a list of their words."""
    return (m.group() for m in _WORD.finditer(plain(text)))


def is_number(word: str) -> bool:
    return word[0].isdigit()


@dataclass(frozen=True)
class Vocabulary:
    """What counting over all items says of their words, in lower case."""

    literal: frozenset[str]
    unit: frozenset[str]

    def kind(self, low: str) -> int:
        return _NUMBER if is_number(low) else _UNIT if low in self.unit else _LITERAL if low in self.literal else _NAME


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")


def vocabulary(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Vocabulary:
    """The literal words and the units of all items. Only words that enough items use come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen: dict[str, list[int]] = {}
                after = False
                for w in words_of(text):
                    x = seen.setdefault(w.lower(), [0, 0, 0])
                    x[0] += 1
                    x[1] += after
                    x[2] |= w[0].islower() or not w[0].isupper()
                    after = is_number(w)
                cols = list(zip(*seen.values())) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["w", "n", "after", "low"])

    counts = _items(items, item_col, text_col).select("t").mapInArrow(run, "w string, n long, after long, low long").groupBy("w")
    total = counts.agg(
        F.count("*").alias("items"), F.sum("n").alias("n"), F.sum("after").alias("after"), F.max("low").alias("low"), F.count_if(F.col("after") > 0).alias("measured")
    )
    used = [tuple(r) for r in total.filter(F.col("items") >= min(LITERAL_ITEMS, UNIT_ITEMS)).collect()]
    unit = frozenset(w for w, _, n, after, _, measured in used if measured >= UNIT_ITEMS and after >= UNIT_SHARE * n and not is_number(w))
    return Vocabulary(frozenset(w for w, k, _, _, low, _ in used if k >= LITERAL_ITEMS and low and w not in unit and not is_number(w)), unit)


def code_of(low: str, vocabulary: Vocabulary) -> int:
    """The code of a word in lower case, as items have it: 61 bits of its hash, and its type."""
    h = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) >> 3
    return (max(h, 1) << 2) | vocabulary.kind(low)


class Memo(dict):
    """Codes of words as they are spelt; negative for words that are not ``known``."""

    def __init__(self, vocabulary: Vocabulary, known: frozenset[int]):
        super().__init__()
        self.vocabulary, self.known = vocabulary, known

    def __missing__(self, word: str) -> int:
        x = code_of(word.lower(), self.vocabulary)
        x = x if x in self.known else -x
        if len(self) < MEMO_WORDS:
            self[word] = x
        return x


def _windows(x: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, WORDS) if len(x) >= WORDS else np.empty((0, WORDS), x.dtype)


def _mix(x: np.ndarray) -> np.ndarray:
    v = x.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)
    v ^= v >> _U(32)
    v *= _U(0xD6E8FEB86659FD93)
    return v ^ (v >> _U(29))


def _sum(v: np.ndarray) -> np.ndarray:
    """Of every window of mixed values one polynomial sum."""
    h = np.zeros(max(len(v) - WORDS + 1, 0), dtype=_U)
    for k in range(WORDS):
        h = h * _MULTIPLIER + v[k : k + len(h)]
    return h


def word_digests(codes: np.ndarray) -> np.ndarray:
    return _mix(_sum(_mix(np.abs(codes))).view(np.int64))


def template_digests(codes: np.ndarray) -> np.ndarray:
    """A digest of every window's template.

    Whether a word follows a number is only seen within the window, so its first word has no such word.
    """
    codes = np.abs(codes)
    kind = codes & 3
    free = np.where(kind == _LITERAL, codes, kind)
    after = np.zeros(len(codes), bool)
    after[1:] = kind[:-1] == _NUMBER
    placed = _mix(np.where((kind == _NAME) & after, _UNIT, free))
    first = (_mix(free) - placed)[: max(len(codes) - WORDS + 1, 0)]
    return _mix((_sum(placed) + first * _TOP).view(np.int64))


def _pattern(slots: np.ndarray) -> np.ndarray:
    """Which slots of each window hold equal values: for every place the first place of its value, 4 bits each."""
    if not len(slots):
        return np.empty(0, np.int64)
    first = (slots[:, :, None] == slots[:, None, :]).argmax(axis=2)
    return (first << 4 * np.arange(WORDS)).sum(axis=1)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array the distinct values, and which of them each element is."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], np.cumsum(new) - 1


def _at(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each ``x`` in the sorted ``table``, or -1."""
    if not len(table):
        return np.full(len(x), -1, np.int64)
    i = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[i] == x, i, -1)


class ItemIndex:
    """The windows of a block of items: by template, and within a template by the words in its slots."""

    def __init__(self, items: list[tuple[int, list[str]]], vocabulary: Vocabulary, number: int = 0):
        self.number = number
        rows = [(i, np.array([code_of(w, vocabulary) for w in ws], dtype=np.int64)) for i, ws in items if len(ws) >= WORDS]
        words = np.concatenate([np.empty((0, WORDS), np.int64), *(_windows(r) for _, r in rows)])
        item = np.concatenate([np.empty(0, np.int64), *(np.full(len(r) - WORDS + 1, i) for i, r in rows)])
        template = np.concatenate([np.empty(0, _U), *(template_digests(r) for _, r in rows)])
        spelt = np.concatenate([np.empty(0, _U), *(word_digests(r) for _, r in rows)])
        self.known = frozenset(np.unique(words).tolist())
        order = np.lexsort((spelt, template))
        words, item, template, spelt = words[order], item[order], template[order], spelt[order]
        self.templates, of = _runs(template)
        # within a template, the distinct fillings of its slots; the items of each
        filled = self._filling(of, spelt)
        order = np.lexsort((item, filled))
        self.filled, group = _runs(filled[order])
        self.item = item[order]
        self.ends = np.searchsorted(group, np.arange(len(self.filled) + 1))
        first = self.ends[:-1]
        self.words, self.spelt = words[order][first], spelt[order][first].view(np.int64)
        # the wordings of a template: patterns of equal slots, if enough of its words are literal
        pattern = _pattern(words)
        worded = ((words & 3) == _LITERAL).sum(axis=1) >= LITERALS
        rows = np.unique(np.stack([of[worded], pattern[worded], item[worded]]), axis=1)
        self.members = pa.table([self.templates[rows[0]].view(np.int64), rows[1], rows[2]], names=["template", "pattern", "i"])
        self.wordings = np.unique(self._filling(rows[0], rows[1].view(_U)))

    @staticmethod
    def _filling(template: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return _mix((_mix(template) ^ slots).view(np.int64))

    def joined(self, codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The template join: the ``places`` whose window's template is one of the items', and which."""
        of = _at(self.templates, template_digests(codes)[places])
        return places[of >= 0], of[of >= 0]

    def equal(self, codes: np.ndarray, places: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot check for equality of joined places: ``(place, filling)`` of an item's very words."""
        filling = _at(self.filled, self._filling(template, word_digests(codes)[places]))
        place, filling = places[filling >= 0], filling[filling >= 0]
        same = (_windows(codes)[place] == self.words[filling]).all(axis=1)
        return place[same], filling[same]

    def consistent(self, codes: np.ndarray, places: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slot check for consistency of joined places: ``(place, template, pattern)`` of an item's wording."""
        pattern = _pattern(np.abs(_windows(codes)[places]))
        ok = _at(self.wordings, self._filling(template, pattern.view(_U))) >= 0
        return places[ok], template[ok], pattern[ok]

    def items_of(self, filling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index into filling, item)`` of every item that has the words."""
        n = self.ends[filling + 1] - self.ends[filling]
        at = np.repeat(self.ends[filling] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(filling)), n), self.item[at]


def _blocks(items: DataFrame, id_col: str, text_col: str, words: Vocabulary) -> Iterator[ItemIndex]:
    block: list[tuple[int, list[str]]] = []
    size = number = 0
    for i, t in _items(items, id_col, text_col).toLocalIterator():
        ws = [w.lower() for w in words_of(t)]
        if block and size + len(ws) > BLOCK_WINDOWS:
            yield ItemIndex(block, words, number)
            block, size, number = [], 0, number + 1
        block.append((i, ws))
        size += len(ws)
    yield ItemIndex(block, words, number)


def _scan(docs: DataFrame, blocks: list[ItemIndex], words: Vocabulary, look, names: list[str], schema: str) -> DataFrame:
    """Documents ``(d, t)`` in slices, once for all blocks: ``look(index, codes, doc)`` gets the word codes of
    several documents, with zeros between them, and the document of each word, and returns columns,
    the first of them numbers of documents."""
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]
    known = docs.sparkSession.sparkContext.broadcast(frozenset().union(*(b.known for b in blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(words, known.value)
        gap = np.zeros(WORDS, dtype=np.int64)
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                parts, sizes, chars, hi = [], [], 0, lo
                while hi < batch.num_rows and chars < SLICE_CHARS:
                    text = batch.column(1)[hi].as_py()
                    found = words_of(text) if len(text) <= SLICE_CHARS else _words_one_by_one(text)
                    parts += [np.fromiter(map(memo.__getitem__, found), dtype=np.int64), gap]
                    sizes.append(len(parts[-2]) + WORDS)
                    chars += len(text)
                    hi += 1
                codes, doc = np.concatenate(parts), np.repeat(np.arange(lo, hi), sizes)
                for b in shared:
                    cols = look(b.value, codes, doc)
                    if len(shared) > 1:
                        b.__dict__.pop("_value", None)  # one block at a time is held; it is read from local disk again
                    if len(cols[0]):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *map(pa.array, cols[1:])], names=names)
                lo = hi

    return docs.mapInArrow(run, schema)


def _within(codes: np.ndarray) -> np.ndarray:
    """Whether each window lies in one document."""
    return ~_windows(codes == 0).any(axis=1)


def _verbatim(index: ItemIndex, codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    # a window with a word that no item has equals no item's
    places, template = index.joined(codes, np.flatnonzero(_windows(codes > 0).all(axis=1)))
    place, filling = index.equal(codes, places, template)
    held = np.unique(np.stack([doc[place], filling]), axis=1)
    of, item = index.items_of(held[1])
    pairs = np.unique(np.stack([held[0][of], item]), axis=1)
    return [pairs[0], pairs[1]]


def _by_wording(index: ItemIndex, codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Per document and wording its windows; and, with the item, those of them that are an item's very words."""
    literal = (_windows((np.abs(codes) & 3) == _LITERAL)).sum(axis=1) >= LITERALS
    places, template = index.joined(codes, np.flatnonzero(_within(codes) & literal))
    own, filling = index.equal(codes, places, template)
    place, template, pattern = index.consistent(codes, places, template)
    found, n = np.unique(np.stack([doc[place], index.templates[template].view(np.int64), pattern]), axis=1, return_counts=True)
    of, item = index.items_of(filling)
    held, m = np.unique(np.stack([doc[own][of], index.spelt[filling][of], item]), axis=1, return_counts=True)
    return [
        np.concatenate([found[0], held[0]]),
        np.concatenate([found[1], held[1]]),
        pa.concat_arrays([pa.array(found[2]), pa.nulls(len(m), pa.int64())]),
        pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(held[2])]),
        np.concatenate([n, m]).astype(np.int64),
        np.full(len(n) + len(m), index.number),
    ]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL AND t <> ''"))


def leaked_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, item_col)``: each pair where at least ``WORDS`` consecutive words of the item stand
    one after another in the document.

    Texts are compared by the words of :func:`words_of` in lower case: their templates are joined, and
    all slots must be equal. Null and empty texts, and items of fewer words, give no pair; rows of one
    id count together; items without an id are left out. Whole texts are read, of any length. Empty
    tables give an empty one. Other columns are not read.
    """
    words = vocabulary(items, item_col, text_col)
    blocks = list(_blocks(items, item_col, text_col, words))
    found = _scan(_documents(docs, id_col, text_col), blocks, words, _verbatim, ["d", "i"], "d long, i long")
    return found.distinct().select(F.col("d").alias(id_col), F.col("i").alias(item_col))


def _members(docs: DataFrame, blocks: list[ItemIndex]) -> DataFrame:
    spark = docs.sparkSession
    return reduce(DataFrame.unionByName, [spark.createDataFrame(b.members, "template long, pattern long, i long") for b in blocks]).distinct()


def wordings(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(template, pattern, item_col)``: the items of every wording of ``WORDS`` words, ``LITERALS`` of them
    literal. A wording is a template, by its digest, and the pattern of equal slots. Null and empty
    texts have none."""
    blocks = list(_blocks(items, item_col, text_col, vocabulary(items, item_col, text_col)))
    return _members(items, blocks).withColumnRenamed("i", item_col)


def reparameterised_members(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, item_col, windows)``: documents that hold an item's wording with other numbers, units
    or names put consistently in its slots, every such item, and in how many windows of the document.

    A window must have ``LITERALS`` literal words. Items that share a wording are all reported, for each
    of them is the others' re-parameterisation; only where an item's very words stand, it is not. What
    documents hold is joined with :func:`wordings`, so scanning them takes no longer where many items
    share a wording. Nulls, empty texts, rows of one id and empty tables are as in :func:`leaked_items`.
    """
    words = vocabulary(items, item_col, text_col)
    blocks = list(_blocks(items, item_col, text_col, words))
    names, keys = ["d", "w", "p", "i", "n", "b"], ["d", "w", "p", "i"]
    found = _scan(_documents(docs, id_col, text_col), blocks, words, _by_wording, names, "d long, w long, p long, i long, n long, b long")
    # blocks that share a wording find the same windows
    found = found.groupBy(*keys, "b").agg(F.sum("n").alias("n")).groupBy(keys).agg(F.max("n").alias("n"))
    members = _members(docs, blocks).toDF("w", "p", "m")
    # windows of an item's very words have no pattern and are taken off; both in one, so that documents are read once
    per_item = found.join(members, ["w", "p"], "left").select("d", F.coalesce("m", "i").alias("i"), F.when(F.col("p").isNull(), -F.col("n")).otherwise(F.col("n")).alias("n"))
    total = per_item.groupBy("d", "i").agg(F.sum("n").alias("windows")).filter("windows > 0")
    return total.select(F.col("d").alias(id_col), F.col("i").alias(item_col), "windows")


def leak_report(pairs: DataFrame, items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """``(item_col, suite, fold, documents)``: in how many documents each item leaked, 0 included."""
    n = pairs.groupBy(item_col).agg(F.count("*").alias("documents"))
    return items.select(item_col, "suite", "fold").join(n, item_col, "left").withColumn("documents", F.coalesce("documents", F.lit(0)).cast("long"))
