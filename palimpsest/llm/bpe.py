"""Byte-level BPE encoding of a text column with a public vocabulary.

Words are cut out with the tokenizer's published pattern. Distinct words that a worker has
not met before go, a slice at a time, to an embedded DuckDB: their bytes become
token-position rows, a recursive query joins neighbouring rows with the merge table and
contracts each word's minimum-rank pair, leftmost first, until no pair is left, and an
ordered aggregation reads the ids back. Texts never leave their task, so there is no
shuffle; the cache of encoded words is bounded and only saves work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# The published word pattern of the byte-level tokenizers, and the same
# pattern for texts of ASCII characters only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+"
    r"|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
)

#: Characters of text per slice, and words kept in a worker's cache; both bound memory only.
SLICE_CHARS = 4_000_000
CACHE_WORDS = 400_000
#: A recursion keeps the rows of all its rounds: so many pieces at a time go through one,
#: and a piece of more bytes than LONG_PIECE goes through the rounds one by one.
PIECES_AT_ONCE = 4000
LONG_PIECE = 256

# One round of the recursion: `nx` is the right neighbour, `rank` that of the pair, `best`
# the word's lowest. Where a pair of equal tokens repeats (aaaa), every other hit of an
# unbroken row of hits counts, beginning with the leftmost. A word without a pair passes
# once more as done.
_ROUND = """
    WITH pairs AS (
        SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nx
        FROM state WHERE NOT done),
    ranked AS (
        SELECT p.word, p.pos, p.tok, m.rank, m.made
        FROM pairs p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nx),
    low AS (SELECT word, min(rank) AS best FROM ranked GROUP BY word),
    hits AS (
        SELECT r.word, r.pos, r.tok, r.made, l.best, coalesce(r.rank = l.best, false) AS hit,
               row_number() OVER w AS i
        FROM ranked r JOIN low l USING (word) WINDOW w AS (PARTITION BY r.word ORDER BY r.pos)),
    odd AS (
        SELECT *, hit AND (i - coalesce(max(CASE WHEN hit THEN NULL ELSE i END) OVER w, 0)) % 2 = 1 AS take
        FROM hits WINDOW w AS (PARTITION BY word ORDER BY pos)),
    gone AS (
        SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), false) AS eaten FROM odd)
    SELECT word, pos, CASE WHEN take THEN made ELSE tok END AS tok, best IS NULL AS done FROM gone WHERE NOT eaten
"""
_READ = "SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE done GROUP BY word"
_ENCODE = f"""
WITH RECURSIVE state(word, pos, tok, done) AS (
    SELECT word, pos, tok, false FROM start UNION ALL ({_ROUND})
) {_READ}
"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies, by the rule they follow.

    Bytes that print stand for themselves; the others take the code points from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of byte strings and the ranked merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        ids = model["vocab"]
        special = {s for s in ids if any(c not in alphabet for c in s)}
        self.byte_ids = np.array([ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)]
        # Byte pairs that stand side by side in no token: no merge ever crosses them.
        self.joined = np.zeros((256, 256), dtype=bool)
        for s in ids:
            if s not in special:
                b = raw(s)
                self.joined[list(b[:-1]), list(b[1:])] = True


class Encoder:
    """Encodes words through DuckDB; one per worker process."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        a, b, rank, made = (pa.array(x, pa.int32()) for x in zip(*v.merges))
        self._merges = pa.table({"a": a, "b": b, "rank": rank, "made": made})
        self.db.register("merge_rows", self._merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.unregister("merge_rows")
        self.known: dict[str, tuple[int, ...]] = {}

    def pieces(self, word: bytes) -> list[bytes]:
        """``word`` cut where no merge can cross; joined again, the pieces' ids are the word's."""
        if len(word) < 2:
            return [word]
        b = np.frombuffer(word, dtype=np.uint8)
        cuts = np.flatnonzero(~self.vocabulary.joined[b[:-1], b[1:]]) + 1
        if not len(cuts):
            return [word]
        at = [0, *cuts.tolist(), len(word)]
        return [word[i:j] for i, j in zip(at[:-1], at[1:])]

    def learn(self, words: list[str]) -> None:
        """Encode ``words``, none of them empty, into the cache."""
        cut = [self.pieces(w.encode("utf-8")) for w in words]
        ids: dict[bytes, list[int]] = {}
        short, long = [], []
        for p in dict.fromkeys(chain.from_iterable(cut)):
            (short if len(p) <= LONG_PIECE else long).append(p)
        for i in range(0, len(short), PIECES_AT_ONCE):
            some = short[i : i + PIECES_AT_ONCE]
            ids.update((some[k], x) for k, x in self._fixpoint(some, self._recursive))
        for p in long:
            ids.update((p, x) for _, x in self._fixpoint([p], self._by_rounds))
        for w, ps in zip(words, cut):
            self.known[w] = tuple(chain.from_iterable(map(ids.__getitem__, ps)))

    def _fixpoint(self, pieces: list[bytes], contract) -> list[tuple[int, list[int]]]:
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.db.register("start", pa.table({
            "word": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes),
            "pos": (np.arange(len(raw)) - first).astype(np.int32),
            "tok": self.vocabulary.byte_ids[raw],
        }))
        try:
            return contract()
        finally:
            self.db.unregister("start")

    def _recursive(self) -> list[tuple[int, list[int]]]:
        return self.db.execute(_ENCODE).fetchall()

    def _by_rounds(self) -> list[tuple[int, list[int]]]:
        """The same rounds, each replacing the last one's rows, which a recursive query would keep."""
        self.db.execute("CREATE OR REPLACE TABLE state AS SELECT *, false AS done FROM start")
        while self.db.execute("SELECT NOT bool_and(done) FROM state").fetchone()[0]:
            self.db.execute(f"CREATE OR REPLACE TABLE state AS {_ROUND}")
        found = self.db.execute(_READ).fetchall()
        self.db.execute("DROP TABLE state")
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts = [(i, p) for i, t in enumerate(texts) for p in text_parts(t)]
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (size < SLICE_CHARS or end == at):
                size += len(parts[end][1])
                end += 1
            split = [_split(p) for _, p in parts[at:end]]
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            fresh = list(set(chain.from_iterable(split)).difference(self.known))
            if fresh:
                self.learn(fresh)
            get = self.known.__getitem__
            for (i, _), words in zip(parts[at:end], split):
                ids[i].append(np.fromiter(chain.from_iterable(map(get, words)), dtype=np.int32))
            at = end
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.empty(0, np.int32)]) for x in ids]


def text_parts(text: str) -> list[str]:
    """``text`` in parts of about ``SLICE_CHARS`` characters that are encoded each by itself."""
    if len(text) <= SLICE_CHARS:
        return [text]
    out, at = [], 0
    while len(text) - at > SLICE_CHARS and (m := _cut.search(text, at + SLICE_CHARS)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


# No word holds white space after another character, so a text may be cut between the two.
_cut = regex.compile(r"(?<=\S)[ \t\r\n]")
_pattern = regex.compile(PATTERN)
_ascii_pattern = re.compile(ASCII_PATTERN)
_encoders: dict[str, Encoder] = {}


def _split(text: str) -> list[str]:
    return (_ascii_pattern if text.isascii() else _pattern).findall(text)


def encoder(path: str) -> Encoder:
    """This process's encoder for the vocabulary file at ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``(id_col, ids ARRAY<INT>)`` for every row of ``docs``.

    Null and empty texts give an empty list; a text that spells a special token is ordinary
    text. Repeated rows are encoded each; a null id stays null; other columns, whatever
    their names, are not read. An empty table gives an empty one. The vocabulary file must
    be readable on every executor.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                texts, chars = [], 0
                while lo + len(texts) < batch.num_rows and chars < SLICE_CHARS:
                    texts.append(batch.column(1)[lo + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                part = batch.slice(lo, len(texts))
                lo += len(texts)
                ids = enc.encode(texts)
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                values = np.concatenate([*ids, np.empty(0, np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "ids"]
                )

    kind = src.schema["id"].dataType.simpleString()
    return spread(src).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
