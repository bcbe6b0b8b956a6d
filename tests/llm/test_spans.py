import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("palimpsest.llm")

from palimpsest.llm import spans


def brute(docs, length):
    """Runs of positions in windows that another row's text holds, row by row."""
    out = []
    texts = [(i, t) for i, t in docs if t is not None]
    grams = {}
    for n, (_, t) in enumerate(texts):
        for k in range(len(t) - length + 1):
            grams.setdefault(t[k : k + length], set()).add(n)
    for n, (i, t) in enumerate(texts):
        run = None
        for k in range(len(t) - length + 1):
            if len(grams[t[k : k + length]]) > 1:
                if run and k <= run[1]:
                    run[1] = k + length
                else:
                    run and out.append((i, *run))
                    run = [k, k + length]
        run and out.append((i, *run))
    return sorted(out)


def found(df, **kw):
    return sorted(tuple(r) for r in spans.shared_spans(df, **kw).collect())


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh é漢") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    bases = [text(150) for _ in range(6)] + ["x" * 400, "ab" * 300]
    docs = []
    for i in range(40):
        t = text(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            b = rng.choice(bases)
            a = rng.randrange(len(b))
            t += b[a : a + rng.choice([length - 1, length, length + 1, 2 * length, 5 * length])] + text(rng.randrange(30))
        docs.append((i, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "short"), (105, "y" * length), (106, "y" * (length - 1))]
    # one text repeats a stretch of its own
    docs.append((107, bases[0][:200] * 2 + "q"))
    own = text(100)[: length * 2]
    docs.append((108, own + "#" + own))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_brute_force(spark, seed):
    docs = corpus(seed, 100)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, cid string, s int").repartition(3)
    assert found(df, length=100) == brute(docs, 100)


@pytest.mark.parametrize("limits", [{"SLICE_ROWS": 3}, {"SLICE_ROWS": 60, "HOT_TEXTS": 1}, {"SLICE_ROWS": 10**9, "HOT_TEXTS": 10**6}])
def test_limits_change_nothing(spark, monkeypatch, limits):
    docs = corpus(5, 100)
    docs += [(200 + i, docs[4][1]) for i in range(30)] + [(300 + i, "lead %d " % i + docs[5][1]) for i in range(30)]
    for name, n in limits.items():
        monkeypatch.setattr(spans, name, n)
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), length=100) == brute(docs, 100)


def test_documents_are_read_twice_and_chunks_made_once(spark, tmp_path):
    """Half of all rows hold one passage: what goes on of its chunks is one row for a slice, not for a document."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    docs = [(i, (base if i % 2 else "") + "".join(rng.choice("qrstuvwxyz ") for _ in range(500))) for i in range(200)]
    src = spark.createDataFrame(docs, "id long, text string").withColumns({"cid": F.xxhash64("text"), "cid2": spans.name_of(F.xxhash64(F.lit(1), "text"))}).coalesce(2)
    rows = spans.chunk_texts(src, 300, 134)
    most = rows.filter(spans.kind_of(F.col("tag")).isin(spans._CHUNK, spans._MIXED)).groupBy("key").count().agg(F.max("count")).first()[0]
    assert most <= 2
    assert found(src.select(F.col("id").alias("doc_id"), "text")) == brute(docs, 300)


def test_edges_are_resolved_without_the_broadcast_too(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_TEXTS", 0)
    docs = corpus(7, 100)
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), length=100) == brute(docs, 100)


def test_every_insertion_leaves_the_rest_shared(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    docs = [(0, base), (1, base[:700] + "INSERTED" + base[700:]), (2, "z" * 50 + base[400:900] + "z" * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df) == brute(docs, 300)


def test_copies_repeated_ids_and_empty_tables(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(400))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t[:299])], "doc_id long, text string")
    assert sorted((r[0] or 0, r[1], r[2]) for r in spans.shared_spans(df).collect()) == [(0, 0, 400), (1, 0, 400), (1, 0, 400)]
    assert spans.shared_spans(df.limit(0)).count() == 0
    assert spans.shared_spans(df.filter("text is null")).count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, length=50)


def test_long_texts_and_shares(spark):
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    docs = [(1, a), (2, "w" * 10 + a[100_000:200_000]), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df) == [(1, 100_000, 200_000), (2, 10, 100_010)]
    share = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_share(spans.shared_spans(df), df).collect()}
    assert share == {1: (300_000, 100_000), 2: (100_010, 100_000), 3: (0, 0)}


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(3)
    a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2 * spans.PIECE + 12_345))
    at = spans.PIECE
    docs = [(1, a), (2, "w" * 500 + a[at - 2000 : at + 2000]), (3, a[at - 150 : at + 150] + "é" * 10), (4, a[2 * at - 100 : 2 * at + 199])]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == [(1, at - 2000, at + 2000), (2, 500, 4500), (3, 0, 300)]


def test_pieces_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 37)
    points = spans.code_points("".join(random.Random(4).choices("abc", k=700)))
    rows = [w for c in spans.chunks(points, 100, 34) for lo, last in zip(c[2], c[3]) for w in range(lo, last + 1)]
    assert rows == list(range(601))


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert found(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 300)
