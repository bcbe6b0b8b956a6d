import random

import pytest

pytest.importorskip("palimpsest.llm")

from palimpsest.llm import leaks

ITEMS = "item_id long, suite string, fold string, text string, d string"
DOCS = "doc_id long, text string, item_id string"


def brute(docs, items, n=12):
    low = lambda t: [w.lower() for w in leaks.words_of(t)]
    windows = {}
    for i, t in items:
        ws = low(t)
        for k in range(len(ws) - n + 1):
            windows.setdefault(tuple(ws[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        ws = low(t)
        for k in range(len(ws) - n + 1):
            out |= {(d, i) for i in windows.get(tuple(ws[k : k + n]), ())}
    return sorted(out)


def test_words():
    assert leaks.words_of(r"A \textbf{bold}~\citep[see][p.~3]{x,y} word\ref{q}, ﬁn_x² \label{a b}\citealp{k} \% 12.5") == ["A", "bold", "word", "fin", "x2", "k", "12", "5"]
    assert leaks.words_of(r"a\times5 \cite") == ["a", "5"]
    assert leaks.words_of(None) == leaks.words_of("") == leaks.words_of(" \n") == []
    assert leaks.words_of("%hidden text") == ["hidden", "text"]


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "12", "7", "km", "Delta", "ÉTÉ", "straße", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 11, 12, 13, 30]))) for i in range(30)] + [(40, None), (41, ""), (42, "  ")]
    items.append((43, items[4][1]))
    docs = []
    for d in range(40):
        parts = [text(rng.randrange(30))]
        if d % 2:
            ws = rng.choice(items[:30])[1].split()
            a = rng.randrange(len(ws))
            parts.append(rng.choice([str, str.upper, str.title])(r" \emph{".join(ws[a : a + 14])))
        parts.append("unknown words here")
        docs.append((d, "\n".join(parts)))
    return docs + [(100, None), (101, ""), (102, items[4][1] if len(items[4][1].split()) >= 12 else " ".join(items[4][1].split() * 9))], items


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_brute_force(spark, seed, monkeypatch):
    docs, items = texts(seed)
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", 200_000 if seed else 40)
    monkeypatch.setattr(leaks, "SLICE_CHARS", 200)
    d = spark.createDataFrame([(*r, "clash") for r in docs], DOCS)
    i = spark.createDataFrame([(n, "s", None, t, "clash") for n, t in items], ITEMS)
    got = sorted(tuple(r) for r in leaks.leaked_items(d, i).collect())
    assert got == brute(docs, items) and got
    report = {r["item_id"]: r["documents"] for r in leaks.leak_report(leaks.leaked_items(d, i), i).collect()}
    assert sum(report.values()) == len(got) and report[40] == 0


def test_windows_do_not_run_from_one_document_into_the_next(spark):
    ws = "one two three four five six seven eight nine ten eleven twelve".split()
    d = spark.createDataFrame([(1, " ".join(ws[:6]), ""), (2, " ".join(ws[6:]), ""), (3, " ".join(ws), "")], DOCS).coalesce(1)
    i = spark.createDataFrame([(1, "s", "f", " ".join(ws), "")], ITEMS)
    assert [tuple(r) for r in leaks.leaked_items(d, i).collect()] == [(3, 1)]


def test_slots_must_be_filled_consistently(spark):
    item = "{} then more of the same plain wording and again {} comes {}"
    items = [(n, "s", "f", item.format(*x), "") for n, x in enumerate([("5", "5", "6"), ("1", "1", "2"), ("3", "3", "4")])]
    fill = [("8", "8", "6"), ("8", "6", "6"), ("70", "70", "71"), ("70", "71", "71"), ("70", "70", "70"), ("70", "70", "word")]
    d = spark.createDataFrame([(n, item.format(*x), "") for n, x in enumerate(fill, 1)], DOCS)
    i = spark.createDataFrame([*items, (9, "s", "f", "8 6", "")], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.reparameterised_members(d, i).collect()}
    # 5 and 6 are consistent in the window without the last slot; every item of the wording is named
    assert got == {(n, k) for n in (1, 3, 5, 6) for k in (0, 1, 2)}


def test_a_very_long_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    long = "filler text " * 200_000
    d = spark.createDataFrame([(1, long + item[:-9] + " " + long, ""), (2, long, "")], DOCS)
    i = spark.createDataFrame([(1, "s", "f", item, "")], ITEMS)
    assert [tuple(r) for r in leaks.leaked_items(d, i).collect()] == [(1, 1)]


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c", "")], DOCS), spark.createDataFrame([(1, "s", "f", "a", "")], ITEMS)
    assert leaks.leaked_items(d.limit(0), i).count() == leaks.leaked_items(d, i.limit(0)).count() == leaks.reparameterised_members(d, i).count() == 0


def test_whole_tables(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_items"))
    got = sorted(tuple(r) for r in leaks.leaked_items(docs, items).collect())
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


@pytest.mark.parametrize("block", [200_000, 20])
def test_every_item_of_a_wording_is_reported(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", block)
    item = "A train carrying {} leaves {} minutes late; decide which {} arrives at noon and which {} waits"
    items = [(n, "s", "f", item.format(*x), "") for n, x in enumerate([("salt", 5, "tea", "salt"), ("corn", 9, "rye", "corn"), ("iron", 7, "tin", "iron")])]
    docs = [
        (1, "Intro. " + item.format("silk", 77, "wool", "silk"), ""),
        (2, item.format("silk", 77, "wool", "wool"), ""),
        (3, item.format("salt", 5, "tea", "salt"), ""),
        (4, "A train carrying nothing of the kind at all", ""),
        (5, None, ""),
    ]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*items, (1, "s", "f", items[1][3], "")], ITEMS)
    rows = {(r["doc_id"], r["item_id"]): r["windows"] for r in leaks.reparameterised_members(d, i).collect()}
    # the windows of document 2 without the last slot are filled consistently
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 1), (3, 2)}
    assert rows[1, 0] == rows[1, 1] == rows[1, 2] == rows[3, 1] == 7 and rows[2, 0] == 5
    members = leaks.wordings(i).collect()
    assert len(members) == 21 and {r["item_id"] for r in members} == {0, 1, 2}
    assert leaks.reparameterised_members(d.limit(0), i).count() == leaks.reparameterised_members(d, i.limit(0)).count() == 0


def test_types_follow_from_counts_over_all_items(spark):
    rows = [(n, "s", "f", f"the {k} of Orla took {n + 2} minutes and then {n} minutes more", "") for n, k in enumerate(["salt", "corn", "iron"])]
    v = leaks.vocabulary(spark.createDataFrame(rows, ITEMS).repartition(3))
    assert v.unit == {"minutes"} and v.literal == {"the", "of", "took", "and", "then", "more"}
    assert [v.kind(w) for w in ("12", "5th", "minutes", "took", "salt", "orla")] == [leaks._NUMBER, leaks._NUMBER, leaks._UNIT, leaks._LITERAL, leaks._NAME, leaks._NAME]


def test_the_template_of_a_window_depends_on_its_own_words_only(spark):
    """A verbatim window is found though another word stands before it, and not where templates do not join."""
    ws = "gallons one two three four five six seven eight nine ten eleven".split()
    i = spark.createDataFrame([(1, "s", "f", "7 " + " ".join(ws), "")], ITEMS)
    d = spark.createDataFrame([(1, "of " + " ".join(ws), ""), (2, "7 " + " ".join(ws), ""), (3, " ".join(ws), ""), (4, " ".join(ws[:-1]) + " 12", "")], DOCS)
    assert sorted(r["doc_id"] for r in leaks.leaked_items(d, i).collect()) == [1, 2, 3]


def test_without_the_template_join_nothing_is_found(spark, monkeypatch):
    docs, items = texts(1)
    d = spark.createDataFrame([(*r, "clash") for r in docs], DOCS)
    i = spark.createDataFrame([(n, "s", None, t, "clash") for n, t in items], ITEMS)
    blocks = list(leaks._blocks(i, "item_id", "text", v := leaks.vocabulary(i)))
    memo = leaks.Memo(v, blocks[0].known)
    found = 0
    for _, t in docs:
        codes = leaks.np.array([*map(memo.__getitem__, leaks.words_of(t)), 0], dtype=leaks.np.int64)
        doc = leaks.np.zeros(len(codes), leaks.np.int64)
        found += len(leaks._verbatim(blocks[0], codes, doc)[0])
        with monkeypatch.context() as m:
            m.setattr(leaks.ItemIndex, "joined", lambda self, codes, places: (places[:0], places[:0]))
            assert not len(leaks._verbatim(blocks[0], codes, doc)[0])
    assert found


def reparameterised(text, rng, literal):
    """A text with every number and every word that is not ``literal`` replaced, equal ones by equal ones."""
    new = {}
    for w in leaks.words_of(text):
        low = w.lower()
        if low not in new:
            new[low] = str(rng.randrange(1000, 10**6)) if leaks.is_number(low) else low if low in literal else "zz" + "".join(rng.choice("abcdefgh") for _ in range(9))
    return " ".join(new[w.lower()] for w in leaks.words_of(text))


@pytest.mark.parametrize("block", [200_000, 300])
def test_planted_reparameterisations_are_found(spark, data, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", block)
    rng = random.Random(7)
    items = spark.read.parquet(f"{data}/eval_items.parquet")
    v = leaks.vocabulary(items)
    rows = [(r["item_id"], r["text"]) for r in items.collect() if len(leaks.words_of(r["text"])) >= 12]
    docs = [(i, "Some text before it. " + reparameterised(t, rng, v.literal | v.unit) + " And more.", "") for i, t in rows]
    plain = [(10**6 + i, " ".join("yy" + "".join(rng.choice("abc") for _ in range(7)) for _ in range(60)), "") for i in range(50)]
    found = {(r["doc_id"], r["item_id"]) for r in leaks.reparameterised_members(spark.createDataFrame(docs + plain, DOCS), items).collect()}
    recall = sum((i, i) in found for i, _ in rows) / len(rows)
    assert recall >= 0.9 and not any(d >= 10**6 for d, _ in found)
    assert not leaks.leaked_items(spark.createDataFrame(plain, DOCS), items).count()
