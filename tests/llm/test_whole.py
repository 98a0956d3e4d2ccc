"""Inputs that earlier forms of the operators left out."""

import random
from itertools import combinations

import numpy as np

from renown.llm import decontaminate, jaccard_join, mixing, secrets
from tests.llm import brute

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def every_diagonal(docs, items, window=20, percent=80):
    """{(doc_id, item_id): matched} by the rule alone, without seeds."""
    out = {}
    for d, t in docs:
        w = brute.plain_words(t)
        for i, item in items:
            v = brute.plain_words(item)
            size = min(window, len(v))
            for g in range(-len(v) + 1, len(w)):
                same = [w[q + g] == x for q, x in enumerate(v) if 0 <= q + g < len(w)]
                best = max((sum(same[s:s + size]) for s in range(len(same) - size + 1)), default=0)
                if best and best * 100 >= size * percent:
                    out[d, i] = max(best, out.get((d, i), 0))
    return out


def changed(words, places):
    return " ".join("other" if j in places else w for j, w in enumerate(words))


def test_masks_meet_every_overlap():
    masks = decontaminate.whole_masks(decontaminate.MASKS, 20, 80)
    for n in range(9, 21):
        laid = [{p + j for j, x in enumerate(m) if x == "1"} for m in masks for p in range(n - len(m) + 1)]
        assert all(any(w.isdisjoint(gone) for w in laid) for gone in combinations(range(n), n // 5))
    for n in range(1, 21):
        for percent in (60, 80, 95):
            allowed = n * (100 - percent) // 100
            shortest = min(max(map(len, "".join("0" if j in gone else "1" for j in range(n)).split("0"))) for gone in combinations(range(n), min(allowed, 4)))
            assert decontaminate.shared_run(n, percent) <= shortest


def test_decontaminate_meets_every_diagonal(spark):
    rng = random.Random(3)
    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in [*range(1, 21), 45]]
    docs = []
    for n, item in items:
        v = item.split()
        patterns = [p for s in range(min(n, 20) // 5 + 2) for p in combinations(range(min(n, 20)), s)]
        for places in rng.sample(patterns, min(len(patterns), 25)) + [range(3, n, 4)]:
            docs.append((len(docs), "before this " * rng.randrange(3) + changed(v, places) + " and after" * rng.randrange(3)))
    v = items[15][1].split()
    docs += [(len(docs), changed(v, (3, 7, 11))), (len(docs) + 1, changed(items[19][1].split(), (3, 7, 11, 15)))]
    docs.append((len(docs), "filler " * (decontaminate.CHUNK - 8) + items[17][1]))
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.leaks(df, bench).collect()}
    want = every_diagonal(docs, items)
    assert got == want and len({i for _, i in want}) == len(items)
    other = {(r.doc_id, r.item_id): r.matched for r in decontaminate.leaks(df, bench, window=12, percent=70).collect()}
    assert other == every_diagonal(docs, items, 12, 70)


def test_prose_after_a_credential_word_is_no_secret(spark):
    prose = ["Payment is required. The report was generated and then unavailable, as expected.", "It was required, generated, unavailable; expected."] * 2
    clean = ["Your password is required.", "The token is generated on login.", "The login is unavailable, try again.", "A secret is expected."]
    keys = ["The password is Xk9#mQ2$vLp8 now", "passphrase: kjhqzvxwpltr"] * 4
    rows = list(enumerate(prose + clean + keys))
    assert any(secrets.find_spans(t) for t in clean)
    spans = {r.doc_id: len(r.spans) for r in secrets.secret_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert spans == {i: int(t in keys) for i, t in rows}
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert all((got[i] == t) == (t not in keys) for i, t in rows)
    known = secrets.word_ranks(spark.createDataFrame(rows, DOCS)).collect()
    assert len(known) == len(clean) and {w: n for r in known for w, n in r.ranks.items() if len(w) > 7} == {
        "required": 4, "generated": 4, "unavailable": 4, "expected": 8}  # 16 rows, beside a word in 4, 4, 4 and 2
    assert secrets.word_ranks(spark.createDataFrame([(1, None)], DOCS)).count() == 0


def test_spans_do_not_depend_on_the_size_of_the_table(spark):
    """The same row in one row, among bare copies of its value, and in tables
    loaded once or many times; every word is counted, however many there are."""
    def spans(texts):
        df = spark.createDataFrame(list(enumerate(texts)), DOCS)
        return {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in secrets.secret_spans(df).collect()}

    row = "password is zebrafishing"
    want = spans([row])[0]
    assert want == [(12, 24, "guess")]
    assert spans([row] + ["zebrafishing"] * 3)[0] == want and spans([row] * 1000)[999] == want
    assert spans([row] + [f"filler text number {i}" for i in range(999)])[0] == want
    prose = [row, "we went zebrafishing together", "nothing else"]
    assert spans(prose)[0] == [] and spans(prose * 100)[0] == []
    letters = ["".join(chr(97 + (i // 26**k) % 26) * 3 for k in range(4)) for i in range(500)]
    assert not any(v for v in spans([f"the secret is {w}" for w in letters] + [f"some {w} here" for w in letters]).values())


def test_words_decide_only_between_the_bounds():
    rng = random.Random(12)
    for _ in range(300):
        value = "".join(rng.choice("abcdeXY07$-") for _ in range(rng.randrange(6, 30)))
        words = set(secrets.candidate_words(value))
        ranks = secrets.RANK | {w: rng.randrange(1, 2000) for w in words if rng.random() < 0.4}
        assert secrets.guess_cost(value, secrets.EVERY_WORD) <= secrets.guess_cost(value, ranks) + 1e-9


def test_words_are_counted_where_the_texts_lie(spark, monkeypatch):
    """A task makes a row a wanted word, however many rows hold it; false positives of the bitmap count nothing."""
    texts = ["was Required, required and expected.", "Das über alles, nothing expected", "required", "the password is expected too", None, ""] * 100
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    made, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    words = spark.createDataFrame([("required",), ("expected",), ("über",), ("absent",)], "word string")
    want = {"required": 100, "expected": 200, "über": 100}
    assert dict(map(tuple, secrets.word_counts(docs, words).collect())) == want
    rows = [tuple(r) for r in made[0].collect()]
    assert len(rows) <= 3 * 3 and sum(n for _, n in rows) == 400
    monkeypatch.setattr(secrets, "FLUSH", 2)
    monkeypatch.setattr(secrets, "key_filter", lambda *a: (np.full(4096, 255, np.uint8), 32768))
    assert dict(map(tuple, secrets.word_counts(docs, words).collect())) == want
    assert secrets.word_counts(docs, words.limit(0)).collect() == []


def test_redaction_keeps_any_column_and_long_words(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    rows = [(1, f"Das Passwort is {long}.", {"k": 1}, "x", 2.0), (2, f"die {long} und mehr", None, None, None), (None, None, {}, "", 0.0), (3, "", None, "y", 1.0),
            (4, "password is " + "qzjxkv" * 30 + "w" + "xkqjz" * 2000, None, "z", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, ranks string, `a.b` double")
    got = secrets.redact(df)
    assert got.schema == df.schema
    assert sorted((str(r[0]), r[3], r[4]) for r in got.collect()) == sorted((str(r[0]), r[3], r[4]) for r in rows)
    texts = {r[0]: r[1] for r in got.collect()}
    assert texts[1] == rows[0][1] and texts[2] == rows[1][1] and texts[None] is None and texts[3] == "" and texts[4] == "password is [SECRET]"


def test_mixing_keeps_columns_named_like_its_own(spark):
    rows = [(i, "a b c", f"s{i % 2}", f"key{i}", i, {"k": i}, "dot", f"pass{i}", 1.5) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string, _p int, m map<string,int>, `a.b` string, `PASS` string, weight double")
    got = mixing.mix(df)
    assert got.columns == [*df.columns[:7], "n_tokens", "pass", "block", "place", "weight"]
    want = {r[0]: r[:7] for r in rows}
    seen = got.collect()
    assert seen and all(tuple(r)[:7] == want[r[0]] for r in seen) and all(r.n_tokens == 3 and r["pass"] in (0, 1) for r in seen)


def test_rows_without_a_unique_id(spark):
    rng = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(5))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(5, a, 1), (5, a, 1), (5, a, 2), (5, b, 1), (3, near, 1), (None, a, 1), (None, c, 1), (None, c, 1), (None, None, 1), (None, None, 1),
            (7, d, 1), (7, d, 1), (8, "", 1), (9, "", 1), (None, e, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rk int")
    got = sorted([tuple(r) for r in jaccard_join.one_per_component(df).collect()], key=str)
    assert got == sorted([(3, near, 1), (5, b, 1), (None, c, 1), (None, None, 1), (7, d, 1), (8, "", 1), (9, "", 1), (None, e, 1)], key=str)
    bench = spark.createDataFrame([(1, c), (2, b)], ITEMS)
    left = sorted([tuple(r) for r in decontaminate.clean_documents(df, bench).collect()], key=str)
    assert left == sorted([r for r in rows if r[1] not in (b, c)], key=str)


def test_stages_keep_any_column(spark):
    """Columns named like the operators' own, names with dots, maps; texts are
    left at the scan unless their key's class is touched."""
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(3))
    rows = [(i, t, {"k": i}, "x", 1, f"{i}", 2.0) for i, t in enumerate([a, a, b, c, None, "", a + " more"])] + [(1, a, {"k": 9}, "y", 2, "z", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, _key string, rk int, `a.b` string, `c``d` double")
    bench = spark.createDataFrame([(1, c)], ITEMS)
    one = jaccard_join.one_per_component(df)
    assert one.schema == df.schema and sorted(r[0] for r in one.collect()) == [0, 2, 3, 4, 5]
    clean = decontaminate.clean_documents(df, bench)
    assert clean.schema == df.schema and sorted(str(r) for r in clean.collect()) == sorted(str(r) for r in df.collect() if r[0] != 3)
