"""Whitening, collocations and chat formatting against brute force, and the
cases their docstrings define."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from renown.llm import chat_format, collocations, whitening
from renown.llm.chat_format import CHAT, Template

# ---------------------------------------------------------------- whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x long, p int, i int, index long, v string, `a.b` int")


def plain_whitening(good):
    x = np.floor(1024 * np.array(good, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return ((n * x - s) ** 2).sum(1), centred @ u / np.sqrt(e), e / np.trace(cov)


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12))).tolist()
    bad = [None, [], [1.0] * 5, [None] + good[0][1:], [float("nan")] + good[1][1:], [float("-inf")] + good[2][1:]]
    rows = [(i, v, 0, 1, 2, 3, 4, "v", 5) for i, v in enumerate(good)] + [(i, v, 0, 1, 2, 3, 4, "v", 5) for i, v in enumerate(bad, 10_000)]
    got = whitening.whiten(vectors(spark, rows).repartition(7)).toPandas()
    deviation, want, share = plain_whitening(good)
    assert len(got) == 700 * 8 and set(got.n) == {700}
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((w * want).sum(0))
    assert np.abs(w * sign - want).max() < 1e-9
    first = got[got.component == 1].sort_values("vec_id")
    assert [int(d) for d in first.deviation] == deviation.tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, share, rtol=1e-9)
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


def test_whitening_cases(spark):
    columns = (0, 1, 2, 3, 4, "v", 5)
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None, *columns), (2, [], *columns)])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], *columns)])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    # repeated ids, a null id, one dimension without variance, entries whose squares pass 64 bits
    rows = [(1, [1e30, 5.0], *columns), (1, [-1e30, 5.0], *columns), (None, [0.0, 5.0], *columns), (2, [0.0, 5.0], *columns)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    top = 1024 * 2**42
    assert len(got) == 8 and {r.component: r.whitened is None for r in got} == {1: False, 2: True}
    assert sorted(int(r.deviation) for r in got if r.component == 1) == [0, 0, (4 * top) ** 2, (4 * top) ** 2]
    assert sorted(round(r.whitened, 9) for r in got if r.component == 1) == [round(-(2**0.5), 9), 0, 0, round(2**0.5, 9)]


def test_blocks_of_several_partitions(spark):
    """Blocks cut within partitions, filled up with zero rows; ids stay with their rows."""
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, size=(900, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(3)
    blocks = whitening.row_blocks(rows, 4, 128)
    assert sorted(i for r in blocks.collect() for i in r["ids"]) == list(range(900))
    assert sorted(r["at"] for r in blocks.collect()) == list(range(blocks.count())) and blocks.count() >= 8
    sums = [s for _, s, _, _ in whitening.dimension_sums(blocks, 4)]
    assert sums == x.sum(0).tolist()
    for kind in (np.int64, object):
        matrix = whitening.centred_blocks(blocks, 900, sums, 128, blocks.count(), kind)
        centred = x - x.mean(0)
        assert np.allclose(whitening.scatter(spark, matrix), centred.T @ centred)
        out = {r["vec_id"]: r for r in whitening.projected(spark, matrix, np.eye(4)[:, :2], whitening.deviations(blocks, 900, sums, kind)).collect()}
        assert np.allclose([out[i]["w"] for i in range(900)], centred[:, :2])
        assert [int(out[i]["deviation"]) for i in range(900)] == ((900 * x - x.sum(0)) ** 2).sum(1).tolist()


# ------------------------------------------------------------- collocations


def plain_counts(docs):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i:i + n])] += 1
    return counts, totals


def plain_collocations(docs, support, top):
    counts, totals = plain_counts(docs)
    found = {k: c for k, c in counts.items() if c >= support and len(k[1]) > 1}
    out = []
    for (lang, w), a in found.items():
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        inside = any(lang == other and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v))) and 100 * c >= 80 * a
                     for (other, v), c in found.items())
        if not inside:
            score, _, left, right = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(ranked)


def corpus(seed=1, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Über", "日本", "naïve", "\x00z", "a\u00a0b"]
    fixed = ["New  York\tCity hall", "in the end", "ein und AUS", "one two three four five"]
    docs = []
    for _ in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.15 else rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "!"]) for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    # rare, but frequent in the whole: no sample of an eighth proposes all of them
    docs += [("en", f"rare{i % 10} pair{i % 10} of words") for i in range(60)]
    return docs + [(None, None), ("en", ""), ("de", " \t\n.,"), ("fr", "alone"), *[("en", "copied text stays copied")] * 40]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, 1, 2, "k", "p") for i, (lang, t) in enumerate(docs)],
                                 "doc_id long, text string, lang string, c long, size int, key string, `a.b` string")


@pytest.mark.parametrize(("support", "top"), [(6, 2000), (30, 7)])
def test_collocations_equal_plain(spark, support, top):
    docs = corpus()
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, docs).repartition(5), support, top).collect())
    want = plain_collocations(docs, support, top)
    assert got == want and len({g[0] for g in got}) > 2


def test_every_frequent_phrase_is_found_whatever_the_sample(spark, monkeypatch):
    """Border failures: a sample that proposes nothing, and a saturated bitmap."""
    docs = corpus(2, 120)
    df = frame(spark, docs)
    want = plain_collocations(docs, 6, 2000)
    monkeypatch.setattr(collocations, "SAMPLE_SHARE", 10**9)
    assert sorted(tuple(r) for r in collocations.collocations(df, 6).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(collocations, "key_filter", lambda *a: (np.full(4096, 255, np.uint8), 32768))
    assert sorted(tuple(r) for r in collocations.collocations(df, 6).collect()) == want


def test_a_frequent_phrase_is_named_by_few_tasks(spark, monkeypatch):
    """The last pass makes about a row a phrase, not one a phrase and task; counts are those of the passes."""
    rng = random.Random(9)
    docs = [("en", " ".join(rng.choice("abcdefgh") for _ in range(60))) for _ in range(400)]
    df = frame(spark, docs).repartition(16).cache()
    made, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    keys = collocations.frequent_keys(df, 30)
    got = {(r.lang, tuple(r.phrase.split())): r.c for r in collocations.phrase_counts(df, keys).collect() if r.c >= 30}
    counts, totals = plain_counts(docs)
    assert got == {k: c for k, c in counts.items() if c >= 30} | {("en", ()): totals["en"]}
    (named,) = [m for m in made if "phrase" in m.columns]
    assert named.filter("size > 0").count() < 4 * (len(got) - 1)
    assert keys.count() == keys.select("key").distinct().count() == len(got) - 1


def test_checks_tell_phrases_apart():
    words = np.random.default_rng(3).integers(0, 2**63, 2000, dtype=np.uint64)
    starts = np.arange(1990)
    for size in (2, 3, 4):
        checks = collocations.phrase_checks(words, starts, size)
        assert checks.max() < 1 << 16 and len(np.unique(checks)) > 1900
        again = collocations.phrase_checks(np.concatenate([words[5:], words[:5]]), starts[:-5], size)
        assert again.tolist() == checks[5:].tolist()


def test_collocations_long_text_and_empty(spark, monkeypatch):
    import renown.llm.hashing as hashing
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta. ", "eps"]) for _ in range(20_000))
    unbroken = " ".join(rng.choice(["x", "y", "z"]) for _ in range(3000))
    docs = [("en", long), ("en", unbroken + "." + unbroken), ("en", "no break at the end " * 30)]
    monkeypatch.setattr(collocations, "SLICE_BYTES", 1000)
    monkeypatch.setattr(hashing.text_slices, "__defaults__", (1000,))
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in docs])], ["text"])
    assert max(len(b) for _, b, _ in collocations.piece_slices(batch)) < 7000
    got = Counter()
    for lo, b, off in collocations.piece_slices(batch):
        keys, whole, start, end, _ = collocations.slice_phrases(b, off, np.zeros(len(docs), np.uint64)[lo:])
        for n, (k, t) in enumerate(zip(keys, whole, strict=True)):
            for i in np.flatnonzero(t):
                got[tuple(b[start[i]:end[i + n]].tobytes().decode().split())] += 1
    assert got == Counter({k[1]: c for k, c in plain_counts(docs)[0].items()})
    monkeypatch.undo()
    empty = frame(spark, [])
    assert collocations.collocations(empty).collect() == [] and collocations.collocations(empty.drop("doc_id")).collect() == []


def test_scores_past_64_bits(spark):
    """Counts of 10**17: 2,000,000 times that passes 64 bits."""
    big = 10**17 + 7
    rows = [("en", 0, "", 9 * big), ("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big + 1), ("en", 2, "a b", big), ("en", 1, "c", big), ("en", 2, "b c", big - 1), ("en", 3, "a b c", 30)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, c long")
    got = {r.phrase: r.score for r in collocations.scored(counts).collect()}
    assert got == {"a b": 2_000_000 * big // (5 * big + 1), "b c": 2_000_000 * (big - 1) // (3 * big + 1), "a b c": 0}


# -------------------------------------------------------------------- chat


def turns(spark, rows):
    return spark.createDataFrame([(*r, 7, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, p int, state string, `a.b` int")


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>\\", "<<s>", "<\\s>", "[\\INST]", "[INST] \\[/INST]", "<role> user <says> hi </role>\n", " lead and trail ", "\n<</SYS>>\n<<SYS>>",
         "", "é 日本\U0001f600", "<", "</s", "s>", "[[INST]]", "x" * 30_000 + "</s>"]


def plain_digest(rows):
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
    texts = [(r[2] or "", r[3] or "") for r in order]
    loss = "".join(t for role, t in texts if role == "assistant")
    state, ok = "start", True
    for role, _ in texts:
        state = CHAT.transitions.get(state, {}).get(role)
        ok &= state is not None
    return (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            ok, ok and state == "assistant")


def check(spark, rows, parts=6):
    out = chat_format.format_conversations(turns(spark, rows).repartition(parts))
    got = {r.conv_id: r for r in chat_format.digests(out).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    texts = {}
    for r in out.orderBy("p", "i").collect():
        texts[r.conv_id] = texts.get(r.conv_id, "") + "".join(s.text for s in r.segments)
    for conv, mine in by.items():
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256, g.valid, g.complete) == plain_digest(mine)
        assert g.formatted_chars == len(texts[conv])
    return texts


def test_round_trip_and_machine(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * 4
        if rng.random() < 0.3:
            rng.shuffle(roles)
        if rng.random() < 0.2:
            roles[rng.randrange(len(roles))] = rng.choice(["tool", "", None, "<says> [INST]", "USER"])
        for i, role in enumerate(roles[:rng.randint(1, len(roles))]):
            rows.append((conv, i, role, rng.choice([*NASTY, None])))
    rows += [(None, 0, "user", "null id"), (None, 1, "assistant", "same conversation"), (77, None, "user", "first"), (77, 0, "assistant", "second")]
    rows += [(78, 0, "user", "twice")] * 2 + [(78, 1, "assistant", "x")]
    texts = check(spark, rows)
    for text in texts.values():
        for m in re.finditer("|".join(map(re.escape, CHAT.controls)), text):
            assert m  # every control string stands at a turn boundary:
        assert sum(text.count(c) for c in CHAT.controls) == 2 * len(list(chat_format.read_turns([text]))) + text.count("<says>")


def test_hot_conversation_spans_tasks(spark):
    """Half of all turns in one conversation, in many partitions: states pass
    from task to task, and an error near its end is found at its place."""
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(4000)] + [(5, 4000, "assistant", "late"), (5, 4001, "assistant", "wrong")]
    rows += [(c, i, "user" if i % 2 == 0 else "assistant", "y") for c in range(6, 600) for i in range(6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = chat_format.format_conversations(turns(spark, rows).repartition(8))
        assert out.filter("conv_id = 5").select("p").distinct().count() > 1
        states = [r.state for r in out.filter("conv_id = 5").orderBy("p", "i").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert states[:4000] == ["user", "assistant"] * 2000 and states[4000:] == ["error", "error"]
    check(spark, rows)


def test_pieces_of_any_size_and_bad_templates():
    escape = chat_format.escaper(CHAT)
    given = [(role, text) for role in ("system", "user", "assistant", "tool", "") for text in NASTY]
    whole = "".join(t for role, text in given for t, _ in chat_format.segments(CHAT, escape, role, text))
    assert list(chat_format.read_turns([whole])) == given
    assert list(chat_format.read_turns([whole[i:i + 997] for i in range(0, len(whole), 997)])) == given
    with pytest.raises(ValueError):
        list(chat_format.read_turns([whole[:-3]]))
    for turns_of in ({"user": ("<a>", "<a>")}, {"user": ("<a>", " ")}, {"user": ("<a>", "<\\a>")}, {"user": ("aba", "bab")}, {"user": ("<a>", "<<a>>")}):
        with pytest.raises(ValueError):
            Template(turns_of, CHAT.other, CHAT.loss, "start", CHAT.transitions, CHAT.accept)


def test_chat_empty(spark):
    assert chat_format.digests(chat_format.format_conversations(turns(spark, []))).collect() == []


def test_phrase_keys_within_a_bitmap_are_those_of_the_whole_list():
    text = b"a b c a b d. a b c e a b c"
    b, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    lang = np.zeros(1, np.uint64)
    keys, whole, start, *_ = collocations.slice_phrases(b, off, lang)
    for take in ([0, 1, 2], [0, 1, 2, 5, 6, 7, 8]):  # words and the phrases that start there
        bitmap = np.zeros(1 << 12, np.uint8)
        for k, t in zip(keys, whole, strict=True):
            for key in k[[w for w in take if w < len(k) and t[w]]]:
                at = int(key) & (8 * len(bitmap) - 1)
                bitmap[at >> 3] |= 1 << (at & 7)
        known = [t & collocations._member(k, bitmap) for k, t in zip(keys, whole, strict=True)]
        for n in range(1, len(known)):  # both parts known as well
            known[n] &= known[n - 1][:len(known[n])] & known[n - 1][1:len(known[n]) + 1]
        got, places, *_ = collocations.slice_phrases(b, off, lang, within=bitmap)
        for n in range(4):
            assert places[n].tolist() == np.flatnonzero(known[n]).tolist()
            assert got[n].tolist() == keys[n][places[n]].tolist()
