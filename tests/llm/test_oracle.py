"""Queries against their SQL, on a small folder that holds the planted cases."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from renown.llm.queries import ORACLE, QUERIES

TABLES = ("documents", "benchmark", "embeddings", "conversations")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, out = random.Random(7), tmp_path_factory.mktemp("oracle")
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)] + ["ÄPFEL", "日本語", "Tea"]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [prose(n) for n in (40, 25, 12, 5)]
    shared, whole = prose(60), prose(120)
    changed = [w if i % 30 else "changed" for i, w in enumerate(whole)]
    swapped = [w if i % 8 else "other" for i, w in enumerate(items[0])]
    texts = [None, "", "  ", "one two", "One TWO", " ".join(whole), " ".join(whole).upper(), " ".join(changed), "ab" * 400,
             " ".join(prose(30) + items[0] + prose(30)), " ".join(prose(10) + swapped), " ".join(items[2]), " ".join(items[3] + prose(9))]
    texts += [" ".join(prose(rng.randint(5, 200))) for _ in range(30)]
    texts += [" ".join(prose(9) + shared + prose(rng.randint(1, 40))) for _ in range(6)]
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    near = [[x + rng.gauss(0, s) for x in base[i % 4]] for i, s in enumerate([0.05, 0.1, 0.2, 0.25, 0.3] * 8)]
    vectors = base + near + [base[0], None, [], [0.0] * 16, [None] + base[1][1:], [float("nan")] + base[1][1:], [float("inf")] + base[1][1:], base[2][:8], base[2][:8]]
    for _ in range(140):  # phrases over the support, some within longer ones
        texts.append(" ".join([*shared[:3], rng.choice(vocabulary), *whole[:2], rng.choice([".", "", "\t"]), *whole[2:6], "NEW  York\x0bCity hall"]))
    langs = [None if i % 9 == 5 else ("en", "und", "de", "en")[i % 4] for i in range(len(texts))]
    turns = [(conv, turn, role, text) for conv in range(12) for turn, (role, text) in enumerate(
        [("system", "be \\ good"), ("user", rng.choice(texts)), ("assistant", rng.choice(["</s>[INST] a\\<s>", "x", None])), ("tool" if conv % 5 == 4 else "user", "<says> é"), ("assistant", "end")][conv % 2:])]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*turns, strict=True)), strict=True))), out / "conversations.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())}), out / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(items) + 1), pa.int64()), "text": pa.array([" ".join(x) for x in items] + [None], pa.string())}),
                   out / "benchmark.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}),
                   out / "embeddings.parquet")
    return str(out)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, name):
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    have = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(have) == sorted(want) and want
    planted = {"op2_suffix_dedup": ("n_spans", lambda v: v > 0), "op7_jaccard": ("component_id", lambda v: v == 5),
               "op9_decontaminate": ("matched", lambda v: v > 0), "op10_embedding_join": ("n_links", lambda v: v > 0),
               "op12_collocations": ("score", lambda v: v > 0), "op13_chat_format": ("valid", lambda v: v)}
    column, test = planted[name]
    assert sum(test(r[columns.index(column)]) for r in want) > 1
