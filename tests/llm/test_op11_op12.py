"""Vector codes and the filter audit against brute force and their SQL."""

import hashlib
import math
import random
from itertools import permutations

import duckdb
import numpy as np
import pytest

from fundscope.llm import op11_vector_codes as op11, op12_filter_audit as op12

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


# --- operator 11 ---

def brute_codes(rows, parts=16, entries=64, rounds=2):
    """The contract in plain Python integers."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = sorted((([i is None, i or 0], [math.floor(256 * x) for x in v], i, label) for i, v, label in rows), key=lambda r: r[:2])
    vecs, width = [r[1] for r in rows], len(rows[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in vecs]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        moved = []
        for p, book in enumerate(books):
            of = [nearest(c[p], book)[1] for c in cut]
            moved.append([[sum(xs) // len(xs) for xs in zip(*members)] if (members := [c[p] for c, k in zip(cut, of) if k == e]) else old
                          for e, old in enumerate(book)])
        books = moved
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[3]] = by_label.get(r[3], 0) + e
    return sorted(((r[2], "".join(f"{e:02x}" for _, e in f), err, by_label[r[3]], sha) for r, f, err in zip(rows, found, errors)), key=str)


def vectors_of(spark, rows, folder):
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def random_vectors(seed, n, size=1.0, dim=16):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, size))) for _ in range(dim)], rng.choice([1, 2, 2, 2, None])) for i in range(n)]


@pytest.mark.parametrize("size,dim", [(1.0, 32), (0.01, 16), (100_000.0, 16)])
def test_codes_brute_force(spark, tmp_path, size, dim):
    rows = random_vectors(3, 150, size, dim)
    random.Random(1).shuffle(rows)
    assert sorted(map(tuple, op11.query(spark, vectors_of(spark, rows, tmp_path)).collect()), key=str) == brute_codes(rows)


def test_codes_of_odd_rows(spark, tmp_path):
    rows = random_vectors(4, 90)
    same = rows[5][1]
    rows += [(200, None, 1), (201, [math.nan] * 16, 1), (202, [1.0] * 15 + [math.inf], 1), (203, [1.0] * 15 + [-math.inf], 2),
             (204, [None] + [1.0] * 15, 1), (205, [], 1), (5, same, 2), (5, same, 2), (5, [0.5] * 16, 2), (None, [0.25] * 16, None), (None, same, None)]
    got = op11.query(spark, vectors_of(spark, [*rows, (206, [1.0] * 32, 3)], tmp_path))  # another length has no part at every position
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)


def test_codes_of_few_and_no_rows(spark, tmp_path):
    rows = random_vectors(5, 3)
    assert sorted(map(tuple, op11.query(spark, vectors_of(spark, rows, tmp_path / "a")).collect()), key=str) == brute_codes(rows)
    none = op11.query(spark, vectors_of(spark, [], tmp_path / "b"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_extra_columns_and_types(spark, tmp_path):
    rows = [(i, v, str(k), 7, 8) for i, v, k in random_vectors(6, 70)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string, code int, x int")
    vectors = op11.integer_vectors(df)
    coded = op11.encode_vectors(vectors, op11.train_codebooks(vectors))
    assert coded.columns == ["vec_id", "label", "code", "error"] and coded.count() == 70


def test_products_are_exact_beyond_float64():
    rng = np.random.default_rng(0)
    for top in (2**10, 2**24, 2**27, 2**29):
        x, c = rng.integers(-top, top, (40, 4)), rng.integers(-top, top, (9, 4))
        x[0], c[0] = top - 1, -top
        assert (op11.exact_products(x, c) == [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in c] for r in x]).all()
    x = np.array([[2**27 + 1, 1, 0, 0]])
    assert int(op11.exact_products(x, x)[0, 0]) == (2**27 + 1) ** 2 + 1 != int((x.astype(float) @ x.T.astype(float))[0, 0])


def test_too_large_integers_are_refused():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([[2**50] * 16], pa.list_(pa.int64()))], names=["x"])
    with pytest.raises(ArithmeticError):
        list(op11._vectors(iter([batch]), 0))


def test_many_labels_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op11, "BROADCAST_LABELS", 1)
    rows = random_vectors(8, 80)
    assert sorted(map(tuple, op11.query(spark, vectors_of(spark, rows, tmp_path)).collect()), key=str) == brute_codes(rows)


# --- operator 12 ---

DOCS = "doc_id long, text string, lang string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def brute_audit(docs, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine, lost = [r for r in rows if r[0] == part], {f: 0 for f in "ABCDE"}
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                lost[f] += len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                              sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*s[:-1], lost[s[-1]]) for s in steps]
    return sorted(out)


def audit_tables(spark, docs, labels, folder):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def odd_documents():
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["Alpha", "b", "c%", "dé", "E", "f|"] + [f"w{i}" for i in range(rng.choice([3, 400]))]) for _ in range(rng.choice([2, 99, 100, 130])))
             for _ in range(25)]
    texts += ["", None, " \t\n", "ABCDEFGHIJ" + "a" * 90, "x " * 100, "A" * 11 + "é" * 89, "A" * 10 + "\U0001F600" * 90]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "p", 9) for i in range(150)]
    docs += [(3, docs[3][1], "en", "p", 9), (3, docs[3][1], "de", "p", 9), (None, docs[0][1], "en", "p", 9), (None, docs[0][1], None, "p", 9), (None, None, "en", None, None)]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_audit_brute_force_and_sql(spark, tmp_path):
    docs, labels = odd_documents()
    folder = audit_tables(spark, docs, labels, tmp_path)
    got = sorted(map(tuple, op12.query(spark, folder).collect()))
    assert got == brute_audit(docs, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    assert sorted(con.execute(op12.SQL).fetchall()) == got


def test_audit_of_nothing(spark, tmp_path):
    df = op12.query(spark, audit_tables(spark, [], [], tmp_path))
    assert df.count() == 0 and df.columns[:3] == ["part", "filter_order", "step"]


def test_audit_without_labels_has_zeros(spark, tmp_path):
    got = op12.query(spark, audit_tables(spark, [(1, "short", "en", None, None)], [], tmp_path)).collect()
    assert len(got) == 600 and {(r.good_lost, r.toxic_lost) for r in got} == {(0, 0)}
    assert {(r.removed, r.shapley) for r in got if r.filter_order[r.step - 1] == "A"} == {(1, 120)}


def test_contractions_take_many_parts_at_once():
    rng = np.random.default_rng(1)
    steps = op12.StepTable()
    n = rng.integers(0, 2**40, (70, 2, 2, 2, 2, 2))
    whole, one = steps.counts(n, n, n), steps.counts(n[7:8], n[7:8], n[7:8])
    assert all((whole[k][7] == one[k][0]).all() for k in whole)
    first = steps.names.index("CABDE")
    assert (whole["removed"][:, first] == n[:, :, :, 1].sum((1, 2, 3, 4))).all()


def test_one_text_spreads_over_tasks(spark):
    """The least id of a text is joined on hash and id, so that copies of one text are not one key."""
    rows = spark.createDataFrame([(i, "en", 0, b"same") for i in range(50)], "id long, part string, mask int, same binary")
    plan = op12.with_repeats(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "id#" in [line for line in plan.splitlines() if "Join LeftOuter" in line][0]
    assert sorted(r["mask"] for r in op12.with_repeats(rows).collect()) == [0] + [16] * 49
