"""Repeats, periodic runs and whitening by themselves, against plain versions."""

import random

import numpy as np
import plain
import pytest

from stepledger.llm import periodic, repeats, whitening


def cases(seed, count, most):
    pick = random.Random(seed)
    for k in range(count):
        letters = pick.choice([1, 2, 2, 3])
        codes = [pick.randrange(letters) for _ in range(pick.randint(0, most))]
        if k % 3 == 0:
            part = [pick.randrange(letters + 1) for _ in range(pick.randint(1, 5))]
            codes = codes[:5] + part * pick.randint(2, 7) + codes[5:12] + part * 3
        yield codes


def test_lyndon_groups_are_next_smaller_suffixes():
    for codes in cases(1, 300, 30):
        for falling in (False, True):
            lengths, groups = periodic.lyndon_groups(codes, falling)
            assert lengths == plain.longest_lyndon(codes, falling)
            roots = [tuple(codes[i : i + n]) for i, n in enumerate(lengths)]
            assert all((groups[i] == groups[j]) == (roots[i] == roots[j]) for i in range(len(codes)) for j in range(i))


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 3), (5, 1)])
def test_runs_equal_all_periods(exponent, least):
    for codes in cases(2, 500, 60):
        assert periodic.runs(codes, exponent, least) == plain.runs(codes, exponent, least)


def test_cutting_at_rare_words_loses_no_run():
    for k, codes in enumerate(cases(3, 300, 80)):
        texts = [" ".join(map(str, codes)), "", "rare " + " ".join(map(str, codes)) + " word"]
        (n, first, _), (zero, none, empty), (_, shifted, _) = periodic.find(texts)
        assert (n, first) == (len(codes), plain.runs(codes))
        assert (zero, none, empty) == (0, [], "")
        assert shifted == [(s + 1, length, p) for s, length, p in first]


def test_runs_in_a_very_long_text():
    codes = [0, 1] * 50_000 + [2] + [3] * 70_000
    assert periodic.runs(codes) == [(0, 100_000, 2), (100_001, 70_000, 1)]


def test_find_runs_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", "x"), (2, None, "y")], "id long, periodic string, n string")
    got = {r.id: r for r in periodic.find_runs(df, text="periodic", out="n").collect()}
    assert got[1].periodic == "a a a a a a b" and got[1].n.collapsed == "a b"
    assert [tuple(r) for r in got[1].n.runs] == [(0, 6, 1)] and tuple(got[2].n) == (0, [], "")
    with pytest.raises(ValueError):
        periodic.find_runs(df, text="periodic", exponent=2)


@pytest.mark.parametrize("chunk_chars", [1, 3_000, 4_000_000])
def test_repeats_do_not_depend_on_chunks(spark, chunk_chars):
    pick = random.Random(4)
    word = lambda: pick.choice(["a", "b"]) if pick.random() < 0.3 else str(pick.randrange(50))
    passages = [[word() for _ in range(pick.choice([12, 13, 14, 20, 40]))] for _ in range(12)]
    rows = []
    for i in range(70):
        parts = [pick.choice(passages) if pick.random() < 0.6 else [word() for _ in range(pick.randint(0, 25))] for _ in range(4)]
        rows.append((pick.choice([i, i % 9, None]), " ".join(w for p in parts for w in p)))
    rows += [(200 + i, " ".join(["same"] * (5 + i))) for i in range(20)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(
        ((r.doc_id, r.n_words, [tuple(x) for x in r.repeats], r.kept) for r in repeats.remove_repeats(df, chunk_chars=chunk_chars).collect()),
        key=repr,
    )
    want = []
    for (i, t), out in zip(rows, plain.repeated_words(rows)):
        w = plain.words(t)
        marks = [k in out for k in range(len(w))] + [False]
        edges = [k for k in range(len(marks)) if marks[k] != (marks[k - 1] if k else False)]
        want.append((i, len(w), list(zip(edges[::2], edges[1::2])), " ".join(x for k, x in enumerate(w) if k not in out)))
    assert got == sorted(want, key=repr)
    assert sum(len(r[2]) for r in got) > 40


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 120])
def test_leading_eigenpairs(n):
    a = np.random.default_rng(n).normal(size=(n, n + 3))
    m = a @ a.T
    values, vectors = whitening.leading(m, 32)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:32], rtol=1e-12, atol=1e-13 * m.max())
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * values.max()


def test_equal_and_close_eigenvalues():
    n = 41
    wilkinson = np.diag(np.abs(np.arange(n) - 20.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    for m in (np.eye(40), np.kron(np.eye(10), [[2.0, 1], [1, 2]]), np.diag(np.r_[np.ones(5), np.zeros(9)]), wilkinson, 1e-200 * np.eye(3)):
        values, vectors = whitening.leading(m, 32)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
        assert np.abs(m @ vectors - vectors * values).max() < 1e-13 * max(values.max(), 1e-200)


def test_whitening_of_doubles_and_of_equal_vectors(spark):
    made = np.random.default_rng(5).normal(size=(300, 7)) @ np.random.default_rng(6).normal(size=(7, 7)) + 1e6
    df = spark.createDataFrame([(i, v.tolist(), "a", "b") for i, v in enumerate(made)], "id long, v array<double>, x string, sums string")
    fitted = whitening.fit(df, "v", 3)
    got = np.array([r.out for r in whitening.whiten(df, "v", fitted, "out").orderBy("id").collect()])
    assert got.shape == (300, 3)
    centred = got - got.mean(axis=0)
    assert np.abs(centred.T @ centred / 300 - np.eye(3)).max() < 1e-8
    assert abs(whitening.identity_error(df, "v", fitted) - np.abs(centred.T @ centred / 300 - np.eye(3)).max()) < 1e-8
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.report(same).count() == 0
    assert len(whitening.fit(same, "embedding").values) == 0


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(0, [2.0**40, 0.0]), (1, [-(2.0**40), 1.0]), (2, [3.0, 2.0])]
    got = {r.vec_id: r for r in whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()}
    assert got[0].deviation is None and got[1].deviation is None
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    want = sum((3 * x[2][d] - sum(v[d] for v in x)) ** 2 for d in range(2))
    assert got[2].deviation == want
