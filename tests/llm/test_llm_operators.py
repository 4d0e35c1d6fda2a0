"""The operators by themselves: models, sketches, blocks, ties, checksums, batches."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from stepledger.llm import byte_bpe, mixing, near_dups, ppm, quality, secret_scan, sketch, token_rollup, toxicity, url_rules
from stepledger.llm.components import components


def plain_ppm(train, asked):
    """log10 probabilities by a walk down the orders, symbol by symbol, with a count for each context."""
    counts = {}
    for t in train:
        s = b"\xff" * 4 + t + b"\xfb"
        for i in range(4, len(s)):
            for k in range(5):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def symbol(context, x):
        p, out = 1.0, set()
        for k in range(4, -1, -1):
            node = counts.get(context[4 - k :])
            if node is None:
                continue
            left = {y: n for y, n in node.items() if y not in out}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if x in left:
                return p * left[x] / total
            p *= len(left) / total
            out |= set(left)
        return p / (256 - len(out))

    def length(t):
        s = b"\xff" * 4 + t + b"\xfb"
        return sum(math.log10(symbol(s[i - 4 : i], s[i])) for i in range(4, len(s)))

    return symbol, [length(t) for t in asked]


@pytest.mark.parametrize("chunk_chars", [1, 400, 4_000_000])
def test_ppm_equals_a_plain_walk(spark, chunk_chars):
    pick = random.Random(61)
    texts = ["".join(pick.choice("aab ceé\n") for _ in range(pick.randint(0, 60))) for _ in range(60)] + ["", None, "A a", "ab" * 300]
    rows = [(i, t, i % 4 == 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(3)
    got = {r.doc_id: r for r in ppm.score(df, F.col("h"), chunk_chars=chunk_chars).collect()}
    low = [(t or "").encode().lower() for t in texts]
    _, want = plain_ppm([t for t, (_, _, h) in zip(low, rows) if not h], low)
    assert [got[i].score for i in range(len(rows))] == pytest.approx(want, abs=1e-9)


def test_ppm_is_a_distribution():
    symbol, _ = plain_ppm([b"the then there", b"nation notion", "théâtre".encode()], [])
    for context in (b"\xff" * 4, b"\xff\xff\xfft", b" the", b"thex", b"tion", b"zzzz"):
        assert sum(symbol(context, x) for x in range(256)) == pytest.approx(1, abs=1e-12)
    made = ppm.grams(b"abc")
    assert made == [b"\xff\xff\xff\xffa", b"\xff\xff\xffab", b"\xff\xffabc", b"\xffabc\xfb"]


def test_ppm_hears_the_order_of_words(spark):
    text = "the cat sat on the mat and a dog lay by the old log "
    rows = [(i, text * 4, False) for i in range(20)]
    rows += [(100, text * 4, True), (101, " ".join(sorted((text * 4).split())), True), (102, "qzx " * 52, True)]
    got = {r.doc_id: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string, h boolean"), F.col("h")).collect()}
    assert got[100].score > got[101].score + 20 > got[102].score + 100
    assert got[100].score > got[100].base_score


def test_ppm_takes_a_long_text_without_blanks(spark):
    pick = random.Random(62)
    long = "".join(pick.choice("abcdefgh") for _ in range(1_000_000))
    rows = [(1, long, False), (2, long[:500], True), (3, None, None)]
    got = {r.doc_id: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string, h boolean"), F.col("h")).collect()}
    assert got[2].score == pytest.approx(500 * math.log10(1 / 8), rel=0.2) and got[1].n_tokens == 2
    none = spark.createDataFrame([(1, "ab", True)], "doc_id long, text string, h boolean")
    (r,) = ppm.score(none, F.col("h")).collect()
    assert r.score == pytest.approx(3 * math.log10(1 / 256)) and (r.n_known, r.train_tokens) == (0, 0)


def test_ppm_takes_chunks_apart_twice(spark):
    rows = [(i, f"word{i % 5} \x1c\xa0 tail\x0bB", i % 4 == 1) for i in range(40)]
    made = ppm.score(spark.createDataFrame(rows, "doc_id long, text string, h boolean"), F.col("h"), chunk_chars=100)
    plan = made._jdf.queryExecution().analyzed().toString()
    # The counting pass has been written; what is left adds up the values.
    assert plan.count("scored(chunk") == 1 and "keyed(chunk" not in plan
    assert {r.n_tokens for r in made.collect()} == {5}


def test_ppm_buckets_note_the_places_of_keys():
    import numpy as np
    import pyarrow as pa

    pick = random.Random(64)
    for kind, lanes in ((ppm.GRAM, 1), (ppm.WORD, 2)):
        parts = [np.array([[pick.randint(0, 3) for _ in range(lanes)] for _ in range(n)], dtype=np.uint64) for n in (40, 1, 7)]
        table = pa.table({"bucket": [3] * 3, "kind": [kind] * 3, "chunk": [b"x", b"y", b"z"], "keys": [p.tobytes() for p in parts], "counts": [np.arange(len(p)).tobytes() for p in parts]})
        first, *rest = ppm._summed(table).to_pylist()
        keys, n = np.frombuffer(first["keys"], np.uint64).reshape(-1, lanes), np.frombuffer(first["counts"], np.int64)
        assert keys.tolist() == [list(k) for k in sorted({tuple(k) for p in parts for k in p.tolist()})]
        assert first["chunk"] is None and n.sum() == sum(np.arange(len(p)).sum() for p in parts)
        for row, part in zip(rest, parts):
            assert keys[np.frombuffer(row["places"], np.int32)].tolist() == part.tolist()


def test_toxicity_learns_stems_not_ids(spark):
    pick = random.Random(1)
    plain_word = lambda: "".join(pick.choice(["on", "er", "ti", "an"]) for _ in range(pick.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [plain_word() for _ in range(60)]
        if toxic:
            words[pick.randint(0, 59)] = "grobl" + plain_word()
            words[pick.randint(0, 59)] = "grobl" + plain_word()
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") < 400)
    scored = toxicity.score(docs, model, keep=("doc_id",)).filter("doc_id >= 400").collect()
    right = sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in scored)
    assert right >= 0.97 * len(scored)
    again = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    moved = {r.doc_id - 10_000: r.score for r in toxicity.score(again, model, keep=("doc_id",)).collect()}
    assert all(moved[r.doc_id] == r.score for r in scored)


def test_toxicity_keeps_grams_seen_once(spark):
    pick = random.Random(8)
    text = lambda: " ".join("".join(pick.choice("abcé") for _ in range(pick.randint(1, 11))) for _ in range(30))
    rows = [(i, text(), int(i % 2)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))
    counts = {}
    for r in docs.filter(fold > 0).collect():
        for w in plain.words(r.text):
            for g in toxicity.grams(w):
                counts.setdefault(g, [0, 0])[r.toxic] += 1
    assert any(a + b == 1 for a, b in counts.values())
    of_gram, of_context = toxicity.differences([(g, *c) for g, c in counts.items()])
    asked = sorted({w for _, t, _ in rows for w in plain.words(t)} | {"zz", "abzé", "a"})
    want = [sum(of_gram.get(g, of_context.get(g[:-1], 0.0)) for g in toxicity.grams(w)) for w in asked]
    assert toxicity.Speller(*model.words).spell(asked) == pytest.approx(want, abs=1e-9)


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, share in (([], 0.5), ([(1, 0), (2, 0)], 0.25)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        assert {round(r.score, 9) for r in toxicity.score(docs, model).collect()} == {share}


def test_sketches_merge_and_contain(spark):
    pick = random.Random(2)
    w = [f"w{pick.randint(0, 10**6)}" for _ in range(9000)]
    texts = [" ".join(w[:6000]), " ".join(w[6000:]), " ".join(w), " ".join(w[:900])]
    got = sketch.sketch(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), fraction=8)
    a, b, both, part = (r.sketch for r in got.orderBy("i").collect())
    assert set(a) | set(b) <= set(both) and len(set(both) - set(a) - set(b)) <= 4  # runs across the seam
    assert len(both) == pytest.approx(9000 / 8, rel=0.15)
    cols = spark.createDataFrame([(part, both)], "p array<long>, q array<long>")
    one = cols.select(sketch.contained(F.col("p"), F.col("q")).alias("c"), sketch.likeness(F.col("p"), F.col("q")).alias("l")).first()
    assert one.c == 1 and one.l == pytest.approx(0.1, abs=0.03)


def test_mix_meets_targets_with_a_source_of_copies_only(spark):
    rows = [(None, "five words in this one", "a")] * 300 + [(i, "w " * (i % 17), "b") for i in range(300)] + [(i, None, None) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.report(docs).collect()
    by = {}
    for r in first:
        s = by.setdefault((r.source_size, r.target), 0)
        by[(r.source_size, r.target)] = s + r.taken
        assert r.taken <= 2 * r.size
    for (_, target), taken in by.items():
        assert abs(taken - target) <= 17
    assert sum(by.values()) == pytest.approx(1.5 * sum(len(plain.words(t)) for _, t, _ in rows), abs=40)
    assert sorted(map(tuple, mixing.report(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, first), key=repr)


def test_a_larger_share_takes_what_a_smaller_takes(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "a") for i in range(400)], "doc_id long, text string, source string")
    taken = [{r.doc_id for r in mixing.mix(docs, weights=(1,), share=s).filter("mix.copies > 0").collect()} for s in (0.2, 0.5, 0.9)]
    assert taken[0] < taken[1] < taken[2]


def test_checksums_decide():
    body = "aB3" * 10
    good = "ghp_" + body + secret_scan.base62_crc(body)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert secret_scan.find("x " + good + ".") == [("github", 2, 42)]
    assert secret_scan.find("x " + bad) == []
    key = "-----BEGIN PRIVATE KEY-----\nQUJD\nREVG\n-----END PRIVATE KEY-----"
    assert [s[0] for s in secret_scan.find(key)] == ["private_key"]
    assert secret_scan.find(key.replace("QUJD", "QUJ")) == []


def test_spans_count_code_points():
    text = "İ🙂ẞ token=abcdefg AKIA" + "A" * 20
    assert secret_scan.find(text) == plain.base_spans(text)


def test_rollup_batches_commit_once(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "a", "en", 10), (2, "a", "en", 5), (3, None, None, None)], "id int, source string, lang string, n long")
    load = token_rollup.changes(docs, "insert", new=("v1", F.col("n")))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", load) and not rollup.commit("one", load)
    # A delta without its log row, as a failed job leaves it, has no effect and is overwritten.
    sums = load.groupBy("source", "lang", "tokenizer").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    sums.withColumn("batch", F.lit("two")).write.parquet(f"{tmp_path}/deltas/part-{hashlib.sha256(b'two').hexdigest()}")
    total = lambda: sorted((tuple(r) for r in rollup.totals().collect()), key=repr)
    assert total() == sorted([("a", "en", "v1", 2, 15), (None, None, "v1", 1, 0)], key=repr)
    one = docs.filter("id = 1")
    assert rollup.commit("two", token_rollup.changes(one, "revise", old=("v1", F.col("n")), new=("v2", F.lit(12))))
    assert rollup.commit("three", token_rollup.changes(docs.filter("id > 1"), "delete", old=("v1", F.col("n"))))
    assert total() == [("a", "en", "v2", 1, 12)]
    with pytest.raises(ValueError):
        token_rollup.changes(docs, "insert", old=("v1", F.col("n")))


def test_any_text_names_a_batch(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "a", "en", 10)], "id int, source string, lang string, n long")
    names = ["2024/01", "a=b", "50%", "%2F", "", "..", "x" * 400, "é \n"]
    for name in names:
        assert rollup.commit(name, token_rollup.changes(docs, "insert", new=("v", F.col("n"))))
        assert not rollup.commit(name, token_rollup.changes(docs, "insert", new=("v", F.col("n"))))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", len(names), 10 * len(names))]
    assert {r.batch for r in rollup.committed().collect()} == set(names)
    with pytest.raises(TypeError):
        rollup.commit(None, docs)


def test_noise_goes_and_clean_rows_stay(spark):
    """Symbols in every second word go in any host; repeated lines only where the host has more of them than others."""
    pick = random.Random(9)
    clean = lambda: " ".join("".join(pick.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    lines = lambda: "\n".join([clean()] + ["the same line of words again"] * 2 + ["one more line here", "one more line here"])
    rows, want = [], {}
    for i in range(600):
        host = f"h{i % 6}"
        kind = "noise" if i % 10 == 3 else "lines" if i % 6 == 0 and i % 4 == 0 or i % 90 == 1 else "clean"
        text = {"noise": lambda: clean().replace("a", "$$"), "lines": lines, "clean": clean}[kind]()
        rows.append((i, host, text))
        want[i] = kind == "clean" or kind == "lines" and host != "h0"
    judged = quality.judge(spark.createDataFrame(rows, "doc_id int, source string, text string"))
    assert {r.doc_id: r.quality.kept for r in judged.collect()} == want
    assert {tuple(r.quality.suspect) for r in judged.filter("source = 'h0'").collect()} <= {("dup_lines",), ("symbols", "dup_lines")}
    alike = spark.createDataFrame([(i, f"h{i % 3}", lines() if i < 6 else clean()) for i in range(12)], "doc_id int, source string, text string")
    assert quality.judge(alike).filter("not quality.kept").count() == 0


def test_long_pieces_equal_the_library(spark):
    import public_tokenizers

    pick = random.Random(13)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(pick.choice(of) for _ in range(n))
    texts = [letters(100_000), letters(20_000, "ab"), "a" * 30_000, letters(256), letters(257), "ß" * 128, "的" * 5_000, letters(60) + " " + letters(300), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    coder = plain.tokenizer()
    for r in byte_bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        assert r.bpe.ids == coder.encode_ordinary(texts[r.id] or "") and bytes(r.bpe.decoded).decode() == (texts[r.id] or "")


def test_rules_are_entered_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("a.example.net/en/1",)] * 5 + [("b.example.org/fr/2",)], "at string")
    rules = [url_rules.Rule("example.net/en/", "allow"), url_rules.Rule("*", "block", glob=True), url_rules.Rule("*.exe", "block", glob=True)]
    entered = {r.rule: r.token for r in url_rules.index_rules(spark, urls, "at", rules).collect()}
    assert entered == {"example.net/en/": "en", "*": "", "*.exe": "exe"}


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "PART_SETS", 7)
    pick = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(pick.randint(0, 2)):
            w[pick.randint(0, 59)] = f"x{pick.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = plain.components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in near_dups.report(docs).collect()}
    assert got == {i: min(j for j, x in enumerate(label) if x == label[i]) for i in range(90)}
    assert len(set(got.values())) > 1


def test_signatures_estimate_similarity():
    shingler = near_dups.Shingler(near_dups.Rule(1, 80))
    a, b = (shingler.shingles(" ".join(map(str, r))) for r in (range(0, 1000), range(100, 1100)))
    x, y = (np.frombuffer(shingler.signature(shingler.minima(s)), dtype=np.uint64) for s in (a, b))
    n = shingler.rule.bands * near_dups.ROWS
    z = x ^ y
    equal = 1 - np.bitwise_count((z | (z >> np.uint64(1))) & near_dups.EVEN).sum() / n
    assert (equal - 0.25) / 0.75 == pytest.approx(900 / 1100, abs=5 * math.sqrt(0.12 / n))


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (200, 202), (202, 201), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


def test_components_that_have_not_settled_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=1)


def test_bpe_of_random_and_long_words():
    import public_tokenizers as tokenizers

    pick = random.Random(6)
    letters = "aabbeenst THhéß中́ .,-_0123\n\t'sll🙂"
    texts = ["", "a" * 1500, "ab" * 900, "the" * 500, " " * 300, "=-" * 400]
    texts += ["".join(pick.choice(letters) for _ in range(pick.randint(1, 200))) for _ in range(150)]
    coder = byte_bpe.Coder(byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)
    library = plain.tokenizer()
    for text, (ids, back) in zip(texts, coder.code(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and back == text.encode()
