import functools
import hashlib
import os
import random
import re
import zlib

import brute
import compare
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import decontaminate, exact_dedup, langid, line_dedup, minhash, mixing, quality, queries, select_top, signature_tree, sql, suffix_dedup, url_reputation, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row string, _doc string, line string, size string, total string, _key string"
RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
say = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
BASE = say(120)


def near(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[RNG.randrange(len(w))] = RNG.choice(WORDS)
    return " ".join(w)


@functools.cache
def documents():
    texts = [BASE, BASE, BASE.upper(), BASE.replace(" ", "\n"), *(near(BASE, k) for k in (1, 2, 3, 5, 9, 12, 15, 30)), None, None, "", " \n", "one", "One", "one two", "é É ß", say(30000), "a" * 5000, "ab" * 400]
    texts += [say(60) + " " + BASE[:300] for _ in range(6)] + [say(RNG.randint(1, 90)) for _ in range(40)]
    rows = [(i, t, RNG.choice(["en", "de", None]), RNG.choice(["s0", "s0", "s1", "s2", None]), len(t or ""), *["x"] * 7) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[12], (None, "no id", "en", None, 5, *["y"] * 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


BENCH = "item_id long, text string, _id string"


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare.of_spark(queries.queries()[name](spark, sf_dir)) == compare.of_duckdb(compare.connect(sf_dir), sql.ORACLES[name])


@pytest.fixture(scope="module")
def saved(docs, spark, tmp_path_factory):
    """The documents as a folder of tables, with a benchmark."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    w = BASE.split(" ")
    items = [(1, " ".join(w[20:45]).upper(), "x"), (2, "one two", "x"), (3, None, "x"), (4, "", "x"), (10, say(20), "x"), (None, say(5), "x"), (5, " ".join(w[20:45]), "x"), (5, "ONE", "x")]
    spark.createDataFrame(items, BENCH).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _tables(path):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_exact_dedup", "op10_line_dedup"])
def test_hard_rows_equal_sql(spark, saved, name):
    assert compare.of_spark(queries.queries()[name](spark, saved)) == compare.of_duckdb(_tables(saved), sql.ORACLES[name])


def test_decontaminate_without_a_broadcast(spark, saved, sf_dir, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert compare.of_spark(queries.op1_decontaminate(spark, saved)) == compare.of_duckdb(_tables(saved), sql.ORACLES["op1_decontaminate"])
    assert compare.of_spark(queries.op1_decontaminate(spark, sf_dir)) == compare.of_duckdb(compare.connect(sf_dir), sql.ORACLES["op1_decontaminate"])


def test_decontaminate_removes(spark):
    bench = spark.createDataFrame([(1, "b c D", "x")], BENCH)
    rows = spark.createDataFrame([(1, "A, b-c. d! e", "u"), (2, "b c", "v"), (3, None, "w"), (4, "b c d b C d", "_")], "doc_id long, text string, _spans string")
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(rows, bench).collect()) == [2, 3]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(rows, bench, remove="span").collect()}
    assert spans == {1: "A, e", 2: "b c", 3: None, 4: ""}
    with pytest.raises(ValueError, match="document or span"):
        decontaminate.decontaminate(rows, bench, remove="all")


def test_block_names_survive_colliding_hashes(docs):
    want = sorted(map(str, exact_dedup.exact_duplicates(docs).drop("kept").collect()))
    for bits, block in ((3, 64), (64, 16)):
        assert sorted(map(str, exact_dedup.exact_duplicates(docs, block_bytes=block, hash_bits=bits).drop("kept").collect())) == want


def drawn(spark, docs, seed=7):
    """Rows (doc_id, source, size, copies) of a plain draw."""
    rows = docs.select("doc_id", "source", mixing.n_words(F.col("text")), F.xxhash64(F.lit(seed), "doc_id", "source", "text")).collect()
    seen, numbered = {}, []
    for r in rows:
        numbered.append((r[3], seen.setdefault(r[3], 0)))
        seen[r[3]] += 1
    hashes = {(r[0], r[1]): r[2] for r in spark.createDataFrame(numbered, "t long, k long").select("t", "k", F.xxhash64("t", "k")).collect()}
    copies = brute.pareto([(r[1], r[2], t if k == 0 else hashes[t, k]) for r, (t, k) in zip(rows, numbered)])
    return sorted(str((*r[:3], c)) for r, c in zip(rows, copies))


def test_mix(spark, docs):
    rows = mixing.mix_counts(docs).collect()
    want, had, got = brute.mix([(r["source"], r["size"]) for r in rows]), {}, {}
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        had[r["source"]] = max(had.get(r["source"], 0), r["size"])
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(got[s] - t) <= had[s] / 2
    plain = lambda rows: sorted(str((r["doc_id"], r["source"], r["size"], r["copies"])) for r in rows)
    assert plain(rows) == drawn(spark, docs) == plain(mixing.mix_counts(docs.repartition(5)).collect())
    mixed = mixing.mix_documents(docs.withColumn("copy", F.lit(-1)))
    assert mixed.columns == [*docs.columns, "copy", "copy_"]
    taken = {}
    for r in mixed.collect():
        assert r["copy"] == -1
        taken[r["doc_id"], r["text"]] = taken.get((r["doc_id"], r["text"]), 0) + 1
    counts = {}
    for r in rows:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + r["copies"]
    by_id = {}
    for (i, _), n in taken.items():
        by_id[i] = by_id.get(i, 0) + n
    assert by_id == {i: n for i, n in counts.items() if n}


def test_mix_draws_repeated_rows_each(spark):
    rows = [(i, f"{i} " * 10, "s0") for i in range(100)] + [(500, "x " * 10, "s1")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix_counts(docs).collect()
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in ("s0", "s1")}
    assert abs(taken["s0"] - 10000 / 7) <= 5 and abs(taken["s1"] - 4000 / 7) <= 5
    assert sorted(str((r["doc_id"], r["source"], r["size"], r["copies"])) for r in got) == drawn(spark, docs)
    assert mixing.mix_documents(docs).filter("source = 's1'").count() == taken["s1"] / 10


def test_mix_of_many_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"host{i % 900}") for i in range(3000)]
    got = mixing.mix_counts(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    want = brute.mix([(r["source"], r["size"]) for r in got])
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_mix_is_close_for_many_sources(spark, sf_dir):
    rows = queries.op3_mix_sources(spark, sf_dir).collect()
    got, target = {}, {}
    for r in rows:
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert sum(got.values()) == pytest.approx(sum(target.values()), rel=0.03)
    assert all(abs(got[s] - target[s]) <= 0.2 * target[s] for s in got)


def test_near_duplicates_equal_all_pairs(docs):
    rows = minhash.near_duplicates(docs.filter("doc_id is not null"), size=2).collect()
    want = brute.near_duplicates([r[:2] for r in documents() if r[0] is not None])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert len(rows) == len(documents()) - 1 and sum(r["first"] for r in rows if r["n_shingles"]) == len({c for n, c in want.values() if n})


def test_dense_group_is_one_component(spark):
    rows = [(i, near(BASE, 8), "x") for i in range(300)] + [(1000 + i, say(80), "x") for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _i string"), size=2).collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates([r[:2] for r in rows]).items()}


def test_drop_near_duplicates_keeps_one(spark, docs):
    kept = minhash.drop_near_duplicates(docs, size=2).collect()
    ids = [r["doc_id"] for r in kept]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and len(kept[0]) == 12


def test_posterior_bounds():
    least = minhash.least_matches(240, 40, 0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * 240


def test_prefixes_keep_every_link():
    rng = random.Random(9)
    kept = 0
    for _ in range(3000):
        a = rng.randint(1, 60)
        b = a + rng.randint(0, a // 4 + 1)
        common = a - rng.randint(0, a // 4 + 1) if a > 4 else a
        x, y = set(range(common)) | set(range(100, 100 + a - common)), set(range(common)) | set(range(200, 200 + b - common))
        rank = {s: rng.random() for s in x | y}
        x, y = sorted(x, key=rank.get), sorted(y, key=rank.get)
        small, large = set(x[: signature_tree.prefix_lengths(a, 80)[0]]), set(y[: signature_tree.prefix_lengths(b, 80)[1]])
        if 100 * common >= 80 * (a + b - common):
            kept += 1
            assert small & large, (a, b, common)
    assert kept > 500


def counted(monkeypatch):
    """The numbers of pairs that near_duplicates compares, as it runs."""
    found, staged = [], minhash.staged

    def count(df, name):
        out = staged(df, name)
        if name == "pairs":
            found.append(out.count())
        return out

    monkeypatch.setattr(minhash, "staged", count)
    return found


def appended(n):
    """n texts of the same 120 words and 16 or 17 words of their own: all pairs have a similarity of 0.77 to 0.79."""
    return [(i, " ".join([BASE, *(f"n{i}k{k}" for k in range(16 + i % 2))])) for i in range(n)]


def replaced(n):
    """n texts of 120 words with four replaced: most pairs have a similarity of 0.76, a few are links."""
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(n):
        x = list(base)
        for k, at in enumerate(random.Random(i).sample(range(1, 119, 2), 4)):
            x[at] = f"n{i}k{k}"
        rows.append((i, " ".join(x)))
    return rows


def test_group_just_under_the_threshold_gives_few_pairs(spark, monkeypatch):
    """Pairs and nodes that are rows, from 300 texts and from 600: linear, where all pairs are 44,850 and 179,700."""
    moved = []
    for n in (300, 600):  # two groups in one table
        rows = [(2 * i, t) for i, t in appended(n // 2)] + [(2 * i + 1, t) for i, t in replaced(n // 2)]
        pairs, nodes, tree = counted(monkeypatch), [], signature_tree.staged
        monkeypatch.setattr(signature_tree, "staged", lambda df, name: (out := tree(df, name), nodes.append(out.count()) if name in ("node-pairs", "tree-links") else None)[0])
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
        assert got == {i: c for i, (_, c) in brute.near_duplicates(rows).items()}
        moved.append(sum(pairs) + sum(nodes))
        monkeypatch.undo()
    assert moved[0] < 3000, moved
    assert moved[1] <= 2.2 * moved[0], moved


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    two = [(1, BASE), (2, near(BASE, 2))]
    pairs, sets = counted(monkeypatch), []
    confirmed = minhash._with
    monkeypatch.setattr(minhash, "_with", lambda pairs, table, what: sets.append(table.count()) or confirmed(pairs, table, what))
    for m in (1, 100):
        rows = minhash.near_duplicates(spark.createDataFrame(two * m, "doc_id long, text string").repartition(7), size=2).collect()
        assert {r["component_id"] for r in rows} == {1} and len(rows) == 2 * m and sum(r["first"] for r in rows) == 1
    assert pairs == [1, 1] and sets[1] == sets[3] == 2


@pytest.mark.parametrize(("most", "bits"), [(suffix_dedup.MOST, 64), (1, 64), (suffix_dedup.MOST, 1), (2, 2)])
def test_repeated_bytes_equal_brute_force(spark, docs, most, bits):
    rows = suffix_dedup.repeated_spans(docs.filter("doc_id is not null").distinct(), 100, most=most, bits=bits).collect()
    want = brute.repeated_bytes({r[:2] for r in documents() if r[0] is not None}, 100)
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want


@pytest.mark.parametrize("bits", [64, 1])
def test_repeated_rows_remove_all(spark, bits):
    t = say(80)
    rows = [tuple(r)[1:] for r in suffix_dedup.repeated_spans(spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string"), 100, bits=bits).collect()]
    assert rows == [(len(t), len(t), 1, hashlib.sha256(b"").hexdigest())] * 2


def test_suffix_order():
    import numpy as np

    rng = random.Random(0)
    for alphabet in (b"a", b"ab", b"abcdefgh"):
        raw = bytes(rng.choice(alphabet) for _ in range(900))
        raw += raw[:300]
        starts = np.array(rng.sample(range(len(raw) - 40 + 1), 700))
        order, group = suffix_dedup.sort_suffixes(np.frombuffer(raw, np.uint8), starts, 40)
        text = [raw[i : i + 40] for i in starts[order]]
        assert text == sorted(text)
        assert [a == b for a, b in zip(text, text[1:])] == [a == b for a, b in zip(group, group[1:])]


def test_language_held_out(spark, tmp_path):
    rng = random.Random(1)
    syllables = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ie", "ö"], "fr": ["eau", "tion", "é", "ou"]}
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(rng.randint(2, 60))), lang) for i in range(600) for lang, s in [rng.choice(list(syllables.items()))]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 !!", "de"), (903, "schung", None), (904, "thing " * 200_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op4_language(spark, str(tmp_path)).collect()}
    assert all(g["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= g["score"] <= 1 for i, g in got.items())
    held = [got[i]["lang_pred"] == lang for i, t, lang in rows[:600] if got[i]["held_out"]]
    assert sum(held) / len(held) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "en"]


def test_language_of_copies_is_learned(spark):
    rows = [(i, "schung ieung der", "de") for i in range(2000)] + [(2000 + i, f"thing on the {say(3)}", "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, per_lang=2)  # by rows the share of German is 24 of 2000
    assert model[2] == ["de", "en"] and len(model[0]) == 3
    asked = spark.createDataFrame([(1, "schung der ieung"), (2, "the thing")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict_language(asked, model).collect()} == {1: "de", 2: "en"}


def test_language_on_the_table(spark, sf_dir):
    docs = queries._table(spark, sf_dir, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.filter("lang is not null and text rlike '[A-Za-z]'").select("doc_id", "lang").collect()}
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in queries.op4_language(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in lang]
    assert len(held) > 20 and sum(held) >= 0.97 * len(held)


def test_language_equals_dense_kernel_ridge(spark):
    import numpy as np

    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(2)) for _ in range(rng.randint(1, 9))), lang) for i in range(60) for lang, s in [rng.choice([("a", "abcd"), ("b", "cdef"), ("c", "efab")])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(i, "".join(rng.choice("abcdef ") for _ in range(20)) + "x") for i in range(40)], "doc_id long, text string")

    def grams(text):
        raw = (" " + text.lower() + " ").encode()
        code = lambda g: (int.from_bytes(g, "big") + (len(g) << 40)) * 0x9E3779B97F4A7C15 % (1 << 64) >> 50
        return {code(raw[k : k + n]) for n in range(1, 5) for k in range(len(raw) - n + 1)}

    train = sorted({(lang, t) for _, t, lang in rows})
    have = [grams(t) for _, t in train]
    k = lambda x, y: len(x & y) / (len(x) * len(y)) ** 0.5
    gram = np.array([[k(x, y) for y in have] for x in have])
    y = np.array([[float(lang == n) for n in "abc"] for lang, _ in train])
    alpha = np.linalg.solve(gram + langid.RIDGE * len(train) * np.eye(len(train)), y)
    model = langid.train(docs, n_landmarks=1000)
    got = {r["doc_id"]: r for r in langid.predict_language(asked, model).collect()}
    for r in asked.collect():
        s = np.array([k(grams(r["text"]), x) for x in have]) @ alpha
        assert got[r["doc_id"]]["score"] == pytest.approx(min(max(s.max(), 0), 1), abs=2e-3)
        assert got[r["doc_id"]]["lang_pred"] == "abc"[int(s.argmax())] or sorted(s)[-1] - sorted(s)[-2] < 2e-3


def test_two_hundred_languages(spark):
    rng = random.Random(8)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(20)] for k in range(200)}
    text = lambda v: " ".join(rng.choice(v) for _ in range(12))
    model = langid.train(spark.createDataFrame([(text(v), k) for k, v in words.items() for _ in range(12)], "text string, lang string"))
    assert len(model[2]) == 200 and len(model[0]) == 1600
    asked = spark.createDataFrame([(k, text(v)) for k, v in words.items()], "doc_id string, text string")
    assert sum(r["doc_id"] == r["lang_pred"] for r in langid.predict_language(asked, model).collect()) > 190


def test_quality_splits_junk(spark):
    rng = random.Random(2)
    rows = [(i, say(rng.randint(20, 80)) if i % 4 else " ".join(w.upper() + "!!" for w in say(40).split()), "x") for i in range(400)] + [(500, None, "x"), (501, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    good = spark.createDataFrame([(i,) for i in range(400) if i % 4 and i < 200], "_good_id long")
    got = {r["doc_id"]: r["selected"] for r in quality.importance_sample(docs, good).collect()}
    assert all(got[i] == bool(i % 4) for i in range(400)) and got[500] and got[501]
    assert sum(r["selected"] for r in quality.importance_sample(docs, good, k=50).collect()) == 50
    kept = quality.keep_selected(docs, good)
    assert kept.columns == docs.columns and kept.count() == 302
    assert quality.importance_sample(docs, good.limit(0)).filter("not selected").count() == 0


def plain_weights(rows, good, bits=14):
    """{doc_id: (log weight, judged weight)} of rows (doc_id, text), by dictionaries of features."""
    import math
    from collections import Counter

    m, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def features(text):
        tokens = re.findall(r"\w+|[^\w\s]+", text or "")
        h = [zlib.crc32(t.lower().encode()) for t in tokens]
        shape = [3 if not (t[0].isalnum() or t[0] == "_") else 2 if len(t) > 1 and t.isupper() else 1 for t in tokens]
        values = [(1, x) for x in h]
        values += [(2, (b * m + a) * 0xC2B2AE3D27D4EB4F & mask) for a, b in zip(h, h[1:])]
        values += [(3, q * 4 + p + 16 * (a == b)) for a, b, p, q in zip(h, h[1:], shape, shape[1:])]
        return [(v + k & mask) * m % (1 << 64) >> 64 - bits for k, v in values]

    each = [(i, features(t)) for i, t in rows]
    raw, target = Counter(f for _, fs in each for f in fs), Counter(f for i, fs in each if i in good for f in fs)
    share = sum(target.values()) / sum(raw.values())
    ratio = {f: math.log((target[f] + quality.PRIOR) / (n * share + quality.PRIOR)) for f, n in raw.items()}
    sums = [(i, sum(ratio[f] for f in fs), len(fs)) for i, fs in each]
    return [(i, w, w * quality.LENGTH / max(n, quality.LENGTH)) for i, w, n in sums]


def test_quality_draw_equals_plain_python(spark):
    import math

    rng = random.Random(12)
    rows = [(i, say(rng.randint(0, 120)) + rng.choice(["", " AND THAT!!", " a a a"])) for i in range(200)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = {i for i in range(0, 120, 3)}
    ids = spark.createDataFrame([(i,) for i in good], "_good_id long")
    noise = {r[0]: r[1] % (1 << 64) for r in docs.select("doc_id", F.xxhash64(F.lit(3), "doc_id", F.xxhash64("text"))).collect()}
    gumbel = {i: -math.log(-math.log(((n >> 11) + 0.5) / (1 << 53))) for i, n in noise.items()}
    weights = plain_weights(rows, good)
    for k in (None, 1, 77):
        got = {r["doc_id"]: r for r in quality.importance_sample(docs, ids, k).collect()}
        assert all(got[i]["log_weight"] == pytest.approx(w, abs=1e-9) for i, w, _ in weights)
        many = sum(j >= quality.LEAST for _, _, j in weights) if k is None else k
        order = sorted(weights, key=lambda x: -((x[2] if k is None else x[1]) + gumbel[x[0]]))
        assert {i for i, r in got.items() if r["selected"]} == {i for i, _, _ in order[:many]}


def test_quality_keeps_clean_rows_without_a_label(spark, sf_dir):
    docs = queries._table(spark, sf_dir, "documents")
    labels = queries._table(spark, sf_dir, "labels")
    selected = {r["doc_id"]: r["selected"] for r in quality.importance_sample(docs, queries.good_ids(labels)).collect()}
    labelled = {r["doc_id"] for r in labels.collect()}

    def is_junk(text):
        w = text.split()
        return bool(re.search(r"[&#$%*!]{2,}|\w \| \w", text)) or sum(a.lower() == b.lower() for a, b in zip(w, w[1:])) > 0.05 * len(w) or sum(x.isupper() and len(x) > 1 for x in w) > 0.1 * len(w)

    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] and r["doc_id"] not in labelled]
    clean, junk = [i for i, t in rows if not is_junk(t)], [i for i, t in rows if is_junk(t) and len(t.split()) >= 100]
    assert len(clean) > 50 and len(junk) > 5
    assert [i for i in clean if not selected[i]] == [] and [i for i in junk if selected[i]] == []


def test_quality_does_not_judge_by_length(spark):
    other = [say(300) for _ in range(30)]
    rows = [(i, say(300)) for i in range(60)] + [(100, other[0]), (101, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(3)], "_good_id long")
    assert quality.importance_sample(docs, ids).filter("not selected").count() == 0


def test_kth_largest(spark):
    rng = random.Random(3)
    xs = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(300)] + [5, 5, 5, -1, 0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "k long")
    for k in (1, 2, 150, 304, 305):
        assert select_top.kth_largest(df, "k", k) == sorted(xs, reverse=True)[k - 1]
    assert select_top.kth_largest(df, "k", 306) is None


def test_line_ratio(spark):
    rows = [(i, f"head\nown {i}\n\nfoot" if i < 11 else f"own {i}\nfoot", "h") for i in range(100)] + [(200, None, "h"), (201, "foot", None), (202, "foot\r", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_drop", F.lit("x"))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.drop_boilerplate(docs, 0.1, 10).collect()}
    assert got[3] == ("own 3\n", 3, 2) and got[50] == ("own 50", 2, 1) and got[200] == (None, 0, 0) and got[201] == ("foot", 1, 0) and got[202] == ("foot\r", 1, 0)


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_url_rules(spark):
    urls = ["http://a.example.com/en/71", "http://example.COM/en/8?x", "http://com/en/", "https://xcom/en/", "http://a.net/de/1#t", "ftp://b.example.net/de/8", "http://example.org/es", "http://h.org/es/1", None, "example.com/en/", "http://u?//x", "http://com:80/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_reputation.judge_urls(df, spark.createDataFrame([(1, 0)], "page_id long, bad int"), RULES).collect()}

    def parts(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    for i, u in enumerate(urls):
        host, path = parts(u)
        fits = [(len(r), v, r) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fits)[2] if fits else None)
        assert got[i]["verdict"] == (max(fits)[1] if fits else "allow")


def test_registered_domains(spark):
    hosts = {"a.b.com.tr": "b.com.tr", "shop.co.in": "shop.co.in", "x.y.example.org": "example.org", "co.uk": "co.uk", "t.co": "t.co", "a.blog.host": "blog.host", "10.0.0.1": "10.0.0.1", "x.u.github.io": "u.github.io"}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r[0]: r[1] for r in df.select("h", url_reputation.domain_of(F.col("h"), ["github.io"])).collect()}
    assert got == hosts


def test_bad_host_is_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 5 == 0 else 'h' + str(i % 7)}.site{i % 3}.org/{i}") for i in range(1000)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0 or i % 31 == 0)) for i in range(500)], "page_id long, bad int")
    got = url_reputation.judge_urls(pages, labels, []).collect()
    assert all((r["verdict"] == "block") == r["host"].startswith("bad") for r in got)


def test_warc_round_trip(spark):
    big = os.urandom(150_000).hex()
    rows = [(1, "http://x/", "é" * 10), (2, None, None), (3, "a\r\nb: c", ""), (7, "u", big), (9, "u", big), (9, "u", big), (None, "n", "é" * 10), (4, "z", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    digest = lambda t: warc.base32_sha1((t or "").encode())
    want = [(1, 20, digest("é" * 10), "response", None), (None, 20, digest("é" * 10), "revisit", 1), (2, 0, digest(""), "revisit", 3), (3, 0, digest(""), "response", None), (4, 4, digest("solo"), "response", None), (7, len(big), digest(big), "revisit", 9), (9, len(big), digest(big), "revisit", 9), (9, len(big), digest(big), "response", None)]
    assert got == sorted(want, key=str)
    assert {r["record_type"] for r in warc.round_trip(pages, least_bytes=1 << 30).collect()} == {"response"}


def test_urls_of_any_length_come_back(spark):
    pages = spark.createDataFrame([(1, "http://a.example/" + "u" * 3_000_000, "page"), (2, "http://b.example/", "page")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, least_bytes=0).collect()}
    assert got == {1: (4, "revisit", 2), 2: (4, "response", None)}
    digest = warc.base32_sha1(b"x")
    raw = warc.record("response", "7", "http://c.example/" + "v" * 3_000_000, b"x", None, digest, 1)
    [(head, size, payload)] = warc.read_records(raw)
    assert (len(head["WARC-Target-URI"]), size, payload) == (3_000_017, 1, b"x")


def test_warc_reader_refuses_damage():
    one = warc.record("response", "1", "http://x/", b"payload", None, warc.base32_sha1(b"payload"), 7)
    assert [(n, p) for _, n, p in warc.read_records(one + warc.SEPARATOR + one)] == [(7, b"payload")] * 2
    with pytest.raises(warc.CutRecord):
        list(warc.read_records(one[:-9]))
    import gzip

    raw = gzip.decompress(one)
    with pytest.raises(warc.BadDigest):
        list(warc.read_records(gzip.compress(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))))
    with pytest.raises(warc.CutRecord):
        list(warc.read_records(gzip.compress(raw[:-1])))


def test_warc_reader_frames_a_large_page_in_steps():
    import tracemalloc

    page = random.Random(3).randbytes(1 << 16) * (300 * 16)  # 300 MB
    one = warc.record("response", "1", "http://x/", memoryview(page), None, warc.base32_sha1(page), len(page))
    tracemalloc.start()
    for raw in (one, memoryview(one)):
        assert [(n, p) for _, n, p in warc.read_records(raw, payloads=False)] == [(len(page), None)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20


def test_warc_files_are_bounded(spark, tmp_path):
    noise = random.Random(5)
    rows = [(i, "u", noise.randbytes(noise.choice([10, 1000, 30_000])).hex()) for i in range(200)] + [(500, "u", noise.randbytes(200_000).hex())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w", file_bytes=100_000)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert len(sizes) > 20 and sizes[-2] <= 100_000 + len(warc.SEPARATOR) and sizes[-1] > 200_000
    got = {int(r["page"]): bytes(r["payload"]).decode() for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert got == {i: t for i, _, t in rows}


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], BENCH)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    ids = spark.createDataFrame([], "_good_id long")
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    results = [
        decontaminate.contamination(none, bench), decontaminate.decontaminate(none, bench), exact_dedup.exact_duplicates(none), mixing.mix_counts(none), mixing.mix_documents(none), langid.predict_language(none, langid.train(none)),
        suffix_dedup.repeated_spans(none), url_reputation.judge_urls(pages, outcomes, RULES), quality.importance_sample(none, ids), warc.round_trip(pages), minhash.near_duplicates(none), line_dedup.drop_boilerplate(none),
    ]
    assert [r.count() for r in results] == [0] * len(results)
