import dataclasses
import itertools
import json
import random

import pytest

from cuesheet import plans
from cuesheet.operators.correction import Corrector, correct_lines, edit_distance, edits_within
from cuesheet.operators.latin import SoundMatcher, sound_score
from cuesheet.sources.dictionaries import builtin, han_readings, read_dictionary


@pytest.fixture(scope="module")
def full(spark):
    return dataclasses.replace(builtin(), readings=han_readings(spark))


@pytest.mark.parametrize("text, want", [*((t, "三元运算符") for t in ("三源运算符", "叁元运算符", "3员运算符", "三原运算符")), ("三员表达式", "三元表达式"), ("用三原运算符可以简化这段代码", "用三元运算符可以简化这段代码"), *((t, t) for t in ("三元运算符", "复制一行代码", "重复值为3", "县城的线程池"))])
def test_pinyin(full, text, want):
    assert Corrector(full).correct(text)[0] == want


def test_pinyin_trace(full):
    (trace,) = Corrector(full).correct("三原运算符")[1]
    assert trace[0] == "pinyin" and trace[2] == "三元运算符" and trace[3] > 0.9


POSITIVE = {"Redis": "reice reis raice rease", "false": "foalse forse", "System": "sstem", "Ctrl": "conttrol contrl control", "Lua": "lu luva"}
NEGATIVE = "hello bug student value phone oppo oppos K4 ide2 bugK005 STRA AR SC IDD GPT RV intI inkI forI java false true class case super char while for address alt tamp thide roate newcancanner ro"


def test_sound_alike():
    m = SoundMatcher(builtin())
    for term, heard in POSITIVE.items():
        for h in heard.split():
            assert m.match(h)[0] == term, h
    for h in NEGATIVE.split():
        assert m.match(h) is None, h


@pytest.mark.parametrize("text, want", [("如果前面是foalse", "如果前面是false"), ("conttrol C", "Ctrl C"), ("conttrol V", "Ctrl V"), ("conttrol Ccontrl V", "Ctrl Ctrl V"), ("S Q L", "S Q L"), ("hello world，student 的 name 和 value 都 set 好了",) * 2, ("复制给变量", "赋值给变量"), ("k八s 卡夫卡", "K8s Kafka"), ("redis", "Redis"), ("", "")])
def test_rules(text, want):
    assert Corrector(builtin()).correct(text)[0] == want


def naive_score(a, b):
    """Every alignment within the budget."""
    vowels, best = "aeiouy", None

    def go(i, j, v, k, cost):
        nonlocal best
        if v > 2 or k > 1:
            return
        if i == len(a) and j == len(b):
            best = cost if best is None else min(best, cost)
            return
        for c, di, dj in ((a[i : i + 1], 1, 0), (b[j : j + 1], 0, 1)):
            if c:
                go(i + di, j + dj, v + (c in vowels), k + (c not in vowels), cost + (0.25 if c in vowels else 0.35))
        if i < len(a) and j < len(b):
            x, y = a[i], b[j]
            if x == y:
                go(i + 1, j + 1, v, k, cost)
            elif x in vowels and y in vowels:
                go(i + 1, j + 1, v + 1, k, cost + 0.25)
            elif {x, y} in ({"r", "l"}, {"c", "s"}):
                go(i + 1, j + 1, v, k, cost + 0.4)

    go(0, 0, 0, 0, 0.0)
    return None if best is None else 1 - best / max(len(a), len(b))


def test_score_equals_enumeration():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("aeryslct") for _ in range(rng.randint(1, 6)))
        b = "".join(c for c in a if rng.random() < 0.85) + rng.choice(["", "a", "s"]) or "a"
        got, want = sound_score(a, b), naive_score(a, b)
        assert (got is None) == (want is None) and (got is None or abs(got[0] - want) < 1e-9), (a, b)


def test_edit_distance():
    for a, b in itertools.product(["", "a", "kafka", "kafak", "redis"], repeat=2):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert edit_distance(a, b) == d[-1][-1]


def test_lines_and_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"minAliasLength": 2, "other": 1, "terms": [{"term": "Redis", "confidence": 0.98, "aliases": ["瑞迪斯"]}], "phrases": [{"from": "甲乙", "to": "丙", "confidence": 0.9}]}))
    (tmp_path / "s.json").write_text(json.dumps({"stopwords": ["Hello"], "surface": [{"group": "g", "confidence": 0.9, "terms": ["Lua", {"term": "Ctrl", "spoken": ["control"]}]}]}))
    d = read_dictionary(spark, str(tmp_path / "t.json"), str(tmp_path / "s.json"))
    df = correct_lines(spark.createDataFrame([("瑞迪斯 control 甲乙",), (None,), ("",)], "text string"), d)
    assert [(r["corrected"], r["changed"], len(r["traces"])) for r in df.collect()] == [("Redis Ctrl 丙", True, 3), (None, None, 0), ("", False, 0)]


def test_a_replay_tells_before_traces_and_rules(spark, tmp_path):
    turns = [(1, 0, "瑞迪斯 conttrol C 瑞迪斯"), (1, 1, "三源运算符 redis"), (1, 2, "hello"), (1, 3, None), (2, 0, "复制给变量"), (3, 0, "")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["turn"]): r for r in plans.QUERIES["correction_replay"](spark, str(tmp_path)).collect()}
    assert {k: r["before"] for k, r in got.items()} == {(c, t): x for c, t, x in turns}
    assert [got[k]["corrected"] for k in sorted(got)] == ["Redis Ctrl C Redis", "三元运算符 Redis", "hello", None, "赋值给变量", ""]
    assert [t.rsplit("(", 1)[0] for t in got[1, 0]["traces"]] == ["latin-phonetic:「conttrol」→「Ctrl」", *["alias:「瑞迪斯」→「Redis」"] * 2]
    assert got[1, 1]["traces"] == ["canonical:「redis」→「Redis」(0.98)", "pinyin:「三源运算符」→「三元运算符」(0.92)"] and got[1, 2]["traces"] == []
    names = ("rows_in", "rows_changed", "canonical_traces", "fuzzy_traces", "latin_phonetic_traces", "alias_traces", "phrase_traces", "pinyin_traces")
    assert {tuple(r[n] for n in names) for k, r in got.items() if k[0] == 1} == {(4, 2, 1, 0, 1, 2, 0, 1)}
    assert [[got[k, 0][n] for n in names] for k in (2, 3)] == [[1, 1, 0, 0, 0, 0, 1, 0], [1, 0, 0, 0, 0, 0, 0, 0]]


def test_short_cuts_leave_no_word_out():
    m, rng = SoundMatcher(builtin()), random.Random(3)
    for _ in range(60):
        heard = list(rng.choice(m.targets)[0])
        for _ in range(rng.randint(0, 3)):
            heard[rng.randrange(len(heard))] = rng.choice(["", "a", "r", "l", "s", "c", "tt", "ne"])
            heard = list("".join(heard)) or ["a"]
        heard = "".join(heard)
        assert {k for k, (target, _, _) in enumerate(m.targets) if sound_score(heard, target)} <= set(m._near(heard)), heard
    for a, b in itertools.product(["", "a", "kafka", "kafak", "akfka", "redis", "rediss", "edis", "aaa", "aa"], repeat=2):
        d = edit_distance(a, b)
        assert [edits_within(a, b, most) for most in range(4)] == [d if d <= most else None for most in range(4)], (a, b)
