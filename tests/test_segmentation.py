import random
import statistics

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import cues
from cuesheet.operators import segmentation as s


def lines(spark, items):
    return spark.createDataFrame([("v", i, float(t), float(t) + 3, x) for i, (t, x) in enumerate(items)], "video_id string, line int, start double, end double, text string")


def cue_times(spark, items):
    return sorted(r["time"] for r in cues.detect_cues(lines(spark, items)).collect())


HARD = ["hello，各位同学，我们开始上课。", "各位同学，接下来我们来学习第四种运算符关系运算符。", "我们再来写第二种写法，用字符数组调整。", "好，那么这个时候呢我们就要想了，否则返回什么。", "我又该怎么样去执行这个脚本呢？", "那真正重点的是什么呢？", "同学们我们一起来思考一下这个问题。", "是的呢，那问题我们发现了该怎么解决呢？"]
QUIET = ["在这里呢我已经新建好了一个类。", "那么接下来我们就开始来演示，先定义变量。", "在下面我们可以来输出A和B，右键运行。", "那么下面我们就用等等来进行比较A等于B吗？", "好，那么下面我们开始来写for小括号三个语句。", "那接下来我们来做第二步比较，再拿结果跟第三个比。", "好，那么接下来我们就来分析一下，第一步该做什么。", "好，那么接下来我们就来看一看代码该怎么写。"]


@pytest.mark.parametrize(
    "items, times",
    [
        (list(zip(range(0, 480, 60), HARD)), [60, 120, 180, 240, 300, 360, 420]),
        (list(zip(range(0, 480, 60), QUIET)), []),
        ([(0, "我们先讲点别的内容。"), (100, "好，这就是Lua脚本的一个语法了。"), (105, "那问题来了，我又该怎么样去执行这个脚本呢？")], [105]),
        ([(0, "如果我要做getname，"), (60, "我该怎么做啊，是不是直接调用。")], []),
        ([(0, "前面讲点内容。"), (100, "啊，这就是它这里这个参数的一个概念啊。"), (105, "那新的问题来了，这个key能不能有多个。")], []),
        ([(0, "前面讲点内容。"), (100, "好，这就是Lua脚本的语法了。"), (140, "那问题来了，接下来怎么执行。")], []),
        ([(0, "各位同学，接下来我们来学习第三种运算符赋值运算符。")], []),
        ([(0, "前面讲计算过程。"), (367, "好了，各位同学，"), (374, "各位同学，接下来我们利用3元运算符来写两个小练习。")], [374]),
        ([(0, "今天先到这里"), (50, "好"), (100, "告一段落")], [50]),
    ],
)
def test_cues(spark, items, times):
    assert cue_times(spark, items) == times


def naive_depth(x):
    out = []
    for i in range(len(x)):
        a = b = i
        while a > 0 and x[a - 1] >= x[a]:
            a -= 1
        while b < len(x) - 1 and x[b + 1] >= x[b]:
            b += 1
        out.append(x[a] - x[i] + x[b] - x[i])
    return out


def test_depth_and_threshold_equal_loops(spark):
    rng = random.Random(3)
    series = {k: [rng.randint(0, 4) for _ in range(rng.randint(1, 25))] for k in range(40)}
    df = spark.createDataFrame([(k, i, float(v)) for k, xs in series.items() for i, v in enumerate(xs)], "video_id int, line int, smooth double")
    depth = s.valley_depth(df)
    got = {(r["video_id"], r["line"]): r["depth"] for r in depth.collect()}
    want = {(k, i): d for k, xs in series.items() for i, d in enumerate(naive_depth(xs))}
    assert got == want
    chosen = {(r["video_id"], r["line"]) for r in s.depth_candidates(depth).collect()}
    for k, xs in series.items():
        d = naive_depth(xs)
        t = statistics.fmean(d) + 0.8 * statistics.pstdev(d)
        assert {i for i in range(len(d)) if d[i] >= t + 1e-9} <= {i for v, i in chosen if v == k} <= {i for i in range(len(d)) if d[i] >= t - 1e-9}


def test_smoothing_edges(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 2, 6, 3])], "video_id int, line int, sim double")
    assert [r["smooth"] for r in s.smoothed(df).orderBy("line").collect()] == [1.5, 3.0, 11 / 3, 4.5]


def naive_split(text, least=6):
    pieces, cur = [], ""
    for c in text:
        cur += c
        if c in s.SENTENCE_ENDS:
            pieces.append(cur)
            cur = ""
    pieces += [cur] if cur else []
    if len(pieces) <= 1:
        return [text]
    out, buf = [], ""
    for p in pieces:
        buf += p
        if len(buf) >= least:
            out.append(buf)
            buf = ""
    if buf:
        out = [*out[:-1], out[-1] + buf] if out else [buf]
    return out


def test_sentences(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc，。!? 中") for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["", "。", "一二三四五六"]
    df = spark.createDataFrame([(0, i, 10.0, 20.0, t) for i, t in enumerate(texts)], "video_id int, line int, start double, end double, text string")
    got = {}
    for r in s.split_sentences(df).orderBy("line", "part").collect():
        got.setdefault(r["line"], []).append(r)
    for i, t in enumerate(texts):
        assert [r["text"] for r in got[i]] == naive_split(t)
        assert "".join(r["text"] for r in got[i]) == t
        assert got[i][0]["start"] == 10.0 and (not t or abs(got[i][-1]["end"] - 20.0) < 1e-9)


def test_scans():
    assert s.pause_cuts(1, 900, []) == []
    assert s.pause_cuts(5, 700, []) == [300, 600]
    assert s.pause_cuts(5, 400, [(100, 2), (200, 2), (390, 9)]) == [100]
    assert s.pause_cuts(5, 325, [(29.9, 9), (30, 3)]) == [30]
    assert s.semantic_cuts(500, [20, 100, 110], [], 1) == [100]
    assert s.semantic_cuts(500, [], [(100.0, 2.0), (200.0, 3.0), (310.0, 1.0)], 1.5) == [200]
    assert s.semantic_cuts(700, [], [(t, 0.0) for t in range(20, 700, 20)], 1.0) == [300, 600]
    assert s.semantic_cuts(320, [], [(t, 0.0) for t in range(20, 320, 20)], 1.0) == []
    assert s.chunk_ranges(25, []) == [(0.0, 25)]
    assert s.chunk_ranges(65, []) == [(0.0, 20.0), (20.0, 40.0), (40.0, 65)]
    assert s.chunk_ranges(45, [(7, 9), (29, 31)])[0] == (0.0, 30.0)
    assert s.chunk_ranges(35, [(29, 31)]) == [(0.0, 35)]


def test_chunk_ranges_cover():
    rng = random.Random(5)
    for _ in range(300):
        d = rng.uniform(0.2, 300)
        sil = sorted((a, a + rng.uniform(0.1, 2)) for a in (rng.uniform(0, d) for _ in range(rng.randint(0, 20))))
        r = s.chunk_ranges(d, sil)
        assert r[0][0] == 0 and r[-1][1] == d and all(x[1] == y[0] for x, y in zip(r, r[1:]))
        assert all(8 - 1e-9 <= b - a <= 38 + 1e-9 for a, b in r) or len(r) == 1


def test_build_and_cuts(spark):
    rows = lines(spark, [(0, "a"), (50, "b"), (130, "c"), (140, "d")])
    out = s.build_segments(s.fixed_cuts(rows), spark.createDataFrame([("v", 999.0)], "video_id string, duration double")).orderBy("segment").collect()
    assert [(r["text"], r["start_time"], r["end_time"]) for r in out] == [("ab", 0.0, 53.0), ("cd", 130.0, 999.0)]
    at = s.cuts_at(rows, spark.createDataFrame([("v", 0.0), ("v", 51.0), ("v", 130.0), ("v", 131.0), ("v", 900.0)], "video_id string, time double"))
    assert [r["cut"] for r in at.orderBy("line").collect()] == [False, False, True, True]
    with pytest.raises(ValueError, match="acoustic, fixed, semantic"):
        s.strategy("none")


def test_silence_log(spark):
    log = ["x silence_start: -0.5", "silence_end: 1.5 | silence_duration: 2.0", "noise", "silence_end: 9 | silence_duration: 4"]
    df = spark.createDataFrame([("v", i, t) for i, t in enumerate(log)], "video_id string, line int, text string")
    assert [(r["start"], r["end"]) for r in s.parse_silences(df).orderBy("end").collect()] == [(0.0, 1.5), (5.0, 9.0)]
