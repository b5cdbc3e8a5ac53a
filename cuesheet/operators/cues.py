"""Spoken cues of a change of topic, by patterns and windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GATE_SECONDS, CLUSTER_SECONDS = 20.0, 15.0


@dataclass(frozen=True)
class CuePatterns:
    """hard opens a topic; gated opens one if a closer came within GATE_SECONDS; closing ends one, so the next line opens."""

    hard: str
    gated: str
    closer: str
    closing: str


#: The patterns for Chinese lectures.
CHINESE = CuePatterns(
    hard="各位同学|接下来(我们|咱们)?来学习|(来|再来)写第[一二三四五六七八九十两0-9]+(个|种)|真正(的)?重点|同学们(我们|咱们)?(一起)?来(思考|想|分析)|就要想了|又该怎么|问题(我们|现在|就)?(是)?(发现|出现)[^，。？?!！]{0,12}(该怎么|怎么|如何)(解决|办)",
    gated="问题来了|该怎么(写|解决|执行|做|理解|去写|去做)|怎么办|到底要(学|怎么|做)",
    closer="这就是[^，。！？!?]{0,16}了|知道了[^，。]{0,12}|弄明白[^，。]{0,8}(以后|了)|学完|讲完|学习完",
    closing="(就|先)学习到(这个)?地方|(就|先)学到(这个)?地方|(就|先)到这里|告一段落|下节课再见",
)


def cue_candidates(lines: DataFrame, patterns: CuePatterns = CHINESE, order: str = "line") -> DataFrame:
    """(video_id, line, time, kind) of lines at which a topic may open, one kind a line.

    Of several kinds the closing of the line before counts first, then hard, then gated. A video's first line never opens.
    """
    w = W.partitionBy("video_id").orderBy(order)
    text = F.col("text")
    closed = F.last(F.when(text.rlike(patterns.closer), F.col("start")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumns({"_closed": closed, "_ended": F.lag(text.rlike(patterns.closing)).over(w), "_first": F.lag("start").over(w).isNull()})
    gated = text.rlike(patterns.gated) & (F.col("start") - F.col("_closed") <= GATE_SECONDS)
    kind = F.when(F.col("_ended"), "CLOSING").when(text.rlike(patterns.hard), "HARD").when(gated, "GATED")
    return rows.withColumn("kind", kind).filter("kind is not null and not _first").select("video_id", order, F.col("start").alias("time"), "kind")


def cluster_last(candidates: DataFrame, order: str = "line", seconds: float = CLUSTER_SECONDS) -> DataFrame:
    """Candidates without those that another follows within ``seconds``: of a chain the last stays."""
    following = F.lead("time").over(W.partitionBy("video_id").orderBy(order))
    return candidates.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") - F.col("time") > seconds)).drop("_next")


def detect_cues(lines: DataFrame, patterns: CuePatterns = CHINESE, order: str = "line") -> DataFrame:
    return cluster_last(cue_candidates(lines, patterns, order), order)
