"""Correction queries over the words and texts of documents and conversations, and over Chinese lines."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import correction as c
from ..sources.dictionaries import builtin, han_readings
from ..sources.tables import load
from . import query

TERMS = [(i, t.term) for i, t in enumerate(builtin().terms) if t.term.isascii()]
_NAMES = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in TERMS) + ") AS t(place, term))"
#: Terms as they are misheard, by dropping and doubling letters: (heard).
HEARD = "Redis Rediss Kafkka Kubernets Kuberneets Elasticsearc Elasticsarch PostgreSQ Postgresql MongDB ZooKeper RabbitM RocketQ Sentinl MyBatiss GitHb"
_HEARD = "(SELECT unnest(string_split('" + HEARD + "', ' ')) AS token UNION SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) FROM conversations)"
LINES = (
    "三源运算符", "叁元运算符", "3员运算符", "三原运算符", "三员表达式", "用三原运算符可以简化这段代码", "三元运算符", "复制一行代码", "重复值为3", "县城的线程池",
    "如果前面是foalse", "conttrol C", "conttrol Ccontrl V", "S Q L", "hello world，student 的 name 和 value 都 set 好了", "把 reice 和瑞迪斯 都复制给变量", "卡夫卡 kafka Kubernets",
)


CORRECTED = (
    "三元运算符", "三元运算符", "三元运算符", "三元运算符", "三元表达式", "用三元运算符可以简化这段代码", "三元运算符", "复制一行代码", "重复值为3", "县城的线程池",
    "如果前面是false", "Ctrl C", "Ctrl Ctrl V", "S Q L", "hello world，student 的 name 和 value 都 set 好了", "把 Redis 和Redis 都赋值给变量", "Kafka Kafka Kubernetes",
)
RULES = {0: ["pinyin"], 1: ["pinyin"], 2: ["pinyin"], 3: ["pinyin"], 4: ["pinyin"], 5: ["pinyin"], 10: ["latin-phonetic"], 11: ["latin-phonetic"], 12: ["latin-phonetic"] * 2, 15: ["latin-phonetic", "alias", "phrase"], 16: ["alias", "canonical", "fuzzy"]}
SAID = f"said AS (SELECT conv_id, turn, (conv_id + turn) % {len(LINES)} AS k FROM conversations)"


def lines(spark, sf_dir):
    """A misheard line in the place of every turn: (conv_id, turn, text)."""
    text = F.element_at(F.array(*(F.lit(x) for x in LINES)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(LINES))) + 1).cast("int"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def full_dictionary(spark):
    return dataclasses.replace(builtin(), readings=han_readings(spark))


@query(f"WITH {_NAMES}, tokens AS {_HEARD}, s AS (SELECT token, place, term, 1 - levenshtein(lower(token), lower(term)) / greatest(length(token), length(term)) AS sim FROM tokens, terms WHERE length(token) >= 4) SELECT token, arg_max(term, (sim, -place)) AS term, round(max(sim), 6) AS sim FROM s WHERE sim >= 0.85 GROUP BY token")
def latin_fuzzy(spark, sf_dir):
    words = load(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token"))
    heard = spark.createDataFrame([(w,) for w in HEARD.split()], "token string")
    return c.fuzzy_terms(words.unionByName(heard), builtin()).withColumn("sim", F.round("sim", 6))


_PAIRS = [("thst", "first"), ("tion the", "TION THE"), ("éau", "eau"), ("ung", "UNG")]


@query("SELECT doc_id, md5(replace(replace(replace(replace(text, 'thst', 'first'), 'tion the', 'TION THE'), 'éau', 'eau'), 'ung', 'UNG')) AS text_md5 FROM documents")
def alias_phrase_replace(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(c.replaced(F.col("text"), _PAIRS)).alias("text_md5"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '<\|[A-Z_]+\|>', '', 'g'), '\s+', ' ', 'g'), ' ')) AS text_md5 FROM documents")
def asr_clean(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(x.asr_clean(F.col("text"))).alias("text_md5"))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents), s AS (SELECT word, string_split(word, '') AS c FROM w) SELECT word, array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[greatest(i - 1, 1)] OR contains('aeiouy', x)), '') AS folded FROM s")
def consonant_fold(spark, sf_dir):
    words = load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", x.fold_consonants(F.col("word")).alias("folded"))


@query()
def latin_phonetic(spark, sf_dir):
    """Sound-alike matching of every distinct Latin word of conversations and of misheard words."""
    words = load(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token"))
    heard = spark.createDataFrame([(w,) for w in "reice raice rease foalse forse sstem conttrol contrl control lu luva hello java".split()], "token string")
    return c.correct_lines(words.unionByName(heard).distinct(), builtin(), "token").select("token", "corrected", "changed")


@query(f"WITH {SAID}, c AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(CORRECTED)) + ") AS t(k, corrected)) SELECT conv_id, turn, corrected FROM said JOIN c USING (k)")
def pinyin_correct(spark, sf_dir):
    return c.correct_lines(lines(spark, sf_dir), full_dictionary(spark)).select("conv_id", "turn", "corrected")


@query(f"WITH {SAID}, r AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, xs in RULES.items() for x in xs) + ") AS t(k, rule)) SELECT rule, count(*) AS n FROM said JOIN r USING (k) GROUP BY rule")
def correction_traces(spark, sf_dir):
    return c.trace_counts(c.correct_lines(lines(spark, sf_dir), full_dictionary(spark)))


@query()
def correction_replay(spark, sf_dir):
    """All rules over every turn: before, after and the traces; and of all turns of its conversation how many there are, how many changed, and by which rules."""
    out = c.with_totals(c.correct_lines(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), full_dictionary(spark)), "conv_id")
    return out.withColumns({"n_traces": F.size("traces"), "corrected_md5": F.md5("corrected"), "traces": c.told_traces(F.col("traces"))}).withColumnRenamed("text", "before")
