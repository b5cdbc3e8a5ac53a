"""Dictionaries of terms: built in, or read from JSON files of the same shape.

Terms file: {minAliasLength, minPinyinLength, phrases: [{from, to, confidence}], terms: [{term, confidence, aliases}]}.
Surface file: {minTokenLength, threshold, shortTokenThreshold, margin, stopwords, surface: [{group, confidence, terms}]}, where
a term is a word or {term, spoken}. Unknown fields are ignored. Files are small and read by Spark, so any store will do.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Term:
    term: str
    confidence: float
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Phrase:
    wrong: str
    right: str
    confidence: float


@dataclass(frozen=True)
class Surface:
    """A correct word, and ways in which it is spoken."""

    term: str
    confidence: float
    spoken: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dictionary:
    terms: tuple[Term, ...] = ()
    phrases: tuple[Phrase, ...] = ()
    surface: tuple[Surface, ...] = ()
    stopwords: frozenset[str] = frozenset()
    min_alias: int = 2
    min_pinyin: int = 3
    min_token: int = 2
    threshold: float = 0.75
    short_threshold: float = 0.9
    margin: float = 0.05
    readings: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)


# Terms, their confidence and the ways in which they are misheard.
TERMS = (
    Term("三元运算符", 0.97),
    Term("三元表达式", 0.95),
    Term("Redis", 0.98, ("瑞迪斯", "热地斯", "瑞迪思", "瑞迪兹")),
    Term("Kafka", 0.97, ("卡夫卡", "卡夫咔", "卡芙卡")),
    Term("Docker", 0.95, ("多克尔", "道克", "码头工人")),
    Term("Kubernetes", 0.95, ("库伯奈特斯", "库伯内特斯", "库伯奈提斯")),
    Term("K8s", 0.95, ("k八s", "k八S")),
    Term("MySQL", 0.97, ("我的S Q L", "我的SQL", "买S Q L", "买SQL", "密速尔")),
    Term("Nginx", 0.95, ("引擎x", "恩金克斯", "恩静x")),
    Term("RocketMQ", 0.96, ("火箭MQ", "若克特MQ", "洛克特MQ")),
    Term("RabbitMQ", 0.95, ("兔子MQ", "拉比特MQ")),
    Term("SpringBoot", 0.92, ("斯普林布特", "弹簧靴")),
    Term("Spring", 0.90, ("斯普林",)),
    Term("MyBatis", 0.92, ("麦巴蒂斯", "麦巴提斯", "米巴蒂斯")),
    Term("PostgreSQL", 0.95, ("博士后S Q L", "postgres S Q L")),
    Term("MongoDB", 0.95, ("芒果DB", "蒙戈DB", "忙够DB")),
    Term("Elasticsearch", 0.90, ("弹性搜索", "伊拉斯蒂克搜索")),
    Term("RDB", 0.96, ("R D B", "啊弟比")),
    Term("AOF", 0.96, ("A O F", "啊欧艾弗")),
    Term("JVM", 0.95, ("J V M", "吉维艾姆")),
    Term("API", 0.90, ("A P I", "艾皮艾")),
    Term("HTTP", 0.90, ("H T T P",)),
    Term("JSON", 0.90, ("J S O N", "杰森")),
    Term("JWT", 0.92, ("J W T", "吉维提")),
    Term("TCP", 0.90, ("T C P",)),
    Term("Linux", 0.92, ("里努克斯", "林尼克斯", "李纽克斯")),
    Term("GitHub", 0.90, ("吉特哈布", "吉特Hub")),
    Term("ZooKeeper", 0.92, ("祖基帕", "动物园管理员")),
    Term("Nacos", 0.95, ("纳科斯", "那科斯")),
    Term("Sentinel", 0.90, ("森缇诺", "圣天诺")),
    Term("Feign", 0.90, ("费恩", "费因")),
    Term("MinIO", 0.95, ("迷你欧", "米尼奥")),
    Term("pgvector", 0.95, ("p g向量", "pg向量")),
    Term("LangChain4j", 0.95, ("语言链4j", "langchain for j")),
)

# Phrases.
PHRASES = (
    Phrase("复制给一个变量", "赋值给一个变量", 0.93),
    Phrase("复制给变量", "赋值给变量", 0.93),
    Phrase("赋制给", "赋值给", 0.93),
    Phrase("复值给", "赋值给", 0.93),
)

# Correct Latin words and their confidence.
SURFACE = (
    Surface("abstract", 0.97),
    Surface("assert", 0.97),
    Surface("boolean", 0.97),
    Surface("break", 0.97),
    Surface("byte", 0.97),
    Surface("case", 0.97),
    Surface("catch", 0.97),
    Surface("char", 0.97),
    Surface("class", 0.97),
    Surface("continue", 0.97),
    Surface("default", 0.97),
    Surface("do", 0.97),
    Surface("double", 0.97),
    Surface("else", 0.97),
    Surface("enum", 0.97),
    Surface("extends", 0.97),
    Surface("final", 0.97),
    Surface("finally", 0.97),
    Surface("float", 0.97),
    Surface("for", 0.97),
    Surface("if", 0.97),
    Surface("implements", 0.97),
    Surface("import", 0.97),
    Surface("instanceof", 0.97),
    Surface("int", 0.97),
    Surface("interface", 0.97),
    Surface("long", 0.97),
    Surface("native", 0.97),
    Surface("new", 0.97),
    Surface("package", 0.97),
    Surface("private", 0.97),
    Surface("protected", 0.97),
    Surface("public", 0.97),
    Surface("return", 0.97),
    Surface("short", 0.97),
    Surface("static", 0.97),
    Surface("strictfp", 0.97),
    Surface("super", 0.97),
    Surface("switch", 0.97),
    Surface("synchronized", 0.97),
    Surface("this", 0.97),
    Surface("throw", 0.97),
    Surface("throws", 0.97),
    Surface("transient", 0.97),
    Surface("try", 0.97),
    Surface("void", 0.97),
    Surface("volatile", 0.97),
    Surface("while", 0.97),
    Surface("true", 0.97),
    Surface("false", 0.97),
    Surface("null", 0.97),
    Surface("var", 0.97),
    Surface("yield", 0.97),
    Surface("record", 0.97),
    Surface("sealed", 0.97),
    Surface("permits", 0.97),
    Surface("String", 0.95),
    Surface("System", 0.95),
    Surface("Scanner", 0.95),
    Surface("Math", 0.95),
    Surface("Object", 0.95),
    Surface("Integer", 0.95),
    Surface("Long", 0.95),
    Surface("Double", 0.95),
    Surface("Float", 0.95),
    Surface("Boolean", 0.95),
    Surface("Character", 0.95),
    Surface("Byte", 0.95),
    Surface("Short", 0.95),
    Surface("Number", 0.95),
    Surface("Thread", 0.95),
    Surface("Runnable", 0.95),
    Surface("Exception", 0.95),
    Surface("RuntimeException", 0.95),
    Surface("Throwable", 0.95),
    Surface("Error", 0.95),
    Surface("Class", 0.95),
    Surface("StringBuffer", 0.95),
    Surface("StringBuilder", 0.95),
    Surface("Comparable", 0.95),
    Surface("Comparator", 0.95),
    Surface("Iterable", 0.95),
    Surface("Collection", 0.95),
    Surface("List", 0.95),
    Surface("ArrayList", 0.95),
    Surface("Map", 0.95),
    Surface("HashMap", 0.95),
    Surface("LinkedHashMap", 0.95),
    Surface("TreeMap", 0.95),
    Surface("Set", 0.95),
    Surface("HashSet", 0.95),
    Surface("TreeSet", 0.95),
    Surface("Queue", 0.95),
    Surface("Deque", 0.95),
    Surface("LinkedList", 0.95),
    Surface("Iterator", 0.95),
    Surface("Optional", 0.95),
    Surface("Stream", 0.95),
    Surface("Collectors", 0.95),
    Surface("Collections", 0.95),
    Surface("Arrays", 0.95),
    Surface("Objects", 0.95),
    Surface("PrintStream", 0.95),
    Surface("InputStream", 0.95),
    Surface("OutputStream", 0.95),
    Surface("BufferedReader", 0.95),
    Surface("InputStreamReader", 0.95),
    Surface("File", 0.95),
    Surface("FileReader", 0.95),
    Surface("FileWriter", 0.95),
    Surface("Random", 0.95),
    Surface("BigInteger", 0.95),
    Surface("BigDecimal", 0.95),
    Surface("LocalDate", 0.95),
    Surface("LocalTime", 0.95),
    Surface("LocalDateTime", 0.95),
    Surface("DateTimeFormatter", 0.95),
    Surface("Duration", 0.95),
    Surface("Period", 0.95),
    Surface("Instant", 0.95),
    Surface("Function", 0.95),
    Surface("Predicate", 0.95),
    Surface("Consumer", 0.95),
    Surface("Supplier", 0.95),
    Surface("Files", 0.95),
    Surface("Path", 0.95),
    Surface("Paths", 0.95),
    Surface("println", 0.90),
    Surface("printf", 0.90),
    Surface("print", 0.90),
    Surface("nextInt", 0.90),
    Surface("nextLine", 0.90),
    Surface("nextDouble", 0.90),
    Surface("nextBoolean", 0.90),
    Surface("parseInt", 0.90),
    Surface("indexOf", 0.90),
    Surface("toString", 0.90),
    Surface("hashCode", 0.90),
    Surface("valueOf", 0.90),
    Surface("substring", 0.90),
    Surface("startsWith", 0.90),
    Surface("endsWith", 0.90),
    Surface("charAt", 0.90),
    Surface("compareTo", 0.90),
    Surface("getClass", 0.90),
    Surface("notifyAll", 0.90),
    Surface("getName", 0.90),
    Surface("setName", 0.90),
    Surface("forName", 0.90),
    Surface("equals", 0.90),
    Surface("isEmpty", 0.90),
    Surface("keySet", 0.90),
    Surface("entrySet", 0.90),
    Surface("next", 0.90),
    Surface("Ctrl", 0.96, ("control",)),
    Surface("Lua", 0.96),
    Surface("Java", 0.96),
    Surface("Spring", 0.96),
)

# Words that are never corrected.
STOPWORDS = frozenset({
    "hello", "world", "yeah", "gpt", "gpt6", "gbt6", "bug", "name", "set", "get", "student", "person", "teacher", "teach",
    "coder", "number", "value", "key", "call", "phone", "sleep", "address", "gender", "fashion", "girl", "stop", "open",
    "raise", "rose", "sub", "local", "operator", "script", "max", "alt", "word", "first", "it", "to", "and", "my", "end", "ok",
    "aok", "co", "te", "ki", "ev", "wa", "ra", "re", "st", "ht", "gro", "oppo", "oppos", "ra", "in", "on", "at", "as", "so",
    "we", "he", "me", "us", "am", "an", "or", "no", "go", "up", "is", "be", "by", "te",
})


def builtin() -> Dictionary:
    return Dictionary(TERMS, PHRASES, SURFACE, STOPWORDS)


def _json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_dictionary(spark: SparkSession, terms_path: str, surface_path: str | None = None) -> Dictionary:
    """A dictionary from JSON files."""
    raw = _json(spark, terms_path)
    terms = tuple(Term(t["term"], float(t["confidence"]), tuple(t.get("aliases") or ())) for t in raw.get("terms") or ())
    phrases = tuple(Phrase(p["from"], p["to"], float(p["confidence"])) for p in raw.get("phrases") or () if p.get("from") and p.get("to"))
    more: dict = {"min_alias": raw.get("minAliasLength", 2), "min_pinyin": raw.get("minPinyinLength") or 3}
    if surface_path:
        top = _json(spark, surface_path)
        words = []
        for group in top.get("surface") or ():
            for t in group["terms"]:
                words.append(Surface(t, group.get("confidence", 0.9)) if isinstance(t, str) else Surface(t["term"], group.get("confidence", 0.9), tuple(t.get("spoken") or ())))
        more |= {"surface": tuple(words), "stopwords": frozenset(s.lower() for s in top.get("stopwords") or ()), "min_token": top.get("minTokenLength", 2), "threshold": top.get("threshold", 0.76), "short_threshold": top.get("shortTokenThreshold", 0.9), "margin": top.get("margin", 0.05)}
    return Dictionary(terms, phrases, **more)


#: Characters with several toneless readings.
POLYPHONES = {
    "了": ("le", "liao"), "会": ("hui", "kuai"), "传": ("chuan", "zhuan"), "便": ("bian", "pian"), "单": ("dan", "shan", "chan"),
    "参": ("can", "shen", "cen"), "叶": ("ye", "xie"), "合": ("he", "ge"), "吓": ("xia", "he"),
    "和": ("he", "huo", "hu"), "大": ("da", "dai"), "女": ("nv", "ru"), "宿": ("su", "xiu"), "射": ("she", "ye"),
    "尺": ("chi", "che"), "差": ("cha", "chai", "ci"), "弹": ("dan", "tan"), "强": ("qiang", "jiang"),
    "得": ("de", "dei"), "恶": ("e", "wu"), "折": ("zhe", "she"), "提": ("ti", "di"),
    "数": ("shu", "shuo"), "曾": ("ceng", "zeng"), "朝": ("chao", "zhao"), "校": ("xiao", "jiao"), "模": ("mo", "mu"),
    "率": ("lv", "shuai"), "盛": ("sheng", "cheng"), "省": ("sheng", "xing"), "着": ("zhe", "zhuo", "zhao"), "石": ("shi", "dan"),
    "系": ("xi", "ji"), "给": ("gei", "ji"), "血": ("xue", "xie"), "行": ("xing", "hang"), "觉": ("jue", "jiao"),
    "角": ("jiao", "jue"), "解": ("jie", "xie"), "说": ("shuo", "shui"), "调": ("diao", "tiao"), "车": ("che", "ju"),
    "还": ("hai", "huan"), "都": ("dou", "du"), "重": ("zhong", "chong"), "长": ("chang", "zhang"), "降": ("jiang", "xiang"),
    "乐": ("le", "yue"), "什": ("shen", "shi"), "仇": ("chou", "qiu"), "地": ("di", "de"), "壳": ("ke", "qiao"),
    "没": ("mei", "mo"), "的": ("de", "di"), "藏": ("cang", "zang"), "识": ("shi", "zhi"), "轧": ("ya", "zha", "ga"),
}


def han_readings(spark: SparkSession) -> dict[str, tuple[str, ...]]:
    """The toneless readings of each Han character U+4E00 to U+9FFF (ü as v), from the ICU library that comes with Spark.

    ICU knows one reading a character; common characters with several have those of POLYPHONES too.
    """
    import unicodedata

    to_latin = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin")
    chars = [chr(c) for c in range(0x4E00, 0xA000)]
    out: dict[str, tuple[str, ...]] = {}
    for k in range(0, len(chars), 2048):
        part = chars[k : k + 2048]
        for char, reading in zip(part, to_latin.transliterate("\n".join(part)).split("\n")):
            bare = "".join(c for c in unicodedata.normalize("NFD", reading.strip().replace("ü", "v")) if not unicodedata.combining(c))
            bare = "".join("v" if c in "ǖǘǚǜ" else c for c in bare)
            if bare.isascii() and bare.isalpha():
                out[char] = tuple(dict.fromkeys([bare.lower(), *POLYPHONES.get(char, ())]))
    return out
