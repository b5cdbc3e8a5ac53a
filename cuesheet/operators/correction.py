"""Correction of transcripts: Latin tokens (spelling, edit distance, sound), aliases, phrases, then sounds of Han characters.

The rules chain within a text, so they run together in one Arrow-batched UDF; a worker keeps what it found for a token.
Rules that stand alone are columns (``fuzzy_terms``, ``replaced``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..sources.dictionaries import Dictionary, Term
from .latin import SoundMatcher

#: Fixed value: what counts as a Latin token.
TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z0-9](?![A-Za-z0-9]))*")
TERMS_BYTES = 8 << 20
#: Tokens that a corrector remembers at most.
KNOWN = 50_000
FUZZY, FUZZY_LENGTH, PINYIN_FACTOR, MOST_FORMS = 0.85, 4, 0.95, 8
#: Readings of the digits 0 to 9.
DIGITS = "ling yi er san si wu liu qi ba jiu".split()
RULES = ("canonical", "fuzzy", "latin-phonetic", "alias", "phrase", "pinyin")
RESULT = "corrected string, traces array<struct<rule:string,before:string,term:string,confidence:double>>"
Trace = tuple[str, str, str, float]


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edits_within(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most ``most``, else None."""
    if abs(len(a) - len(b)) > most:
        return None
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b, k = a[k:], b[k:], 0
    while k < len(a) and k < len(b) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    d = longer if (longer := max(len(a), len(b))) <= 1 else edit_distance(a, b) if most > 1 else 2
    return d if d <= most else None


class Corrector:
    def __init__(self, d: Dictionary):
        self.d, self.sounds = d, SoundMatcher(d)
        self.known: dict[str, tuple[str, Trace | None]] = {}
        self.spelling = {}
        for t in d.terms:
            self.spelling.setdefault(t.term.lower(), t)
        self.latin = [t for t in d.terms if re.fullmatch("[A-Za-z0-9]+", t.term)]
        self.by_length: dict[int, list[tuple[Term, int]]] = {}
        aliases = [(a, t.term, t.confidence) for t in d.terms for a in t.aliases if len(a) >= d.min_alias]
        self.aliases = sorted(aliases, key=lambda x: -len(x[0]))
        self.by_sound = {form: t for t in d.terms for form in self._forms(t.term)}
        self.lengths = sorted({len(t.term) for t in self.by_sound.values()}, reverse=True)

    def _term(self, token: str) -> tuple[str, Trace | None]:
        """What a token becomes; up to KNOWN tokens are remembered by the corrector, and go with it."""
        if (known := self.known.get(token)) is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            known = self.known[token] = self._find(token)
        return known

    def _find(self, token: str) -> tuple[str, Trace | None]:
        bare = re.sub(r"\s+", "", token)
        if known := self.spelling.get(bare.lower()):
            return known.term, None if bare == known.term else ("canonical", token, known.term, known.confidence)
        if len(bare) >= FUZZY_LENGTH and (near := self._similar(bare.lower())):
            top, t = near
            return t.term, ("fuzzy", token, t.term, t.confidence * top)
        if hit := self.sounds.match(bare):
            return hit[0], ("latin-phonetic", token, hit[0], hit[2] * hit[1])
        return token, None

    def _similar(self, low: str) -> tuple[float, Term] | None:
        """The similarity to the most similar Latin term, the first of equals, from FUZZY on; words that are a term were found by their spelling."""
        n, best = len(low), None
        if n not in self.by_length:
            self.by_length[n] = [(t, most) for t in self.latin if abs(n - len(t.term)) <= (most := int((1 - FUZZY) * max(n, len(t.term)) + 1e-9)) and most]
        for t, most in self.by_length[n]:
            if (edits := edits_within(low, t.term.lower(), most)) is not None:
                sim = 1 - edits / max(n, len(t.term))
                if sim >= FUZZY and (best is None or sim > best[0]):
                    best = sim, t
        return best

    def _token(self, token: str, traces: list[Trace]) -> str:
        head, space, tail = token.partition(" ")
        if space:
            word, trace = self._term(head)
            if word != head:
                traces += [trace] if trace else []
                return word + space + tail
        word, trace = self._term(token)
        traces += [trace] if trace else []
        return word

    def _forms(self, text: str) -> set[str]:
        """The readings of a text of Han characters and digits; none for other or short texts, or where they are too many."""
        if len(text) < self.d.min_pinyin:
            return set()
        forms = {""}
        for c in text:
            sounds = (DIGITS[int(c)],) if "0" <= c <= "9" else self.d.readings.get(c, ())
            forms = {f + s for f in forms for s in sounds}
            if not 0 < len(forms) <= MOST_FORMS:
                return set()
        return forms

    def _by_sound(self, text: str, traces: list[Trace]) -> str:
        out, i = [], 0
        while i < len(text):
            for n in self.lengths:
                window = text[i : i + n]
                term = next((t for f in self._forms(window) if (t := self.by_sound.get(f))), None) if len(window) == n else None
                if term and term.term != window:
                    out.append(term.term)
                    traces.append(("pinyin", window, term.term, term.confidence * PINYIN_FACTOR))
                    i += n
                    break
            else:
                out.append(text[i])
                i += 1
        return "".join(out)

    def correct(self, text: str) -> tuple[str, list[Trace]]:
        traces: list[Trace] = []
        text = TOKEN.sub(lambda m: self._token(m[0], traces), text)
        phrases = [("phrase", p.wrong, p.right, p.confidence) for p in self.d.phrases if len(p.wrong) >= self.d.min_alias]
        for rule, wrong, right, confidence in [("alias", *a) for a in self.aliases] + phrases:
            if n := text.count(wrong):
                traces += [(rule, wrong, right, confidence)] * n
                text = text.replace(wrong, right)
        if self.lengths and re.search("[一-鿿]", text):
            text = self._by_sound(text, traces)
        return text, traces


def correct_lines(lines: DataFrame, dictionary: Dictionary, text_col: str = "text") -> DataFrame:
    """lines with ``corrected``, ``traces`` and ``changed``; null stays null."""

    @F.pandas_udf(RESULT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        corrector = Corrector(dictionary)
        for part in parts:
            results = [(None, []) if t is None else corrector.correct(t) for t in part]
            yield pd.DataFrame({"corrected": [r[0] for r in results], "traces": [[dict(zip(("rule", "before", "term", "confidence"), t)) for t in r[1]] for r in results]})

    done = lines.withColumn("_r", run(F.col(text_col)))
    return done.select(*lines.columns, "_r.corrected", "_r.traces", (F.col("_r.corrected") != F.col(text_col)).alias("changed"))


def told_traces(traces: Column) -> Column:
    """traces as texts: rule, what was written, the term that it became, and the confidence."""
    return F.transform(traces, lambda t: F.format_string("%s:「%s」→「%s」(%.2f)", t["rule"], t["before"], t["term"], t["confidence"]))


def with_totals(corrected: DataFrame, by: str) -> DataFrame:
    """Rows of ``correct_lines`` with totals of all rows of the same ``by``: rows_in, rows_changed and, of changed rows, the traces of each of RULES."""
    w, changed = W.partitionBy(by), F.coalesce("changed", F.lit(False))

    def total(rule: str) -> Column:
        return F.sum(F.when(changed, F.size(F.filter("traces.rule", lambda r: r == rule))).otherwise(0)).over(w)

    totals = {f"{rule.replace('-', '_')}_traces": total(rule) for rule in RULES}
    return corrected.withColumns({"rows_in": F.count(F.lit(1)).over(w), "rows_changed": F.sum(changed.cast("long")).over(w)} | totals)


def trace_counts(corrected: DataFrame) -> DataFrame:
    return corrected.select(F.explode("traces.rule").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _blocks(terms: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """terms in blocks of at most TERMS_BYTES each, one block at least."""
    out, size = [[]], 0
    for place, term in terms:
        if size + len(term) + 32 > TERMS_BYTES and out[-1]:
            out.append([])
            size = 0
        out[-1].append((place, term))
        size += len(term) + 32
    return out


def fuzzy_terms(tokens: DataFrame, dictionary: Dictionary, threshold: float = FUZZY) -> DataFrame:
    """(token, term, sim) of tokens (token) near to a Latin term: the edit-distance rule alone, the term first in the dictionary on ties. Terms are broadcast in blocks."""
    spark = tokens.sparkSession
    latin = [(i, t.term) for i, t in enumerate(dictionary.terms) if re.fullmatch("[A-Za-z0-9]+", t.term)]
    words, near = tokens.select("token").distinct().filter(F.length("token") >= FUZZY_LENGTH), None
    for block in _blocks(latin):
        terms = F.broadcast(spark.createDataFrame(block, "place int, term string"))
        part = words.crossJoin(terms).withColumn("sim", similarity(F.lower("token"), F.lower("term"))).filter(F.col("sim") >= threshold)
        near = part if near is None else near.unionByName(part)
    best = near.groupBy("token").agg(F.max(F.struct("sim", (-F.col("place")).alias("first"), "term")).alias("b"))
    return best.select("token", "b.term", "b.sim")


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """text with each of the pairs replaced in turn: the alias and phrase rules alone."""
    for wrong, right in pairs:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def alias_pairs(dictionary: Dictionary) -> list[tuple[str, str]]:
    """Aliases, longest first, then phrases."""
    c = Corrector(dictionary)
    return [(a, t) for a, t, _ in c.aliases] + [(p.wrong, p.right) for p in dictionary.phrases]
