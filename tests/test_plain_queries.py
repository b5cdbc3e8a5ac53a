"""Queries that have no SQL, over their whole tables, against plain Python."""

import hashlib
import re
import statistics

import pytest
from test_correction import naive_score
from test_segmentation import naive_depth, naive_split

from cuesheet import plans
from cuesheet.operators.correction import Corrector
from cuesheet.plans import segmentations
from cuesheet.sources.dictionaries import builtin
from cuesheet.sources.tables import load
from cuesheet.sources.tables import lines as timed_lines


def test_every_query_is_tested():
    here = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert set(plans.QUERIES) - set(plans.ORACLES) <= here


def sentences(text, start, end):
    out, at = [], 0
    for part in naive_split(text):
        share = lambda n: start + (end - start) * n / max(len(text), 1)
        out.append((share(at), share(at + len(part)), part))
        at += len(part)
    return out


def test_sentence_split(spark, sf_dir):
    got = {(r["video_id"], r["line"], r["part"]): (round(r["start"], 6), round(r["end"], 6), r["text"]) for r in plans.QUERIES["sentence_split"](spark, sf_dir).collect()}
    rows = timed_lines(spark, sf_dir).collect()
    want = {(r["video_id"], r["line"], k): (round(a, 6), round(b, 6), t) for r in rows for k, (a, b, t) in enumerate(sentences(r["text"], r["start"], r["end"]))}
    assert got == want


def plain_cues(items, p):
    """Times at which a topic opens, of sentences (start, end, text)."""
    found, closed = [], None
    for i, (t, _, text) in enumerate(items):
        if re.search(p.closer, text):
            closed = t
        if not i:
            continue
        if re.search(p.closing, items[i - 1][2]) or re.search(p.hard, text) or (re.search(p.gated, text) and closed is not None and t - closed <= 20):
            found.append(t)
    return [t for t, after in zip(found, [*found[1:], None]) if after is None or after - t > 15]


def plain_topics(blocks, p):
    """Segments (start, end, text) of blocks (start, end, text, vector)."""
    duration = blocks[-1][1]
    items = [x for start, end, text, _ in blocks for x in sentences(text, start, end)]
    cuts = []
    if len(blocks) > 1:
        cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
        sim = [cos(a[3], b[3]) for a, b in zip(blocks, blocks[1:])]
        smooth = [statistics.fmean(sim[max(i - 1, 0) : i + 2]) for i in range(len(sim))]
        depth = naive_depth(smooth)
        least = statistics.fmean(depth) + 0.8 * statistics.pstdev(depth)
        marks = sorted([(t, 0, 0.0) for t in plain_cues(items, p)] + [(b[0], 1, d) for b, d in zip(blocks[1:], depth)])
        at, best = 0.0, None
        for t, kind, d in marks:
            if not kind and t - at >= 30:
                cuts.append(t)
                at, best = t, None
            else:
                if kind and t - at >= 30 and d >= least and (best is None or d > best[1]):
                    best = (t, d)
                if t - at >= 300:
                    near = [x for x, _, _ in marks if at + 30 < x <= t]
                    cut = best[0] if best else min(near, key=lambda x: abs(x - at - 300))
                    cuts.append(cut)
                    at, best = cut, None
        if cuts and duration - cuts[-1] < 30:
            cuts.pop()
    starts = [x[0] for x in items]
    places = sorted({k for c in cuts for k in [sum(s < c for s in starts)] if 0 < k < len(items)})
    out = []
    for a, b in zip([0, *places], [*places, len(items)]):
        out.append((items[a][0], max(items[b - 1][1], duration) if b == len(items) else items[b - 1][1], "".join(x[2] for x in items[a:b])))
    return out


def test_semantic_strategy(spark, sf_dir):
    got = {}
    for r in plans.QUERIES["semantic_strategy"](spark, sf_dir).orderBy("video_id", "segment").collect():
        got.setdefault(r["video_id"], []).append((pytest.approx(r["start_time"], abs=0.011), pytest.approx(r["end_time"], abs=0.011), r["text_md5"]))
    blocks = {}
    for r in segmentations.blocks(spark, sf_dir).orderBy("video_id", "line").collect():
        blocks.setdefault(r["video_id"], []).append((r["start"], r["end"], r["text"], r["embedding"]))
    want = {v: [(a, b, hashlib.md5(t.encode()).hexdigest()) for a, b, t in plain_topics(rows, segmentations.STAND_IN)] for v, rows in blocks.items()}
    assert want == got and sum(map(len, got.values())) > 100


def plain_pairs(rows):
    """{place: place} both ways, of tracks (place, name, duration, has_video, has_audio, error)."""
    ok = [r for r in rows if not r[5] and r[2] > 0]
    sounds, out = [r for r in ok if r[4] and not r[3]], {}
    stem = lambda name: name.rsplit(".", 1)[0].lower()

    def like(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n / max(len(a), len(b))

    for v in sorted((r for r in ok if r[3] and not r[4]), key=lambda r: -r[2]):
        near = [(abs(v[2] - a[2]) / max(v[2], a[2]), -like(stem(v[1]), stem(a[1])), k) for k, a in enumerate(sounds)]
        near = [x for x in near if x[0] <= 0.1]
        if near:
            least = min(near)[0]
            k = min((x for x in near if x[0] - least <= 1e-9), key=lambda x: (x[1], x[2]))[2]
            a = sounds.pop(k)
            out[v[0]], out[a[0]] = a[0], v[0]
    return out


def tracks(spark, sf_dir, broken=False):
    out = {}
    for r in load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity").collect():
        name = f"{r[2]}{r[3]}{r[1]}.m4s"
        out.setdefault(r[0], []).append((r[1], name, r[4], r[1] % 2 == 1, r[1] % 2 == 0, "x" if broken and r[2] == "R" else None))
    # numbers that an order holds twice have no place of their own, so such orders say nothing
    return {k: sorted(v) for k, v in out.items() if len({x[0] for x in v}) == len(v)}


def test_track_pairing(spark, sf_dir):
    batches = tracks(spark, sf_dir)
    got = {}
    for r in plans.QUERIES["track_pairing"](spark, sf_dir).collect():
        got.setdefault(r["batch_id"], set()).add((r["picture"], r["sound"]))
    for k, rows in batches.items():
        name = {r[0]: r[1] for r in rows}
        assert got.get(k, set()) == {(name[a], name[b]) for a, b in plain_pairs(rows).items() if a % 2 == 1}, rows


def test_batch_groups(spark, sf_dir):
    got = {}
    for r in plans.QUERIES["batch_groups"](spark, sf_dir).collect():
        got.setdefault(r["batch_id"], set()).add((r["place"], r["outcome"], r["other"]))
    for k, rows in tracks(spark, sf_dir, broken=True).items():
        pair = plain_pairs(rows)
        want = {(r[0], "pair", pair[r[0]]) if r[0] in pair else (r[0], "failed" if r[5] else "no sound" if r[3] and not r[4] else "alone", None) for r in rows if r[0] < pair.get(r[0], 99)}
        assert got.get(k, set()) == want, rows


class Tie(Exception):
    """Several words sound alike; which of them is taken is another rule's."""


class Plain(Corrector):
    """The rules for one Latin token as they are stated, without short cuts; alignments are enumerated."""

    def _term(self, token):
        bare = re.sub(r"\s+", "", token)
        low = bare.lower()
        for t in self.d.terms:
            if t.term.lower() == low:
                return t.term, None if bare == t.term else ("canonical", token, t.term, t.confidence)
        latin = [t for t in self.d.terms if t.term.isascii() and t.term.isalnum()]
        if len(bare) >= 4:
            sims = [1 - levenshtein(low, t.term.lower()) / max(len(low), len(t.term)) for t in latin]
            if max(sims) >= 0.85:
                t = latin[sims.index(max(sims))]
                return t.term, ("fuzzy", token, t.term, t.confidence * max(sims))
        if len(bare) < self.d.min_token or not re.fullmatch("[A-Z]?[a-z]+", bare):
            return token, None
        fold = lambda w: re.sub(r"([^aeiouy])\1+", r"\1", w.lower())
        heard, words = fold(low), {}
        for term, confidence, spoken in [(s.term, s.confidence, s.spoken) for s in self.d.surface] + [(t.term, t.confidence, ()) for t in latin]:
            words.setdefault(term.lower(), (term, confidence, [fold(term), *map(fold, spoken)]))
        if {low, heard} & self.d.stopwords or any(heard == targets[0] for _, _, targets in words.values()):
            return token, None
        scores = []
        for term, confidence, targets in words.values():
            for target in targets:
                if heard == target:
                    return term, ("latin-phonetic", token, term, confidence * 0.98)
                sizes = sorted((len(heard), len(target)))
                if heard[0] == target[0] and len(heard) <= len(target) + 1 and sizes[0] / sizes[1] >= 0.6 and (score := naive_score(heard, target)):
                    scores.append((score, term, confidence))
        top = max(scores, default=(0.0, "", 0.0))[0]
        rest = max((s for s, _, _ in scores if top - s > 0.02), default=0.0)
        if top < (self.d.short_threshold if len(heard) == 2 else self.d.threshold) or top - rest < self.d.margin:
            return token, None
        ties = {term for s, term, _ in scores if top - s <= 0.02}
        if len(ties) > 1:
            raise Tie
        return ties.pop(), ("latin-phonetic", token, "", 0.0)


def levenshtein(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
    return d[len(a), len(b)]


def test_latin_phonetic(spark, sf_dir):
    plain, told = Plain(builtin()), 0
    rows = sorted(plans.QUERIES["latin_phonetic"](spark, sf_dir).collect(), key=lambda r: hashlib.md5(r["token"].encode()).hexdigest())
    heard = set("reice raice rease foalse forse sstem conttrol contrl control lu luva hello java".split())
    for r in [r for r in rows if r["token"] in heard or r["changed"]] + rows[:300]:
        try:
            assert r["corrected"] == plain._term(r["token"])[0], r
            told += 1
        except Tie:
            continue
    assert told > 250 and heard <= {r["token"] for r in rows}


def test_correction_replay(spark, sf_dir):
    texts = {(r["conv_id"], r["turn"], hashlib.md5((r["text"] or "").encode()).hexdigest()): r["text"] for r in load(spark, sf_dir, "conversations").collect()}
    got = {}
    for r in plans.QUERIES["correction_replay"](spark, sf_dir).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["corrected_md5"], r["n_traces"], r["changed"]))
    plain, told = Plain(builtin()), 0
    for (conv, turn, _), text in sorted(texts.items())[:60]:
        if text is None:
            continue
        try:
            corrected, traces = plain.correct(text)
        except Tie:
            continue
        told += 1
        assert (hashlib.md5(corrected.encode()).hexdigest(), len(traces), corrected != text) in got[conv, turn]
    assert told > 20
