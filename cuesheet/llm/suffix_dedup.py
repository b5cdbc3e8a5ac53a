"""Removal of byte strings that repeat, by a hash-compared suffix sort of the places that may repeat.

Every byte that lies in a string of ``length`` bytes which also starts elsewhere, in the same document or another, goes.

1. Windows of ``length`` bytes are assigned to the smallest hashed ``gram``-byte string inside them. Equal windows have equal
   smallest grams, so only windows whose gram occurs at least twice can repeat. Neighbouring windows with the same gram form a
   run; a run's bytes are named by a polynomial hash. Runs of a gram with equal names repeat as a whole, once their bytes have
   been compared: the smallest and the largest of a name must be equal, else its runs are sorted one by one.
2. Of grams that occur in different runs, one run for each name is taken, and its windows are sorted as suffixes:
   a merge sort in which two suffixes are compared by the binary search of their common extension over prefix polynomial
   hashes. Neighbours that agree on all bytes of a window, verified byte by byte, repeat. A gram's runs are dealt to as many
   chunks as their number asks for, ``most`` runs each, which are sorted apart. If there are several, their different
   windows meet again by a 128-bit digest, and those whose digest another chunk has too by their bytes.
3. The removed intervals go back to their documents' texts.

Texts are found again by id and two 64-bit hashes; rows that repeat share one result. Null is empty; documents shorter than
``length`` keep all bytes; very long texts are hashed in pieces, but a text and the list of its repeated runs are a row;
repeated rows are copies like any others; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, staged

#: Bytes handled at once; positions in a piece fit PLACE_BITS.
PIECE, PLACE_BITS = 1 << 20, 24
#: Windows sorted at once.
CHUNK = 1 << 16
#: Runs of a gram that are sorted together.
MOST = 4096
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)
_M = np.uint64(0xFF51AFD7ED558CCD)
Batches = Iterator[pa.RecordBatch]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


@functools.cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Prefixes:
    """Polynomial hashes of all strings of a buffer, from its prefix sums."""

    def __init__(self, buf: np.ndarray, base: int, capacity: int):
        pw, self.inverse = _powers(base, capacity)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    rows = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(x)] = x
    rows = rows.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def window_runs(buf: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of pieces that end at ``ends``: (key, ctx, start, windows) of each run of windows with the same smallest gram."""
    none = np.empty(0, np.int64)
    if len(buf) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none
    capacity = 1 << max(PIECE + length, len(buf)).bit_length()
    one, two = (Prefixes(buf, b, capacity) for b in _BASES)
    at = np.arange(len(buf) - gram + 1)
    g = _mixed(one(at, at + gram))
    low = np.uint64((1 << PLACE_BITS) - 1)
    place = (_sliding_min((g & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    p = np.arange(len(place))
    valid = p + length <= ends[np.searchsorted(ends, p, side="right")]
    p, place = p[valid], place[valid]
    if not len(p):
        return none.view(np.uint64), none.view(np.uint64), none, none
    new = np.r_[True, (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(p)] - 1
    start, n = p[first], p[last] - p[first] + 1
    return g[place[first]], _mixed(two(start, start + n - 1 + length) + n.astype(np.uint64) * _M), start, n


def _runs(length: int, gram: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch["_text"]]
            owner, offset, pieces = [], [], []
            for i, b in enumerate(texts):
                for at in range(0, max(len(b) - length + 1, 0), PIECE):
                    owner.append(i)
                    offset.append(at)
                    pieces.append(b[at : at + PIECE + length - 1])
            found = []
            k = 0
            while k < len(pieces):
                m, size = k, 0
                while m < len(pieces) and (m == k or size + len(pieces[m]) <= PIECE):
                    size += len(pieces[m])
                    m += 1
                ends = np.cumsum([len(x) for x in pieces[k:m]])
                key, ctx, start, n = window_runs(np.frombuffer(b"".join(pieces[k:m]), np.uint8), ends, length, gram)
                piece = np.searchsorted(ends, start, side="right")
                found.append((np.array(owner[k:m])[piece], key.view(np.int64), ctx.view(np.int64), start - np.r_[0, ends][piece] + np.array(offset[k:m])[piece], n))
                k = m
            own, key, ctx, start, n = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 5
            bounds = np.searchsorted(own, np.arange(len(texts) + 1))
            runs = pa.StructArray.from_arrays([pa.array(key), pa.array(ctx), pa.array(start), pa.array(n.astype(np.int32))], ["key", "ctx", "p", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch["_row"], batch["_id"], batch["_h1"], batch["_h2"], pa.array([len(b) for b in texts], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in texts]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)],
                ["_row", "_id", "_h1", "_h2", "_bytes", "_sha", "_runs"],
            )

    return run


def sort_suffixes(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts``, by their first ``length`` bytes, and the class of equal ones, in that order."""
    prefix = Prefixes(buf, _BASES[0], 1 << max(len(buf), 1024).bit_length())
    words = np.lib.stride_tricks.sliding_window_view(buf, 8)[starts].copy().view(">u8").ravel().astype(np.uint64)
    order = np.argsort(words, kind="stable")
    s, words = starts[order], words[order]
    group = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    lo_of = np.repeat(group, np.diff(np.r_[group, len(s)]))
    hi_of = np.repeat(np.r_[group[1:], len(s)], np.diff(np.r_[group, len(s)]))

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, up to length."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), length)
        while len(busy := np.flatnonzero(lo < hi)):
            mid = (lo[busy] + hi[busy] + 1) // 2
            same = prefix(x[busy], x[busy] + mid) == prefix(y[busy], y[busy] + mid)
            lo[busy] = np.where(same, mid, lo[busy])
            hi[busy] = np.where(same, hi[busy], mid - 1)
        return lo

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = common(x, y)
        whole = n >= length
        n = np.minimum(n, length - 1)
        return np.where(whole, or_equal, buf[x + n] < buf[y + n])

    m, largest = 1, int((hi_of - lo_of).max(initial=1))
    index = np.arange(len(s))
    while m < largest:
        local = index - lo_of
        block = lo_of + local // (2 * m) * (2 * m)
        middle, end = np.minimum(block + m, hi_of), np.minimum(block + 2 * m, hi_of)
        left = index < middle
        lo, hi = np.where(left, middle, block), np.where(left, end, middle)
        own = index - np.where(left, block, middle)
        from_ = lo.copy()
        while len(busy := np.flatnonzero(lo < hi)):
            mid = (lo[busy] + hi[busy]) // 2
            # an element of the left goes before its equals of the right
            goes_on = less(s[mid], s[busy], ~left[busy])
            lo[busy] = np.where(goes_on, mid + 1, lo[busy])
            hi[busy] = np.where(goes_on, hi[busy], mid)
        to = block + own + lo - from_
        s, order = _placed(s, to), _placed(order, to)
        m *= 2
    near = np.flatnonzero((hi_of[:-1] == hi_of[1:])) if len(s) > 1 else np.empty(0, np.int64)
    near = near[common(s[near], s[near + 1]) >= length]
    same = np.zeros(max(len(s) - 1, 0), bool)
    span = np.arange(length)
    for k in range(0, len(near), 8192):  # collisions of the hashes don't count
        part = near[k : k + 8192]
        same[part] = (buf[s[part][:, None] + span] == buf[s[part + 1][:, None] + span]).all(1)
    return order, np.cumsum(np.r_[0, ~same]) if len(s) else np.empty(0, np.int64)


def _placed(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[to] = x
    return out


def _contexts(length: int, lists: str, fields: dict[str, pa.DataType]) -> Callable[[Batches], Batches]:
    """The runs of a column of lists, with their bytes."""
    names, types = ["_row", "p", "n", *fields, "raw"], [pa.int64(), pa.int64(), pa.int32(), *fields.values(), pa.binary()]

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch, out = whole.slice(k, 256), []
                for row, text, runs in zip(batch["_row"].to_pylist(), batch["_text"], batch[lists]):
                    if wanted := runs.as_py():
                        raw = (text.as_py() or "").encode()
                        out += [(row, r["p"], r["n"], *(r[f] for f in fields), raw[r["p"] : r["p"] + r["n"] - 1 + length]) for r in wanted]
                cols = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def _repeated(length: int, most: int, bits: int) -> Callable[[Batches], Batches]:
    """Of runs in order of their keys: (row, p, n), n windows from p on that repeat.

    Of keys dealt to several chunks, each chunk also gives (f1, f2, many, w) for each of its different windows w, with the
    place of a window that stood alone, to be counted over all chunks.
    """

    def flush(rows: list) -> pa.RecordBatch:
        key, total, row, p, n, many = (np.array([r[k] for r in rows], np.int64) for k in range(6))
        size = np.array([len(r[6]) for r in rows])
        raw = b"".join(r[6] for r in rows)
        base, first = np.cumsum(size) - size, np.cumsum(n) - n
        run = np.repeat(np.arange(len(rows)), n)
        step = np.arange(n.sum()) - np.repeat(first, n)
        order, group = sort_suffixes(np.frombuffer(raw, np.uint8), base[run] + step, length)
        count = np.bincount(group, many[run[order]]).astype(np.int64)
        hit = np.zeros(len(order) + 1, bool)
        hit[order] = count[group] > 1
        edge = np.flatnonzero((hit != np.r_[False, hit[:-1]]) | np.r_[np.isin(np.arange(len(order)), first), False])
        edge = edge[hit[edge]]
        nxt = np.flatnonzero(~hit | np.r_[np.isin(np.arange(len(order)), first), True])
        end = nxt[np.searchsorted(nxt, edge, side="right")]
        out = [(row[run[edge]], p[run[edge]] + step[edge], end - edge, np.zeros(len(edge), np.int64), np.zeros(len(edge), np.int64), np.zeros(len(edge), np.int64), np.ones(len(edge), bool))]
        w = [None] * len(edge)
        lead = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
        hot = total[run[lead]] > most
        lead, count = lead[hot], count[hot]
        if len(lead):
            at = base[run[lead]] + step[lead]
            w += [raw[x : x + length] for x in at]
            digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in w[len(edge) :]), np.int64).reshape(-1, 2) >> (64 - bits)
            out.append((row[run[lead]], p[run[lead]] + step[lead], np.ones(len(lead), np.int64), digest[:, 0], digest[:, 1], np.minimum(count, 2), count == 1))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array(w, pa.binary())], ["_row", "p", "n", "f1", "f2", "many", "placed", "w"])

    def run(batches: Batches) -> Batches:
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in ("key", "total", "_row", "p", "n", "many", "raw"))):
                if size >= CHUNK and (r[0] != last or r[1] > most):
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += r[4]
                last = r[0]
        if rows:
            yield flush(rows)

    return run


def _removed(length: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for text, *lists in zip(batch["_text"], batch["_covered"], batch["_hits"]):
                raw = (text.as_py() or "").encode()
                spans = sorted((r["p"], r["p"] + r["n"] - 1 + length) for x in lists for r in x.as_py() or ())
                end, removed, n, kept = 0, 0, 0, hashlib.sha256()
                for a, b in spans:
                    if a > end or not n:
                        kept.update(raw[end:a])
                        n += 1
                        removed += b - a
                    elif b > end:
                        removed += b - end
                    end = max(end, b)
                kept.update(raw[end:])
                out.append((removed, n, kept.hexdigest()))
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_h1"], batch["_h2"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["_id", "_h1", "_h2", "_removed", "_spans", "_kept"])

    return run


def repeated_spans(docs: DataFrame, length: int = 200, *, gram: int = 32, most: int = MOST, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_bytes, n_removed, n_spans, kept_sha256.

    bits below 64 makes names and digests collide, for tests.
    """
    same = [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h1"), F.xxhash64(F.lit(1), text_col).alias("_h2"), F.col(text_col).alias("_text")]
    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.monotonically_increasing_id().alias("_row"), *same).mapInArrow(_runs(length, gram), f"_row long, _id {id_type}, _h1 long, _h2 long, _bytes long, _sha string, _runs array<struct<key:long,ctx:long,p:long,n:int>>")
    found = staged(found, "runs")
    rows = staged(found.drop("_runs"), "rows")

    place = F.shiftleft("p", 16) + F.col("n")  # a run has at most length windows
    each = found.select(F.inline("_runs"), "_row").select("key", F.shiftright("ctx", 64 - bits).alias("ctx"), "_row", place.alias("_at"))
    keys = each.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.min("ctx").alias("_lo"), F.max("ctx").alias("_hi")).filter("total > 1")
    keys = staged(keys.select("key", "total", (F.col("_lo") == F.col("_hi")).alias("_same")), "run-keys")
    twice = staged(each.join(keys, "key"), "runs-repeated")
    release(keys)
    release(found)
    me = F.struct("_row", "_at")
    different = staged(twice.filter("not _same").groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("_c"), F.min(me).alias("_first"), F.first("total").alias("total")), "runs-different")
    least = rows.groupBy("_id", "_h1", "_h2").agg(F.min("_row").alias("_row"))  # of rows that repeat, the first has the lists

    def with_lists(apart: DataFrame | None) -> DataFrame:
        """Texts with the lists of runs that repeat as a whole, and of runs to be sorted; names in ``apart`` stand for different runs."""
        covered = twice.join(different.filter("_c = 1").select("key", "ctx"), ["key", "ctx"], "left_anti")
        reps = different.select("key", "ctx", F.col("_first._row").alias("_row"), F.col("_first._at").alias("_at"), F.least("_c", F.lit(2)).cast("int").alias("many"), "total")
        if apart is not None:
            covered, reps = (x.join(apart, ["key", "ctx"], "left_anti") for x in (covered, reps))
            to = least.select(F.col("_id").alias("_i"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), F.col("_row").alias("_to"))
            to = rows.join(to, (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")) & F.col("_id").eqNullSafe(F.col("_i"))).select("_row", "_to")
            each = twice.join(apart, ["key", "ctx"], "left_semi").join(to, "_row").groupBy("key", "ctx", F.col("_to").alias("_row"), "_at")
            reps = reps.unionByName(each.agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("many"), F.first("total").alias("total")))
        p, n = F.shiftright("_at", 16).alias("p"), F.col("_at").bitwiseAND(F.lit(65535)).cast("int").alias("n")
        covered = covered.groupBy("_row").agg(F.collect_list(F.struct(p, n, "key", "ctx")).alias("_covered"))
        reps = reps.groupBy("_row").agg(F.collect_list(F.struct(p, n, "key", "total", "many")).alias("_reps"))
        lists = staged(covered.join(reps, "_row", "full"), "run-lists")
        at = lists.join(least, "_row").select("_row", F.col("_id").alias("_i"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), "_covered", "_reps")
        texts = docs.select(*same).join(at, (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")) & F.col("_id").eqNullSafe(F.col("_i")))
        texts = staged(texts.select("_row", "_id", "_h1", "_h2", "_text", "_covered", "_reps"), "texts")
        release(lists)
        return texts

    texts = with_lists(None)
    named = texts.filter("_covered is not null").mapInArrow(_contexts(length, "_covered", {"key": pa.int64(), "ctx": pa.int64()}), "_row long, p long, n int, key long, ctx long, raw binary")
    apart = staged(named.groupBy("key", "ctx").agg(F.min("raw").alias("_least"), F.max("raw").alias("_most")).filter("_least <> _most").select("key", "ctx"), "names-apart")
    if apart.limit(1).count():
        release(texts)
        texts = with_lists(apart)
    for x in (twice, different, apart):
        release(x)

    context = texts.filter("_reps is not null").mapInArrow(_contexts(length, "_reps", {"key": pa.int64(), "total": pa.int64(), "many": pa.int32()}), "_row long, p long, n int, key long, total long, many int, raw binary")
    deal = F.pmod(F.xxhash64("_row", "p"), F.ceil(F.col("total") / most))
    sort = context.withColumn("_chunk", deal).repartition("key", "_chunk").sortWithinPartitions("key", "_chunk")
    windows = staged(sort.mapInArrow(_repeated(length, most, bits), "_row long, p long, n long, f1 long, f2 long, many long, placed boolean, w binary"), "windows")
    counted = windows.filter("many > 0")
    elsewhere = staged(counted.groupBy("f1", "f2").agg(F.sum("many").alias("_all"), F.count(F.lit(1)).alias("_chunks")).filter("_all > 1 and _chunks > 1").select("f1", "f2"), "windows-met")
    met = staged(counted.join(elsewhere, ["f1", "f2"], "left_semi").select("_row", "p", "n", "many", "placed", "w"), "windows-met-bytes")
    again = staged(met.groupBy("w").agg(F.sum("many").alias("_all")).filter("_all > 1").select("w"), "windows-repeated")
    alone = met.filter("placed").join(again, "w", "left_semi").select("_row", "p", "n")
    hits = windows.filter("many = 0").select("_row", "p", "n").unionByName(alone)
    hits = staged(hits.groupBy("_row").agg(F.collect_list(F.struct("p", "n")).alias("_hits")), "hits")
    for x in (windows, elsewhere, met, again):
        release(x)

    result = texts.join(hits, "_row", "left").mapInArrow(_removed(length), f"_id {id_type}, _h1 long, _h2 long, _removed long, _spans long, _kept string")
    result = staged(result.dropDuplicates(["_id", "_h1", "_h2"]), "removed")
    release(texts)
    release(hits)
    result = result.select(F.col("_id").alias("_i"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), "_removed", "_spans", "_kept")
    out = rows.join(result, (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")) & F.col("_id").eqNullSafe(F.col("_i")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), F.coalesce("_removed", zero).alias("n_removed"), F.coalesce("_spans", zero).alias("n_spans"), F.coalesce("_kept", "_sha").alias("kept_sha256"))
