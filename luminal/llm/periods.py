"""Periodic runs of words, by Main and Lorentz's divide and conquer on interned word ids.

A text is halved again and again. A run lies within exactly one segment whose middle it crosses, and four periods or
more of it put two on one side of that middle. So at each middle the Z-function of a half, taken over shifts up to half
its length, tells every period q whose first q words there repeat; each is extended to both sides as far as it holds.
All segments of a level, of all texts of a batch, are worked on at once: the first letters of their Z-functions are
compared as vectors, and what is still open after OPEN letters goes on segment by segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.llm.common import words

BATCH_WORDS = 1 << 20  # texts of so many words, or one longer text, are worked on at once
OPEN = 16  # letters of the Z-functions that are compared as vectors
FEW = 32  # open periods of a middle that are compared one by one; beyond, its whole Z-function is worked out


def z_function(v: list) -> list[int]:
    """For each place of v the length of the longest common start of v and of what begins there, in linear time."""
    n = len(v)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and v[k] == v[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _same(s: np.ndarray, a: int, b: int, most: int) -> int:
    """How many of the words from a on, most at most, equal those from b on."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        differ = s[a + done : a + done + step] != s[b + done : b + done + step]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + step, step * 4
    return done


def _rightward(s: np.ndarray, back: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, bound: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of runs with two periods to the right of the middle of a segment that contain the word
    before it too. back is s backwards; first and last bound the segment's text, bound the periods."""
    n = np.minimum((hi - mid) // 2, bound)
    seg = np.repeat(np.arange(len(n)), n)
    q = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n) + 1
    m = mid[seg]
    ok = (s[m] == s[m + q]) & (s[m - 1] == s[m - 1 + q])
    seg, q = seg[ok], q[ok]
    whole: list[tuple[int, int]] = []
    for k in range(1, OPEN + 1):
        done = q <= k
        whole += zip(seg[done].tolist(), q[done].tolist(), strict=True)
        seg, q = seg[~done], q[~done]
        if not len(q):
            break
        m = mid[seg] + k
        ok = s[m] == s[m + q]
        seg, q = seg[ok], q[ok]
    open_: dict[int, list[int]] = {}
    for g, p in zip(seg.tolist(), q.tolist(), strict=True):
        open_.setdefault(g, []).append(p)
    known: dict[int, list[int]] = {}
    for g, p in sorted(whole):
        known.setdefault(g, []).append(p)
    out = []
    for g in sorted({*known, *open_}):
        at, found, size = int(mid[g]), [], len(s)

        def extend(p: int, at=at, found=found, g=g, size=size) -> None:
            end = at + p + _same(s, at, at + p, int(last[g]) - at - p)
            left = _same(back, size - at, size - at - p, at - int(first[g]))
            found.append((at - left, end, p))

        def new(p: int, at=at, found=found) -> bool:
            """Not a multiple of a period already found that holds over two of p."""
            return not any(p % r == 0 and at + 2 * p <= end for _, end, r in found)

        for p in known.get(g, ()):
            if new(p):
                extend(p)
        rest = [p for p in open_.get(g, ()) if new(p)]
        if len(rest) > FEW:
            z = z_function(s[at : int(hi[g])].tolist())
            rest = [p for p in rest if z[p] >= p]
        for p in rest:
            if new(p) and _same(s, at, at + p, p) == p:
                extend(p)
        out += found
    return out


def runs_of(s: np.ndarray, ends: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, end, period), in order of start and period, of all runs of the texts that stand one after the
    other in s and end at ends: stretches with smallest period q of max(least, times * q) words or more that neither
    neighbouring word of their text extends. A run never leaves its text, so rows are in order of texts too."""
    if times < 4:
        raise ValueError("runs of four periods or more only")
    s = np.ascontiguousarray(s)
    back = np.ascontiguousarray(s[::-1])
    size = len(s)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    last = np.asarray(ends, np.int64)
    lo, hi = first, last
    # of the widest run known at each place: its end and period. Within a run of period p, another of period q has
    # fewer than p + q words, so 3 * q < p; all else there is that run again.
    until, period = np.zeros(size, np.int64), np.zeros(size, np.int64)
    found: dict[tuple[int, int], int] = {}
    while True:
        keep = hi - lo >= least
        lo, hi, first, last = lo[keep], hi[keep], first[keep], last[keep]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        bound = np.where(until[lo] >= hi, (period[lo] - 1) // 3, size)
        new = _rightward(s, back, lo, mid, hi, first, last, bound)
        new += [(size - b, size - a, p) for a, b, p in _rightward(back, s, size - hi, size - mid, size - lo, size - last, size - first, bound)]
        for a, b, p in sorted(new, key=lambda x: x[2]):
            if b - a >= max(least, times * p) and p < found.get((a, b), size):
                found[a, b] = p
                wider = until[a:b] < b
                until[a:b][wider], period[a:b][wider] = b, p
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        first, last = np.concatenate([first, first]), np.concatenate([last, last])
    rows = sorted((a, p, b) for (a, b), p in found.items())
    return np.array([(a, b, p) for a, p, b in rows], np.int64).reshape(-1, 3)


def _worker(least: int, times: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(batch["words"].offsets.to_numpy())
            start = held = 0
            for i, n in enumerate([*counts.tolist(), None]):
                if n is None or held and held + n > BATCH_WORDS:
                    if i > start:
                        yield some(batch.slice(start, i - start))
                    start, held = i, 0
                held += n or 0

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch["words"]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat, ends = lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets[1:] - offsets[0]
        ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        runs = runs_of(ids, ends, least, times)
        text = np.searchsorted(ends, runs[:, 0], "right")
        begin = ends - np.diff(offsets)
        dropped = np.zeros(len(flat) + 1, np.int64)
        np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
        np.add.at(dropped, runs[:, 1], -1)
        kept = np.cumsum(dropped[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept))), " ")
        columns = [runs[:, 0] - begin[text], runs[:, 1] - runs[:, 0], runs[:, 2]]
        struct = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
        cuts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(ends)))])
        return pa.RecordBatch.from_arrays([batch["id"], pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), struct), collapsed], names=["id", "n_words", "runs", "collapsed"])

    return work


def periodic_runs(df: DataFrame, word_list: Column | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row per row of df: id_col, n_words, runs (start, length, period; by start, then period) and collapsed, the
    words without those that any run has after its first period, joined by one space.

    Words are what stands between ASCII white space in the text, or word_list, an array of words without nulls. A run
    is a stretch of words with smallest period q, of max(least, times * q) words or more, times being 4 or more, that
    no neighbouring word extends. Null and empty texts have no words and no runs; null and repeated ids pass through;
    texts of any length are worked on whole, and an empty table gives an empty result. Other columns are dropped."""
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), (words(F.col(text_col)) if word_list is None else F.coalesce(word_list, F.array().cast("array<string>"))).alias("words"))
    out = rows.mapInArrow(_worker(least, times), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.withColumn("_longest", longest)
    return out.select(
        *[F.col(f"`{c}`") for c in found.columns if c not in ("runs", "collapsed", "n_words")],
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.start")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.period")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(text: Column, doc_id: Column) -> Column:
    """The words of text. Of one in ten ids, by crc32, a stretch of the words is repeated to the end."""
    own = words(text)
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(own)
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    # flattened copies of the stretch rather than a look-up for each word
    stretch = F.slice(own, a.cast("int") + 1, p.cast("int"))
    copies = F.flatten(F.array_repeat(stretch, F.ceil((n - a) / p).cast("int")))
    repeated = F.concat(F.slice(own, F.lit(1), a.cast("int")), F.slice(copies, F.lit(1), (n - a).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), repeated).otherwise(own)
