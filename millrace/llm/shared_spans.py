"""Long verbatim spans shared between documents: content-defined chunks by a gear rolling hash.

1. Each whole text is cut where the gear hash of the last 32 characters is the
   smallest of its window. The cut depends on the content alone, so a shared
   span is cut alike in every document, wherever it stands. Chunks are
   deduplicated by digest.
2. The window is so narrow that every span of ``min_chars`` holds a whole
   chunk: a document without a chunk that another document has can't share one.
3. Where all chunks inside it are shared, every stretch of ``min_chars`` characters is
   hashed (a rolling polynomial); equal stretches of two documents are shared
   spans. This is exact up to collisions of 64-bit hashes and never compares
   pairs of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut, salted_join

#: Characters that a gear hash sees: the bits of its word.
GEAR = 32
#: Documents with one chunk from which it can count as hot.
HOT_FLOOR = 50_000
#: Documents with one chunk from which stretches of such chunks alone are spread over ``SALTS`` tasks each.
COMMON_FLOOR = 5_000
SALTS = 64
#: Rows that a Python worker hands over at a time.
OUT_ROWS = 200_000
#: Odd base of the polynomial over stretches and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each code point: the gear table as a rule, for all of Unicode."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def cut_window(min_chars: int) -> int:
    """Widest window of hashes such that ``min_chars`` characters hold two cuts, whatever surrounds them."""
    w = (min_chars - GEAR + 1) // 2
    if w < 8:
        raise ValueError("min_chars is too small for the gear hash")
    return w


def window_cuts(mixed: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``window`` consecutive gear hashes the position after which its last minimum cuts the text."""
    if len(mixed) < GEAR - 1 + window:
        return np.empty(0, np.int64)
    h = (mixed >> np.uint64(32)).astype(np.uint32)
    step = 1
    while step < GEAR:  # h[i] = sum of gear[i - j] << j for j < 2 * step
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    h = h[GEAR - 1 :].astype(np.int64)
    mask = np.int64((1 << 31) - 1)
    low, span = (h << 31) | (mask - np.arange(len(h), dtype=np.int64)), 1  # each key holds its position
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < window:
        low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
    return mask - (low & mask) + GEAR


def _prefix(mixed: np.ndarray) -> np.ndarray:
    powers = np.ones(len(mixed), np.uint64)
    if len(mixed) > 1:
        powers[1:] = np.uint64(BASE)
        powers = np.cumprod(powers, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers, dtype=np.uint64)])


def _unpowers(n: int) -> np.ndarray:
    p = np.full(n, np.uint64(UNBASE))
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Cut:
    """One text, cut: ``cuts`` (positions), ``digests`` of the chunks between two cuts (the ends of the text are no chunks)."""

    def __init__(self, text: str, window: int):
        mixed = _mix(code_points(text))
        self.length, self.window = len(mixed), window
        self.of_window = window_cuts(mixed, window)
        self.cuts = np.unique(self.of_window)
        self.prefix = _prefix(mixed)
        start, end = self.cuts[:-1], self.cuts[1:]
        digests = self._hash(start, end) ^ _mix((end - start).astype(np.uint64))
        self.digests = digests.view(np.int64)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * _unpowers(self.length + 1)[start]

    def _within(self, at: np.ndarray, min_chars: int, chosen: np.ndarray) -> np.ndarray:
        """Whether all chunks between the cuts of a stretch's first and last window are ``chosen``."""
        missing = np.concatenate([np.zeros(1, np.int64), np.cumsum(~chosen)])
        first = np.searchsorted(self.cuts, self.of_window[at])
        last = np.searchsorted(self.cuts, self.of_window[at + (min_chars - GEAR + 1 - self.window)])
        return missing[last] == missing[first]

    def all_in(self, at: np.ndarray, min_chars: int, digests: np.ndarray) -> np.ndarray:
        """For each stretch whether all its chunks are among ``digests``: alike for equal stretches of any document."""
        if not len(digests):
            return np.zeros(len(at), bool)
        return self._within(at, min_chars, np.isin(self.digests, np.asarray(digests, np.int64)))

    def stretches(self, min_chars: int, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every stretch of ``min_chars`` characters that may be shared.

        All chunks between the cut of a stretch's first window and that of its
        last must be shared: these windows lie wholly inside it, so whoever has
        the stretch has these chunks.
        """
        n = self.length - min_chars + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(n, dtype=np.int64)
        if shared is not None:
            at = at[self._within(at, min_chars, shared)]
        return at, self._hash(at, at + min_chars).view(np.int64)


def _runs(at: np.ndarray) -> list[int]:
    """Sorted positions as [first, beyond the last, ...] of their runs."""
    breaks = np.flatnonzero(np.diff(at) != 1)
    first, last = np.concatenate([at[:1], at[breaks + 1]]), np.concatenate([at[breaks], at[-1:]]) + 1
    return np.stack([first, last], axis=1).ravel().tolist()


def distinct_stretches(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int] | None]]:
    """(first position, hash, runs of all its positions or None where there is but one) of each different stretch of a document."""
    order = np.argsort(hashes, kind="stable")
    at, hashes = at[order], hashes[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), hashes[1:] != hashes[:-1]])) if len(at) else np.empty(0, np.int64)
    ends = np.append(first[1:], len(at))
    more: list[list[int] | None] = [None] * len(first)
    for i in np.flatnonzero(ends - first > 1):
        more[i] = _runs(at[first[i] : ends[i]])
    return at[first], hashes[first], more


def gram_rows(held: list[tuple]) -> pd.DataFrame:
    doc, at, h, more, common = zip(*held, strict=True)
    return pd.DataFrame({
        "doc_id": np.repeat(np.asarray(doc), [len(x) for x in at]), "at": np.concatenate(at), "h": np.concatenate(h),
        "more": pd.Series([m for ms in more for m in ms], dtype=object), "common": np.concatenate(common),
    })


def shared_stretches(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 400) -> DataFrame:
    """(doc_id, at, more): stretches of ``min_chars`` characters of a document that stand verbatim in another one.

    One row per different stretch of a document: ``at`` is its first position;
    where it stands there several times, ``more`` holds the runs of all its
    positions (first, beyond the last, ...). Repeats within one document don't
    count; rows of one doc_id are one document; null ids and texts are left
    out; shorter texts can't share. Texts are compared as they are, code point
    by code point. An empty table gives no rows; extra columns are not read.
    """
    window = cut_window(min_chars)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(
        F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [np.unique(Cut(t, window).digests) for t in pdf["text"]]
            if made:
                yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(), [len(x) for x in made]), "digest": np.concatenate(made)})

    made = cut(docs.mapInPandas(cut_texts, f"doc_id {kind}, digest bigint"))
    # Rows of one digest beyond which it is spread over tasks; at most 200 digests can hold 1 / 200 of the rows each.
    least = max(HOT_FLOOR, made.count() // 200)
    counted = made.groupBy("digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b")
    hot = counted.filter(F.col("n") >= least).select("digest")
    common = F.col("n") >= COMMON_FLOOR
    marks = (
        salted_join(made, counted.select("digest", common.alias("common")), ["digest"], hot, "doc_id", "inner")
        .groupBy("doc_id").agg(F.collect_set("digest").alias("digests"), F.collect_set(F.when(F.col("common"), F.col("digest"))).alias("commons"))
    )

    def hash_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            for doc, t, dig, com in zip(pdf["doc_id"], pdf["text"], pdf["digests"], pdf["commons"], strict=True):
                c = Cut(t, window)
                at, h, more = distinct_stretches(*c.stretches(min_chars, np.isin(c.digests, np.asarray(dig, np.int64))))
                held.append((doc, at, h, more, c.all_in(at, min_chars, com)))
                size += len(at)
                if size > OUT_ROWS:
                    yield gram_rows(held)
                    held, size = [], 0
            if held:
                yield gram_rows(held)

    grams = docs.join(marks, "doc_id").mapInPandas(hash_texts, f"doc_id {kind}, at bigint, h bigint, more array<bigint>, common boolean")
    met = lambda df, *by: df.groupBy(*by).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    if counted.filter(common).isEmpty():
        rare, often = grams, None
    else:
        grams = cut(grams)
        rare, often = grams.filter("not common"), grams.filter("common")
    # A stretch with a chunk that is not common is in fewer than COMMON_FLOOR documents, with one row in each: no group is large.
    w = Window.partitionBy("h")
    out = rare.withColumn("a", F.min("doc_id").over(w)).withColumn("b", F.max("doc_id").over(w)).filter("a <> b").select("doc_id", "at", "more")
    if often is not None:
        # All others may be in any number of documents: counted partially per salt, then only the salts that hold a shared one are joined.
        often = often.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        per_salt = met(often, "h", "salt")
        ends = per_salt.groupBy("h").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.collect_set("salt").alias("salts")).filter("a <> b")
        shared = ends.select("h", F.explode("salts").alias("salt"))
        out = out.unionByName(often.hint("merge").join(shared, ["h", "salt"], "left_semi").select("doc_id", "at", "more"))
    return out


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 400) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of the documents that share a span with another document.

    shared_chars counts the characters that lie in some verbatim span of at
    least ``min_chars`` characters that another doc_id has too. Of several rows
    of one doc_id the longest text gives n_chars.
    """
    met = shared_stretches(documents, id_col, text_col, min_chars)
    runs = F.coalesce("more", F.array(F.col("at"), F.col("at") + 1))
    # The runs of a document in order, each as far as its last stretch reaches, without what those before it have covered.
    pairs = met.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), (F.size(runs) / 2 - 1).cast("int")), lambda i: F.struct(F.get(runs, i * 2).alias("a"), (F.get(runs, i * 2 + 1) + (min_chars - 1)).alias("b")))).alias("r"))
    sorted_runs = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("rs", start, lambda x, r: F.struct(F.greatest(x["end"], r["b"]).alias("end"), (x["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(x["end"], r["a"]))).alias("n")))
    sizes = documents.select(F.col(id_col).alias("doc_id"), F.length(text_col).cast("bigint").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n_chars"))
    out = sorted_runs.select("doc_id", covered["n"].alias("shared_chars")).join(sizes, "doc_id")
    return out.select("doc_id", "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("shared_share"))
