"""Same or nearly same records across splits: sharded Aho-Corasick automata over pieces of evaluation texts.

1. An evaluation text of n words has at most ``k`` word edits towards any
   partner. ``k + 1`` disjoint pieces of two or four words are cut from it: at
   least one of them stands unchanged in every partner. Which pieces are cut
   only decides the cost: those that are rarest by the counts of words and
   word pairs over all training texts (a shortest path over the text).
2. The pieces are sharded by hash. Of a training text only the runs of words
   that may be pieces go to the shards of those pieces, as codes of the words
   with a sketch of the whole text and never with its body: the runs are looked
   up in a bitmap of all pieces, so a text without any goes nowhere. Shards
   with many texts are divided into a grid of cells.
3. In each cell one automaton over the pieces scans the runs sent there. A pair
   with a piece at a place that ``k`` edits allow is kept if the sketches,
   parities of the words at fixed places, can be that many edits apart: an edit
   changes two places at most, so no near pair is lost.
4. The bodies of the pairs kept are joined and decide by bit-parallel edit
   distance over the words themselves; the matched intervals of the pair merge
   into the coverage of the evaluation record.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import canonical_key
from millrace.session import hot_keys, salted_join, written

#: Pieces in one shard and texts of one side in one cell: both bound a task's memory, neither what is compared.
SHARD_PIECES = 300_000
CELL_TEXTS = 2_000_000
#: Pairs compared by their sketches at a time, stretches of words scanned at a time.
PAIRS_AT_ONCE = 1_000_000
STRETCHES_AT_ONCE = 200_000
#: Words of a text that are cut into pieces together, and the lengths of pieces (one word only for texts of one word).
BLOCK_WORDS = 80
SIZES = (2, 4)
#: Words and pairs in at least one of so many training texts are counted, which bounds how many counts there are.
COUNTED_IN = 10_000
#: Bits of the bitmap of pieces, of which each sets two: 64 per piece, at most 2^29 (64 MB, broadcast); a fuller one only sends more texts.
MOST_BITS = 29
#: 64-bit words of a sketch.
LANES = 2
#: Rows from which a text or load is spread over tasks in the last joins.
HOT_ROWS = 200_000
EVAL_SPLITS = ("val", "test", "test_ood", "bench")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_distance(a: Sequence[str], b: Sequence[str], most: int) -> int:
    """Edit distance of two sequences of words (Myers' bit vectors, global form); ``most + 1`` where it is larger."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    for j, c in enumerate(b):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - (m - j - 1) > most:
            return most + 1
        ph = (ph << 1 | 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return score


def body_of(text: str | None) -> str:
    """Words in lower case with one space between, without the first line; a text of one line is kept. Null is empty."""
    if not text:
        return ""
    body = text.partition("\n")[2] if "\n" in text else text
    if "\u200b" in body or "\ufeff" in body:
        body = body.replace("\u200b", " ").replace("\ufeff", " ")
    return " ".join(body.lower().split())


def text_key(text: Column) -> Column:
    """Digest of a text without its first line: copies, whatever their date, are compared once."""
    at = F.instr(text, "\n")
    return F.unhex(F.md5(F.when(at > 0, F.substr(text, at + 1)).otherwise(text)))


def with_body(texts: DataFrame) -> DataFrame:
    """(text_key, body) of (text_key, text); texts without words are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({"text_key": pdf["text_key"], "body": [body_of(t) for t in pdf["text"]]})
            yield out[out["body"] != ""]

    return texts.mapInPandas(read, "text_key binary, body string")


def word_hashes(bodies: Iterable[str], memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in a row, number of words of each). ``memo`` spares hashing frequent words again."""
    import xxhash

    if len(memo) > 1_000_000:
        memo.clear()
    digest, flat, sizes = xxhash.xxh3_64_intdigest, [], []
    for b in bodies:
        words = b.split(" ")
        sizes.append(len(words))
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = digest(w)
            flat.append(h)
    return np.array(flat, np.uint64), np.array(sizes, np.int64)


def runs_of(flat: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position, as a signed number."""
    n = len(flat) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.full(n, np.uint64(size))
    for j in range(size):
        out = out * _BASE + flat[j : j + n]
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def whole(sizes: np.ndarray, size: int) -> np.ndarray:
    """Which positions of the texts in a row begin a run of ``size`` words of one text."""
    total = int(sizes.sum())
    if total < size:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(sizes), sizes)
    return np.arange(total - size + 1) + size <= ends[: total - size + 1]


def sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, LANES): parity of the words at each of 64 * LANES places. A word edit changes two places at most."""
    place = ((flat * _MIX) >> np.uint64(40)) % np.uint64(64 * LANES)
    bit, begin = np.uint64(1) << (place & np.uint64(63)), np.cumsum(sizes) - sizes
    return np.stack([np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == np.uint64(k), bit, np.uint64(0)), begin) for k in range(LANES)], axis=1)


def slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each slice, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Positions at which a new combination of sorted keys begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([np.ones(1, bool), np.logical_or.reduce([np.diff(k) != 0 for k in keys])]))


def short(hashes: np.ndarray) -> np.ndarray:
    """31 bits of a hash: enough for estimates."""
    return (hashes & np.int64(0x7FFFFFFF)).astype(np.int32)


class Rarity:
    """Estimated number of training texts with a run of words, from the counts of frequent words and pairs."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.total = hashes[order], counts[order].astype(np.float64), max(total, 1)
        self.low = max(3, total / COUNTED_IN) / 4

    def known(self, hashes: np.ndarray) -> np.ndarray:
        hashes = short(hashes)
        if not len(self.hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0.0)

    def costs(self, flat: np.ndarray) -> dict[int, np.ndarray]:
        """For each size the estimate of the run from each position: pairs chained by the words they share."""
        one = self.known(runs_of(flat, 1))
        one[one == 0] = self.low
        if len(flat) < 2:
            return {1: one}
        two = self.known(runs_of(flat, 2))
        apart = np.minimum(self.low, np.maximum(0.02, 4 * one[:-1] * one[1:] / self.total))
        two = np.where(two > 0, two, apart)
        link = np.minimum(1.0, two / one[:-1])
        out = {1: one, 2: two}
        for size in range(3, max(SIZES) + 1):
            n = len(flat) - size + 1
            out[size] = out[size - 1][:n] * link[size - 2 : size - 2 + n] if n > 0 else np.empty(0)
        return {s: c for s, c in out.items() if s in (1, *SIZES)}


def _blocks(n: int, pieces: int) -> list[tuple[int, int, int]]:
    """(first word, words, pieces) of the parts of a text of ``n`` words from which ``pieces`` pieces are cut in all."""
    parts = max(1, -(-n // BLOCK_WORDS))
    ends = [n * (i + 1) // parts for i in range(parts)]
    out, first, given = [], 0, 0
    for e in ends:
        upto = pieces * e // n
        if upto > given:
            out.append((first, e - first, upto - given))
        first, given = e, upto
    return out


def _cheapest(costs: dict[int, np.ndarray], starts: np.ndarray, length: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, sizes), each (blocks, pieces): the disjoint pieces of least cost in all of equally long blocks."""
    sizes = SIZES if length > 1 else (1,)
    spread = starts[:, None] + np.arange(length)[None, :]
    best = np.zeros((len(starts), length + 1))
    took, where = [], []
    for _ in range(pieces):
        now = np.full(best.shape, np.inf)
        size = np.zeros(best.shape, np.int8)
        for s in sizes:
            if s > length:
                continue
            offer = best[:, : length + 1 - s] + costs[s][spread[:, : length + 1 - s]]
            better = offer < now[:, s:]
            now[:, s:][better] = offer[better]
            size[:, s:][better] = s
        best = np.minimum.accumulate(now, axis=1)
        took.append(size)
        where.append(np.maximum.accumulate(np.where(now == best, np.arange(length + 1)[None, :], 0), axis=1))
    rows, at = np.arange(len(starts)), np.full(len(starts), length)
    first, width = np.empty((len(starts), pieces), np.int64), np.empty((len(starts), pieces), np.int64)
    for j in range(pieces - 1, -1, -1):
        at = where[j][rows, at]
        width[:, j] = took[j][rows, at]
        at = at - width[:, j]
        first[:, j] = at
    return first, width


def cut_pieces(flat: np.ndarray, sizes: np.ndarray, rarity: Rarity, share: float) -> pd.DataFrame:
    """(text, at, size, h, cost): k + 1 disjoint pieces of each text, k being the most word edits towards any partner.

    A partner of m words has at most share * m edits and n >= m - share * m.
    """
    begin = np.cumsum(sizes) - sizes
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, n in enumerate(sizes.tolist()):
        if n:
            for first, words, pieces in _blocks(n, int(share * n / (1 - share) + 1e-9) + 1):
                groups.setdefault((words, pieces), []).append((t, int(begin[t]) + first))
    costs = rarity.costs(flat)
    for s in SIZES:
        costs.setdefault(s, np.empty(0))
        costs[s] = np.append(costs[s], np.full(s, np.inf))  # runs over the end
    text, at, size = [], [], []
    for (words, pieces), members in groups.items():
        t, starts = (np.array(x, np.int64) for x in zip(*members, strict=True))
        first, width = _cheapest(costs, starts, words, pieces)
        text.append(np.repeat(t, pieces))
        at.append((first + starts[:, None]).ravel())
        size.append(width.ravel())
    if not text:
        return pd.DataFrame({"text": [], "at": [], "size": [], "h": [], "cost": []}).astype("int64")
    out = pd.DataFrame({"text": np.concatenate(text), "at": np.concatenate(at), "size": np.concatenate(size)})
    out["cost"] = 0
    for s in (1, *SIZES):
        mine = (out["size"] == s).to_numpy()
        if mine.any():
            out.loc[mine, "cost"] = np.ceil(np.minimum(costs[s][out.loc[mine, "at"].to_numpy()], 2e9)).astype(np.int64)
    out["h"] = 0
    for s in (1, *SIZES):
        mine = (out["size"] == s).to_numpy()
        if mine.any():
            out.loc[mine, "h"] = runs_of(flat, s)[out.loc[mine, "at"].to_numpy()]
    out["at"] -= begin[out["text"].to_numpy()]
    return out


def bitmap_of(numbers: DataFrame, bits: int, column: str = "h") -> np.ndarray:
    """Bit h mod 2^bits of every number, as bytes: aggregated by the tasks in parts of 4 KB, 2^bits / 8 bytes at most in all."""
    bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    parts = numbers.select((bit / 32768).cast("int").alias("part"), (bit % 32768).alias("pos")).groupBy("part").agg(F.expr("bitmap_construct_agg(pos)").alias("map"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        got = np.frombuffer(r["map"], np.uint8)
        out[r["part"] * 4096 : r["part"] * 4096 + len(got)] = got
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.int64(len(bitmap) * 8 - 1)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) > 0


def in_filter(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of a hash are set, the second being the first of the upper half of the hash."""
    out = in_bitmap(bitmap, h)
    out[out] = in_bitmap(bitmap, h[out] >> np.int64(32))
    return out


def held_pieces(flat: np.ndarray, sizes: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first word, words) of the runs of words of the texts that are in the bitmap, in order of the texts."""
    owner, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    parts = []
    for s in (1, *SIZES):
        h, ok = runs_of(flat, s), whole(sizes, s)
        if s == 1:
            ok = ok & (np.repeat(sizes, sizes) == 1)  # single words are pieces of texts of one word, whose partners have one too
        at = np.flatnonzero(ok)
        at = at[in_filter(bitmap, h[at])]
        parts.append((owner[at], h[at], at - begin[owner[at]], np.full(len(at), s)))
    text, h, at, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], h[order], at[order], size[order]


def matched_spans(mine: list[str], other: set[tuple[str, str]]) -> list[int]:
    """[first, beyond the last, ...]: merged intervals of words whose pairs stand in the other text too."""
    out: list[int] = []
    for i in range(len(mine) - 1):
        if (mine[i], mine[i + 1]) in other:
            if out and out[-1] > i:
                out[-1] = i + 2
            else:
                out += [i, i + 2]
    return out


class WordAutomaton:
    """Aho-Corasick over codes of words: an automaton over characters would search the letters of every word one by one.

    States are numbers; the step from a state by a word is one look-up.
    """

    def __init__(self, pieces: dict[tuple[int, ...], int]):
        self.ids: dict[int, int] = {}
        for piece in pieces:
            for w in piece:
                self.ids.setdefault(w, len(self.ids))
        self.base, self.step = max(1, len(self.ids)), {}
        parent, by, states = [0], [0], 1
        ends: dict[int, list[tuple[int, int]]] = {}
        for piece, number in pieces.items():
            at = 0
            for w in piece:
                edge = at * self.base + self.ids[w]
                at = self.step.get(edge, 0)
                if not at:
                    at = self.step[edge] = states
                    parent.append(edge // self.base)
                    by.append(self.ids[w])
                    states += 1
            ends.setdefault(at, []).append((len(piece), number))
        self.fall, depth = [0] * states, [0] * states
        layers: dict[int, list[int]] = {}
        for n in range(1, states):  # parents have smaller numbers
            depth[n] = depth[parent[n]] + 1
            layers.setdefault(depth[n], []).append(n)
        for d in sorted(layers)[1:]:
            for n in layers[d]:
                back = self.fall[parent[n]]
                while back and back * self.base + by[n] not in self.step:
                    back = self.fall[back]
                self.fall[n] = self.step.get(back * self.base + by[n], 0)
                if self.fall[n] in ends:
                    ends[n] = ends.get(n, []) + ends[self.fall[n]]
        self.ends = ends

    def find(self, words: list[int]) -> tuple[list[int], list[int]]:
        """First word and number of every piece in ``words``."""
        at, ids, step, base, ends = 0, self.ids, self.step, self.base, self.ends
        begins, numbers = [], []
        for n, w in enumerate(words):
            i = ids.get(w)
            if i is None:
                at = 0
                continue
            to = step.get(at * base + i)
            while to is None and at:
                at = self.fall[at]
                to = step.get(at * base + i)
            at = to or 0
            if at in ends:
                for size, number in ends[at]:
                    begins.append(n + 1 - size)
                    numbers.append(number)
        return begins, numbers


#: Columns of the texts of one side in a cell, each the bytes of an array: per text, per run of words, per word.
_ROUTED = {"id": np.int64, "sketch": np.uint64, "n": np.int32, "runs": np.int32, "mark": np.int32, "code": np.int32}
_BLOBS = ", ".join(f"{c} binary" for c in _ROUTED)


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second and so on: those of small numbers are zeros, which the shuffle compresses away."""
    return np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(parts: Iterable[bytes], kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).reshape(-1).view(kind) for x in parts])


def routed(ids: np.ndarray, sketch: np.ndarray, n: np.ndarray, codes: np.ndarray, cell: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """A row per cell with the texts sent there: runs of words (sorted by cell and text) go without the rest of their text.

    ``start`` is where a run begins in ``codes``.
    """
    out = []
    cuts = first_of(cell)
    for a, b in zip(cuts, np.append(cuts[1:], len(cell)), strict=True):
        first = first_of(text[a:b])
        of, runs = text[a:b][first], np.diff(np.append(first, b - a))
        mark = at[a:b] * 8 + size[a:b]
        parts = (ids[of], sketch[of], n[of], runs, mark, codes[slices(start[a:b], size[a:b])])
        out.append([int(cell[a]), *(planes(x.astype(t, copy=False)) for x, t in zip(parts, _ROUTED.values(), strict=True))])
    return pd.DataFrame(out, columns=["cell", *_ROUTED])


def _unpacked(side: pd.DataFrame) -> dict[str, np.ndarray]:
    """The arrays of all rows of a cell, with ``text``, the number of the text of each run."""
    out = {c: from_planes(side[c], t) for c, t in _ROUTED.items()}
    out["sketch"] = out["sketch"].reshape(-1, LANES)
    out["text"] = np.repeat(np.arange(len(out["id"])), out["runs"])
    return out


def _scan(evals: pd.DataFrame, trains: pd.DataFrame, share: float) -> pd.DataFrame:
    """Pairs of one cell that may be near: the automaton over the pieces of ``evals`` scans the runs of ``trains``."""
    gc.disable()  # nothing here is cyclic, and walking the automaton again and again takes longer than the search
    try:
        return _candidates(evals, trains, share)
    finally:
        gc.enable()


def _candidates(evals: pd.DataFrame, trains: pd.DataFrame, share: float) -> pd.DataFrame:
    if not len(evals) or not len(trains):
        return pd.DataFrame({"eval_id": np.empty(0, np.int64), "train_id": np.empty(0, np.int64)})
    e, t = _unpacked(evals), _unpacked(trains)
    del evals, trains
    numbers: dict[tuple[int, ...], int] = {}
    codes, at, number_of = e["code"].tolist(), 0, np.empty(len(e["mark"]), np.int64)
    for i, size in enumerate((e["mark"] & 7).tolist()):
        number_of[i] = numbers.setdefault(tuple(codes[at : at + size]), len(numbers))
        at += size
    del codes
    machine = WordAutomaton(numbers)
    order = np.argsort(number_of, kind="stable")
    places = np.cumsum(np.bincount(number_of, minlength=len(numbers) + 1)) - np.bincount(number_of, minlength=len(numbers) + 1)
    e_text, e_at = e["text"][order], (e["mark"] >> 3)[order].astype(np.int64)
    e_most, t_most = (np.floor(share * x["n"] + 1e-9).astype(np.int64) for x in (e, t))
    e_n, t_n = e["n"].astype(np.int64), t["n"].astype(np.int64)
    t_size, t_at = (t["mark"] & 7).astype(np.int64), (t["mark"] >> 3).astype(np.int64)
    t_end = np.cumsum(t_size)
    found = []

    def compare(hit_text: np.ndarray, hit_at: np.ndarray, low: np.ndarray, count: np.ndarray) -> None:
        """Keep the pairs of a hit and the places of its piece which the allowed edits can bring about."""
        i = slices(low, count)
        a, b, begin = e_text[i], np.repeat(hit_text, count), np.repeat(hit_at, count)
        most = np.maximum(e_most[a], t_most[b])
        # As many edits as are allowed can shift a word, no more.
        ok = (np.abs(begin - e_at[i]) <= most) & (np.abs(e_n[a] - t_n[b]) <= most)
        a, b, most = a[ok], b[ok], most[ok]
        ok = np.bitwise_count(e["sketch"][a] ^ t["sketch"][b]).sum(axis=1) <= 2 * most
        found.append(np.unique(a[ok] * len(t_n) + b[ok]))

    for r in range(0, len(t_size), STRETCHES_AT_ONCE):
        size = t_size[r : r + STRETCHES_AT_ONCE]
        # A word that no piece has ends each stretch.
        words = np.full(int(size.sum()) + len(size), 1 << 40, np.int64)
        starts = np.cumsum(size + 1) - (size + 1)
        words[slices(starts, size)] = t["code"][t_end[r] - t_size[r] : t_end[r + len(size) - 1]]
        begins, hits = (np.array(x, np.int64) for x in machine.find(words.tolist()))
        if not len(hits):
            continue
        of = np.searchsorted(starts, begins, "right") - 1
        hit_text, hit_at = t["text"][r + of], t_at[r + of] + begins - starts[of]
        low, count = places[hits], places[hits + 1] - places[hits]
        group = np.cumsum(count) // PAIRS_AT_ONCE
        cuts = first_of(group)
        for x, y in zip(cuts, np.append(cuts[1:], len(hits)), strict=True):
            compare(hit_text[x:y], hit_at[x:y], low[x:y], count[x:y])
        if len(found) > 50:
            found = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pd.DataFrame({"eval_id": e["id"][pairs // len(t_n)], "train_id": t["id"][pairs % len(t_n)]})


def _verified(pdf: pd.DataFrame, share: float) -> pd.DataFrame:
    """The near pairs of (eval_key, eval_body, train_key, train_body), by the words themselves."""
    out = []
    for e_key, e_body, t_key, t_body in zip(*(pdf[c] for c in ("eval_key", "eval_body", "train_key", "train_body")), strict=True):
        text, x = e_body.split(" "), t_body.split(" ")
        most = int(share * max(len(text), len(x)) + 1e-9)
        if len(set(x) & (other := set(text))) < max(len(text), len(x)) - most - (len(text) - len(other)):
            continue
        d = word_distance(text, x, most)
        if d <= most:
            out.append((e_key, t_key, d, matched_spans(text, set(zip(x, x[1:])))))
    return pd.DataFrame(out, columns=["eval_key", "train_key", "distance", "spans"])


def near_texts(evals: DataFrame, trains: DataFrame, share: float = 0.2) -> DataFrame:
    """(eval_key, train_key, distance, spans) of all pairs that differ in at most ``share`` of the words of the longer.

    Inputs: (key, body) with distinct keys, body being words with one space
    between. spans are the merged intervals of words of the evaluation text
    whose pairs stand in the training text. Empty texts match nothing.
    """
    kind = evals.schema["key"].dataType.simpleString()
    sc = evals.sparkSession.sparkContext

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for pdf in batches:
            flat, sizes = word_hashes(pdf["body"], memo)
            h, n = np.unique(short(np.concatenate([runs_of(flat, s)[whole(sizes, s)] for s in (1, 2)])), return_counts=True)
            # Lossy counting: what comes once in a batch is left out of the estimate.
            yield pd.DataFrame({"h": h[n > 1], "n": n[n > 1].astype(np.int32)})

    total = trains.count()
    counted = trains.select("body").mapInPandas(count, "h int, n int").groupBy("h").agg(F.sum("n").alias("n"))
    # Each is in one of COUNTED_IN texts at least: no more than twice COUNTED_IN times the mean number of words come to the driver.
    frequent = counted.filter(F.col("n") >= max(3, total // COUNTED_IN)).toPandas()
    known = sc.broadcast((frequent["h"].to_numpy(np.int32), frequent["n"].to_numpy(np.int64)))
    # Digests stand for keys until pairs are verified; two keys of one digest are verified both.
    digest = F.xxhash64("key").alias("id")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rarity, memo = Rarity(*known.value, total), {}
        for pdf in batches:
            flat, sizes = word_hashes(pdf["body"], memo)
            out = cut_pieces(flat, sizes, rarity, share).sort_values("text", kind="stable")
            bounds = np.searchsorted(out["text"].to_numpy(), np.arange(1, len(pdf)))
            size = out["size"].to_numpy()
            start = (np.cumsum(sizes) - sizes)[out["text"].to_numpy()] + out["at"].to_numpy()
            code = flat[slices(start, size)].astype(np.uint32).view(np.int32)
            parts = {c: np.split(x, bounds) for c, x in (("h", out["h"].to_numpy(np.int64)), ("place", (out["at"] * 8 + out["size"]).to_numpy(np.int32)), ("expected", out["cost"].to_numpy(np.int32)))} | {"code": np.split(code, np.append(0, np.cumsum(size))[bounds])}
            yield pd.DataFrame({"id": pdf["id"], "n": sizes.astype(np.int32), "sketch": [x.tobytes() for x in sketches(flat, sizes)], **{c: pd.Series(x, dtype=object) for c, x in parts.items()}})

    schema = "id bigint, n int, sketch binary, h array<bigint>, place array<int>, expected array<int>, code array<int>"
    chosen = written(evals.select(digest, "body").mapInPandas(choose, schema), "zstd")
    pieces = int(chosen.agg(F.sum(F.size("h")).alias("n")).first()["n"] or 0)
    bits, shards = min(MOST_BITS, max(18, (64 * pieces).bit_length())), max(1, -(-pieces // SHARD_PIECES))
    of_evals = sc.broadcast(bitmap_of(chosen.select(F.explode("h").alias("h")).select(F.explode(F.array("h", F.shiftright("h", 32))).alias("h")), bits))

    # A shard is a grid of cells by the texts of either side to be expected; there is one shard per SHARD_PIECES pieces, so few rows come to the driver.
    shard_of = F.pmod("h", F.lit(shards)).cast("int").alias("shard")
    left_rows = {r["shard"]: r["n"] for r in chosen.select(F.explode("h").alias("h")).groupBy(shard_of).agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = chosen.select(F.explode(F.arrays_zip("h", "expected")).alias("x")).select("x.h", F.col("x.expected").alias("n")).filter(F.col("n") >= max(1, CELL_TEXTS // 100))
    hot_rows = {r["shard"]: r["n"] for r in hot.groupBy("h").agg(F.max("n").alias("n")).groupBy(shard_of).agg(F.sum("n").alias("n")).collect()}
    rows = np.array([-(-left_rows.get(k, 0) // CELL_TEXTS) or 1 for k in range(shards)], np.int64)
    cols = np.array([-(-min(total, hot_rows.get(k, 0) + 32 * total // shards) // CELL_TEXTS) or 1 for k in range(shards)], np.int64)
    base = np.cumsum(rows * cols) - rows * cols

    def route_evals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            runs = np.array([len(x) for x in pdf["h"]], np.int64)
            if not runs.sum():
                continue
            h, place, code = (np.concatenate(pdf[c].tolist()) for c in ("h", "place", "code"))
            text, shard, size = np.repeat(np.arange(len(runs)), runs), h % shards, (place & 7).astype(np.int64)
            start, ids = np.cumsum(size) - size, pdf["id"].to_numpy(np.int64)
            # Every cell of the row.
            again = cols[shard]
            cell = slices(base[shard] + ids[text] % rows[shard] * cols[shard], again)
            text, place, size, start = (np.repeat(x, again) for x in (text, place, size, start))
            o = np.lexsort((text, cell))
            sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(-1, LANES)
            yield routed(ids, sketch, pdf["n"].to_numpy(), code, cell[o], text[o], (place >> 3)[o].astype(np.int64), size[o], start[o])

    def route_trains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The runs of words that may be pieces, to the shards of the pieces."""
        memo: dict[str, int] = {}
        for pdf in batches:
            flat, sizes = word_hashes(pdf["body"], memo)
            text, h, at, size = held_pieces(flat, sizes, of_evals.value)
            if not len(text):
                continue
            shard, ids = h % shards, pdf["id"].to_numpy(np.int64)
            # Every cell of the column.
            again = rows[shard]
            row = slices(np.zeros(len(shard), np.int64), again)
            text, shard, at, size = (np.repeat(x, again) for x in (text, shard, at, size))
            cell = base[shard] + row * cols[shard] + ids[text] % cols[shard]
            o = np.lexsort((text, cell))
            yield routed(ids, sketches(flat, sizes), sizes, flat.astype(np.uint32).view(np.int32), cell[o], text[o], at[o], size[o], (np.cumsum(sizes) - sizes)[text[o]] + at[o])

    left = chosen.mapInPandas(route_evals, f"cell int, {_BLOBS}")
    right = trains.select(digest, "body").mapInPandas(route_trains, f"cell int, {_BLOBS}")
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(lambda a, b: _scan(a, b, share), "eval_id bigint, train_id bigint")
    found = written(found.distinct(), "zstd")
    found_rows = found.count()

    def bodies(texts: DataFrame, side: str) -> DataFrame:
        """Keys and texts of the pairs found, few of all: a bitmap spares moving the others."""
        some = found.select(F.col(f"{side}_id").alias("h"))
        wanted = sc.broadcast(bitmap_of(some, min(MOST_BITS, max(18, (64 * found_rows).bit_length()))))

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[in_bitmap(wanted.value, pdf[f"{side}_id"].to_numpy(np.int64))]

        named = texts.select(digest.alias(f"{side}_id"), F.col("key").alias(f"{side}_key"), F.col("body").alias(f"{side}_body"))
        return named.mapInPandas(pick, named.schema)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _verified(pdf, share)

    both = found.join(bodies(evals, "eval"), "eval_id").join(bodies(trains, "train"), "train_id").select("eval_key", "eval_body", "train_key", "train_body")
    return both.mapInPandas(verify, f"eval_key {kind}, train_key {kind}, distance int, spans array<int>")


def _user_text() -> Column:
    return F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def placed_records(records: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, split, source, loads, text_key): the distinct records in each split they are in.

    A null or blank split is that of the record's load in the plan; a load in
    two splits places its record in both. ``loads`` are the keys of the load in
    group_id and source_id. text_key is the digest of all user messages.
    """
    load_of = lambda c: canonical_key(F.substring_index(c, ":", -1))
    base = records.filter("id is not null").select(
        "id",
        F.when(F.trim("split") != "", F.trim("split")).alias("split"),
        F.substring_index("source_id", ":", 1).alias("source"),
        F.array_distinct(F.array_compact(F.array(load_of("group_id"), load_of("source_id")))).alias("loads"),
        text_key(_user_text()).alias("text_key"),
    )
    base = written(base.distinct(), "zstd")
    planned = plan.select(canonical_key("load_id").alias("load"), F.trim("split").alias("plan_split")).filter("load is not null and plan_split <> ''").distinct()
    lost = base.filter("split is null").withColumn("load", F.explode("loads")).join(planned, "load").withColumn("split", F.col("plan_split")).drop("load", "plan_split")
    return base.filter("split is not null").unionByName(lost.distinct())


def cross_split_pairs(records: DataFrame, plan: DataFrame, share: float = 0.2) -> DataFrame:
    """(id_a, id_b, train_id, eval_id, eval_split, source, by_load, distance): train and evaluation records that are the same.

    Two records are the same where they name one load or where their user
    messages, without the first line, case and spacing, differ in at most
    ``share`` of the words of the longer. distance is null where only the load
    is common. Texts are compared once per distinct text and expanded to ids at
    the end. Records without text match by load only, records without load by
    text only; records in neither a train nor an evaluation split, and null
    ids, are left out. Copies of a row change nothing; empty tables give no rows.
    """
    return _expanded(*_matched(records, plan, share), records.count())


def _matched(records: DataFrame, plan: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evaluation records, training records, pairs of their texts)."""
    ids = placed_records(records, plan)
    is_eval, is_train = F.col("split").isin(*EVAL_SPLITS), F.col("split") == "train"
    sides = ids.filter(is_eval | is_train).groupBy("text_key").agg(F.bool_or(is_eval).alias("evals"), F.bool_or(is_train).alias("trains"))
    # Different texts once, with the sides they are on.
    read = with_body(records.filter("id is not null").select(text_key(_user_text()).alias("text_key"), _user_text().alias("text")))
    texts = written(read.groupBy("text_key").agg(F.max("body").alias("body")).join(sides, "text_key").withColumnRenamed("text_key", "key"), "zstd")
    near = near_texts(texts.filter("evals").select("key", "body"), texts.filter("trains").select("key", "body"), share)
    e = ids.filter(is_eval).select(F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), "source", F.col("text_key").alias("eval_key"), F.col("loads").alias("eval_loads"))
    t = ids.filter(is_train).select(F.col("id").alias("train_id"), F.col("text_key").alias("train_key"), F.col("loads").alias("train_loads")).distinct()
    return e, t, near


def _expanded(e: DataFrame, t: DataFrame, near: DataFrame, rows: int) -> DataFrame:
    columns = ["train_id", "eval_id", "eval_split", "source", "by_load", "distance"]
    near = near.select("eval_key", "train_key", "distance").distinct()
    of_train, of_eval = t.withColumn("load", F.explode("train_loads")), e.withColumn("load", F.explode("eval_loads"))
    # Keys that hold a two-hundredth of the rows of their side: few by that, so they are looked up once for the three joins.
    sides = {"eval_key": (e, F.col("eval_key")), "train_key": (t, F.col("train_key")), "load": (of_train, F.encode("load", "utf-8"))}
    every = reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("side"), c.alias("key")) for k, (d, c) in sides.items()])
    hot = hot_keys(every, ["side", "key"], rows, 0.005, HOT_ROWS).collect() if rows >= HOT_ROWS else []

    def join(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
        mine = [r["key"] for r in hot if r["side"] == key]
        if not mine:
            return left.join(right, key)
        some = left.sparkSession.createDataFrame([(bytes(k),) for k in mine], f"{key} binary")
        if key == "load":
            some = some.select(F.decode("load", "utf-8").alias("load"))
        return salted_join(left, right, [key], some, spread, "inner")

    found = join(e, near, "eval_key", "eval_id")
    by_text = join(t, found, "train_key", "train_id").withColumn("by_load", F.lit(False)).select(*columns)
    by_load = join(of_train, of_eval, "load", "train_id").withColumn("by_load", F.lit(True)).withColumn("distance", F.lit(None).cast("int")).select(*columns)
    both = reduce(DataFrame.unionByName, [by_text, by_load]).filter("train_id <> eval_id")
    return (
        both.groupBy("train_id", "eval_id", "eval_split", "source")
        .agg(F.max("by_load").alias("by_load"), F.min("distance").alias("distance"))
        .select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"), *columns)
    )


def evaluation_coverage(records: DataFrame, plan: DataFrame, share: float = 0.2) -> DataFrame:
    """(eval_id, eval_split, source, n_texts, least_distance, covered_words) of the evaluation records with a near training text.

    covered_words counts the words in the union of the intervals matched in any
    of the ``n_texts`` different training texts. Records of one id, split and
    source with several texts are one row: the text most covered holds.
    """
    e, _, near = _matched(records, plan, share)
    one = near.groupBy("eval_key", "train_key").agg(F.min("distance").alias("distance"), F.first("spans").alias("spans"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2 - 1).cast("int")), lambda i: F.struct(F.get("spans", i * 2).alias("a"), F.get("spans", i * 2 + 1).alias("b")))
    pairs = F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<a: int, b: int>>"))
    merged = one.groupBy("eval_key").agg(F.count(F.lit(1)).alias("n_texts"), F.min("distance").alias("least_distance"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(pairs)))).alias("rs"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("rs", start, lambda x, r: F.struct(F.greatest(x["end"], r["b"]).alias("end"), (x["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(x["end"], r["a"]))).alias("n")))["n"]
    found = merged.select("eval_key", F.struct(covered.alias("covered_words"), "n_texts", (-F.col("least_distance")).alias("d")).alias("m"))
    return (
        e.join(found, "eval_key").groupBy("eval_id", "eval_split", "source").agg(F.max("m").alias("m"))
        .select("eval_id", "eval_split", "source", "m.n_texts", (-F.col("m.d")).alias("least_distance"), "m.covered_words")
    )
