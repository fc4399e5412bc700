"""Evaluation passages inside training documents: pigeonhole pieces and Myers bit-parallel distance.

A window of ``min_words`` words that occurs with at most ``k`` word edits holds
``k + 1`` whole pieces of the item, one of which is untouched. So all items are
cut into pieces, an automaton finds every piece in each whole document, and
every window that holds a hit is verified by Myers' algorithm over words; the
answer is made of verified windows alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import words
from millrace.session import cut, hot_keys, salted_join

#: Characters of items in one automaton: up to so many are broadcast, more are cut into blocks of about this size.
BLOCK_CHARS = 4_000_000
#: Documents in one cell of a block: bounds a task's memory, not what is compared.
CELL_DOCS = 50_000


def piece_words(min_words: int, max_edits: int) -> int:
    """Longest piece such that every window of ``min_words`` words holds ``max_edits + 1`` whole aligned pieces."""
    size = (min_words + 1) // (max_edits + 2)
    if size < 1:
        raise ValueError("min_words is too small for the error budget")
    return size


def myers_search(pattern: list[str], text: list[str]) -> int:
    """Least edit distance (words) between ``pattern`` and any stretch of ``text``: Myers 1999, one integer as bit vector."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return best


class ItemIndex:
    """Automaton over the pieces of the items, built once in each Python worker."""

    def __init__(self, items: list[tuple[str, str]], min_words: int, max_edits: int):
        import ahocorasick

        self.k, self.min_words, self.size = max_edits, min_words, piece_words(min_words, max_edits)
        self.items = [(i, words(p)) for i, p in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, ws) in enumerate(self.items):
            for at in range(0, len(ws) - self.size + 1, self.size):
                pieces.setdefault(" " + " ".join(ws[at : at + self.size]) + " ", []).append((n, at))
        self.machine = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.machine.add_word(p, (len(p), places))
        if pieces:
            self.machine.make_automaton()
        self.empty = not pieces

    def search(self, text: str | None) -> Iterator[tuple[str, int, int, int]]:
        """(item, words of the item in windows without an edit, in windows within the budget, least edits of a window), by Myers' distance of each window around a hit."""
        doc = words(text)
        if self.empty or len(doc) < self.size:
            return
        flat = " " + " ".join(doc) + " "
        hits: dict[int, set[tuple[int, int]]] = {}
        seen, count = 0, 0
        for end, (length, places) in self.machine.iter(flat):
            start = end - length + 1
            count += flat.count(" ", seen, start)
            seen = start
            for n, at in places:
                hits.setdefault(n, set()).add((at, count))
        for n, found in hits.items():
            item_id, item = self.items[n]
            # Windows of the item that hold a hit, with where they would begin in the document.
            windows = {(s, pos - at + s) for at, pos in found for s in range(max(0, at + self.size - self.min_words), min(at, len(item) - self.min_words) + 1)}
            edits, exact, covered = self.k + 1, set(), set()
            for s, begin in windows:
                d = myers_search(item[s : s + self.min_words], doc[max(0, begin - self.k) : max(0, begin + self.min_words + self.k)])
                if d <= self.k:
                    edits = min(edits, d)
                    covered.update(range(s, s + self.min_words))
                    if d == 0:
                        exact.update(range(s, s + self.min_words))
            if covered:
                yield item_id, len(exact), len(covered), edits


def piece_hashes(ws: list[str], size: int, step: int) -> list[int]:
    """Distinct signed 64-bit hashes of the pieces of ``size`` words that begin at every ``step``-th word."""
    import xxhash

    return sorted({xxhash.xxh64_intdigest(" ".join(ws[i : i + size])) - (1 << 63) for i in range(0, len(ws) - size + 1, step)})


def _found(index: ItemIndex, ids, texts) -> pd.DataFrame:
    rows = [(d, *hit) for d, t in zip(ids, texts, strict=True) for hit in index.search(t)]
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "exact_words", "covered_words", "edits"])


def _by_broadcast(docs: DataFrame, named: DataFrame, schema: str, min_words: int, max_edits: int) -> DataFrame:
    """Every document against one automaton over all items, whose size has been checked."""
    shared = docs.sparkSession.sparkContext.broadcast([(r["i"], r["p"]) for r in named.collect()])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ItemIndex(shared.value, min_words, max_edits)
        for pdf in batches:
            yield _found(index, pdf["doc_id"], pdf["text"])

    return docs.mapInPandas(search, schema)


def _by_routing(docs: DataFrame, named: DataFrame, schema: str, min_words: int, max_edits: int, chars: int) -> DataFrame:
    """Items in blocks by hash; a document meets only the blocks one of whose pieces it holds. Nothing comes to the driver."""
    size, blocks = piece_words(min_words, max_edits), max(1, -(-chars // BLOCK_CHARS))
    placed = cut(named.withColumn("block", F.pmod(F.xxhash64("i", "p"), F.lit(blocks)).cast("int")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(h, b) for t, b in zip(pdf["p"], pdf["block"], strict=True) for h in piece_hashes(words(t), size, size)], columns=["h", "block"])

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(u, h) for u, t in zip(pdf["u"], pdf["text"], strict=True) for h in piece_hashes(words(t), size, 1)], columns=["u", "h"])

    # A document is named by its id and text: rows of one id may differ.
    keyed = docs.withColumn("u", F.md5(F.concat_ws("\0", F.col("doc_id").cast("string"), "text"))).dropDuplicates(["u"])
    wanted = placed.mapInPandas(of_items, "h bigint, block int").groupBy("h").agg(F.collect_set("block").alias("in_blocks"))
    held = cut(keyed.select("u", "text").mapInPandas(of_docs, "u string, h bigint"))
    rows = held.count()
    meets = salted_join(held, wanted, ["h"], hot_keys(held, ["h"], rows), "u", "inner").select("u", F.explode("in_blocks").alias("block")).distinct()
    cells = max(1, -(-keyed.count() // CELL_DOCS))
    at = F.pmod(F.xxhash64("u"), F.lit(cells)).cast("int")
    right = meets.join(keyed, "u").withColumn("cell", at)
    left = placed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def search(items: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        index = ItemIndex(list(zip(items["i"], items["p"], strict=True)) if len(some) else [], min_words, max_edits)
        return _found(index, some["doc_id"], some["text"])

    by, n = ["block", "cell"], min(blocks * cells, 100_000)
    out = left.repartition(n, *by).groupBy(*by).cogroup(right.repartition(n, *by).groupBy(*by)).applyInPandas(search, schema)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), *[c for c in out.columns if c != "doc_id"])


def find_leaks(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", min_words: int = 12, max_edits: int = 1
) -> DataFrame:
    """(doc_id, item_id, exact_words, covered_words, edits): documents with a window of an item within ``max_edits`` word edits.

    exact_words and covered_words count the words of the item in windows of
    ``min_words`` words whose distance to the document is 0 or within the
    budget; edits is the least distance. Items of up to ``BLOCK_CHARS``
    characters in all, which is measured, are one broadcast automaton; more are
    cut into blocks, and each document goes to the blocks it shares a piece
    with. Null texts and passages, and items of fewer than ``min_words`` words,
    match nothing; rows of one doc_id (or null doc_id) count as one document;
    extra columns are not read. Empty tables give no rows.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id string, exact_words int, covered_words int, edits int"
    named = items.filter(F.col(passage_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(passage_col).alias("p")).distinct()
    chars = int(named.agg(F.sum(F.length("p") + F.length(F.coalesce("i", F.lit("")))).alias("n")).first()["n"] or 0)
    out = _by_broadcast(docs, named, schema, min_words, max_edits) if chars <= BLOCK_CHARS else _by_routing(docs, named, schema, min_words, max_edits, chars)
    return out.groupBy("doc_id", "item_id").agg(
        F.max("exact_words").alias("exact_words"), F.max("covered_words").alias("covered_words"), F.min("edits").alias("edits")
    )
