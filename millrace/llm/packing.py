"""Texts into containers of fixed token capacity: vector best-fit within blocks.

Texts are counted in tokens of a public tokenizer. What exceeds the capacity is
split: full containers of its own, and a rest that is packed like any item. The
items are spread over blocks by a hash, whose number grows with the items;
within a block, in decreasing order, each goes to the open container whose
weighted residual (tokens, documents, attention cost) it leaves smallest, among
those that hold it under every constraint. A block wastes at most its last
containers, so the loss does not grow with the data.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Items of one block: bounds the work and memory of a task, and the share of containers left open at its end.
BLOCK_ITEMS = 4000
#: Documents in a container, and its attention cost (sum of squared lengths) as a share of that of one full text.
MAX_DOCS = 96
ATTENTION = 0.9
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, h) of every row with a text; whole texts, h their hash. ``tokenizer`` is the path of a .tiktoken file on the driver."""
    with open(tokenizer or tokenizer_path(), "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).filter("text is not null and text <> ''")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": pd.Series([len(encode(t)) for t in pdf["text"]], dtype="int64"), "h": pdf["h"]})

    return docs.mapInPandas(count, f"doc_id {kind}, n_tokens bigint, h bigint")


def best_fit(tokens: np.ndarray, capacity: int, max_docs: int, attention: float, weights: tuple[float, float, float]) -> np.ndarray:
    """Container number of each item. Items come in any order and are taken by decreasing size, equal ones as they stand.

    A container holds at most ``capacity`` tokens, ``max_docs`` items and an
    attention cost (sum of squares of lengths) of ``attention`` * capacity^2; an
    item that alone costs more than that gets a container of its own.
    """
    n = len(tokens)
    out = np.zeros(n, np.int64)
    order = np.argsort(-tokens, kind="stable")
    need = np.stack([tokens / capacity, np.full(n, 1.0 / max_docs), (tokens / capacity) ** 2 / attention], axis=1)
    w = np.asarray(weights, np.float64) ** 2
    room = np.empty((n, 3))
    number = np.empty(n, np.int64)
    live = made = 0
    smallest = float(need[order[-1], 0]) if n else 0.0
    for i in order:
        v = need[i]
        best = -1
        if live:
            left = room[:live] - v
            fits = (left >= -1e-12).all(axis=1)
            if fits.any():
                at = np.flatnonzero(fits)
                best = int(at[np.argmin((left[at] ** 2) @ w)])
        if best < 0:
            best, live = live, live + 1
            number[best], room[best] = made, 1.0
            made += 1
        out[i] = number[best]
        room[best] -= v
        if room[best, 0] < smallest - 1e-12 or room[best, 1] < 1e-12 or room[best, 2] <= 0:  # nothing fits any more
            live -= 1
            room[best], number[best] = room[live], number[live]
    return out


def pack(
    documents: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    max_docs: int = MAX_DOCS,
    attention: float = ATTENTION,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.1),
) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, first_token, n_tokens): a packing of all texts for every kind of container.

    A container holds at most its capacity in tokens, ``max_docs`` items and
    ``attention`` * capacity^2 of attention cost; an item that alone costs more
    has a container of its own. Which items share a container depends on the
    rows alone, not on how files and tasks divide them.
    Only texts longer than the capacity are split, into pieces 0, 1, ... of
    which all but the last fill a container. Null and empty texts have no
    tokens and are left out; every other row is an item, copies and rows of
    equal ids included. Targets with a null or non-positive capacity get
    nothing; extra columns are not read.
    """
    kinds = {r["container_kind"]: int(r["capacity_tokens"]) for r in targets.collect() if r["container_kind"] and r["capacity_tokens"] and r["capacity_tokens"] > 0}
    counted = cut(token_counts(documents, id_col, text_col, tokenizer).filter("n_tokens > 0").groupBy("doc_id", "n_tokens", "h").agg(F.count(F.lit(1)).alias("_n")))
    blocks = max(1, -(-int(counted.agg(F.sum("_n")).first()[0] or 0) // BLOCK_ITEMS))
    # Equal rows are numbered, so that a document of many copies is spread over the blocks too.
    counted = counted.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).withColumn("_u", F.xxhash64("doc_id", "h", "_c"))
    kind = counted.schema["doc_id"].dataType.simpleString()
    schema = f"container_kind string, container_id string, doc_id {kind}, piece bigint, first_token bigint, n_tokens bigint"
    if not kinds:
        return documents.sparkSession.createDataFrame([], schema)
    sizes = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("cap")) for k, c in sorted(kinds.items())])
    items = counted.select("doc_id", "h", "_c", "_u", "n_tokens", F.explode(sizes).alias("c")).select("doc_id", "h", "_c", "_u", "n_tokens", "c.*")
    n, cap = F.col("n_tokens"), F.col("cap")
    full = (
        items.filter(n > cap)
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(n / cap) - 1)).alias("piece"))
        .select("container_kind", F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", F.hex("h"), "_c", "piece").alias("container_id"), "doc_id", "piece", (F.col("piece") * cap).alias("first_token"), cap.alias("n_tokens"))
    )
    rest = items.select(
        "container_kind", "doc_id", "h", "_u", "cap",
        F.when(n > cap, F.floor(n / cap)).otherwise(F.lit(0)).cast("bigint").alias("piece"),
        F.when(n > cap, n % cap).otherwise(n).alias("n_tokens"),
        F.pmod("_u", F.lit(blocks)).alias("block"),
    ).filter("n_tokens > 0")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "_u", "h"], ascending=[False, True, True])
        c = int(pdf["cap"].iloc[0])
        number = best_fit(pdf["n_tokens"].to_numpy(np.float64), c, max_docs, attention, weights)
        head = f"{pdf['container_kind'].iloc[0]}-{pdf['block'].iloc[0]}-"
        return pd.DataFrame({
            "container_kind": pdf["container_kind"], "container_id": [f"{head}{i}" for i in number], "doc_id": pdf["doc_id"],
            "piece": pdf["piece"], "first_token": pdf["piece"] * pdf["cap"], "n_tokens": pdf["n_tokens"],
        })

    packed = rest.groupBy("container_kind", "block").applyInPandas(place, schema)
    return full.select(*packed.columns).unionByName(packed)


def container_use(packed: DataFrame, targets: DataFrame, max_docs: int = MAX_DOCS, attention: float = ATTENTION) -> DataFrame:
    """(container_kind, n_containers, n_items, n_tokens, used_share, share and number at its limit for each capacity): how full the containers are.

    A container is at a limit where no further text fits under it: less than
    the shortest text of its kind in tokens, no document, or, while tokens are
    left, less attention cost than that text has.
    """
    caps = targets.groupBy("container_kind").agg(F.max("capacity_tokens").alias("cap"))
    least = packed.groupBy("container_kind").agg(F.min("n_tokens").alias("least"))
    each = (
        packed.groupBy("container_kind", "container_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("squares"))
        .join(F.broadcast(caps), "container_kind").join(F.broadcast(least), "container_kind")
        .withColumn("cost", F.col("squares") / (attention * F.col("cap").cast("double") ** 2))
    )
    step = F.col("least").cast("double") ** 2 / (attention * F.col("cap").cast("double") ** 2)
    full_tokens, full_docs = F.col("tokens") + F.col("least") > F.col("cap"), F.col("docs") >= max_docs
    mean = lambda c: F.round(F.avg(c), 6)
    return each.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("docs").alias("n_items"), F.sum("tokens").alias("n_tokens"), mean(F.col("tokens") / F.col("cap")).alias("used_share"),
        mean(F.col("docs") / max_docs).alias("docs_share"), mean(F.least("cost", F.lit(1.0))).alias("attention_share"), F.count_if(full_tokens).alias("n_at_tokens"), F.count_if(full_docs).alias("n_at_docs"),
        F.count_if(~full_tokens & (F.col("cost") + step > 1)).alias("n_at_attention"),
    )
