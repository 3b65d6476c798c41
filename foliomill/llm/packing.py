"""Filling containers of fixed capacity with texts (problem 6): first-fit decreasing in randomised groups.

Sizes are tokens of a public tokenizer.  Items are dealt to groups by a hash; every group is packed on its own by
first-fit decreasing, the first container with room being found in a tournament tree of the containers' free space.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.session import materialize

#: Folder and file of the tokenizer; the folder must exist on every executor.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's texts are cut before its merges apply.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of a group; more items make more groups.
GROUP_ITEMS = 20_000


@cache
def _encoding(folder: str, vocabulary: str):
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of (doc_id, text): whole texts, null and empty ones with 0 tokens; rows without id are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInPandas(count, "doc_id long, n_tokens long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; ``sizes`` are in falling order, none above ``capacity``.

    A tournament tree holds in each node the largest free space below it, so the first container with room is found
    and updated in as many steps as the tree is high.
    """
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out = [0] * n
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out[i] = node - leaves
        free[node] -= size
        node //= 2
        while node:
            a, b = free[2 * node], free[2 * node + 1]
            best = a if a > b else b
            if free[node] == best:
                break
            free[node] = best
            node //= 2
    return np.array(out, dtype=np.int64)


def _pack_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True])
    bins = first_fit_decreasing(rows["n_tokens"].to_numpy(), int(rows["capacity"].iloc[0]))
    return pd.DataFrame(
        {
            "pack_id": rows["pack_id"], "container_id": (int(key[1]) << 32) + bins, "doc_id": rows["doc_id"],
            "piece_no": rows["piece_no"], "first_token": rows["first_token"], "n_tokens": rows["n_tokens"],
        }
    )


def pack(sizes: DataFrame, packs: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers for the items ``doc_id, n_tokens``, for each capacity of ``packs`` (pack_id, capacity_tokens).

    Output: ``pack_id, container_id, doc_id, piece_no, first_token, n_tokens``; every item once per capacity.  An item
    above the capacity is cut into pieces of exactly the capacity and a rest; no other item is split.  Empty items take
    no space and lie in the first container of their group; repeated rows are items of their own; null sizes count as
    0; capacities that are null or below 1 are left out; empty tables give no rows.  ``packs`` is the stated small set
    of container kinds, its rows are read by the driver.
    """
    kinds = packs.where("capacity_tokens >= 1 AND pack_id IS NOT NULL").select("pack_id", "capacity_tokens").distinct().collect()
    schema = "pack_id int, container_id long, doc_id long, piece_no int, first_token long, n_tokens long"
    if not kinds:
        return sizes.sparkSession.createDataFrame([], schema)
    kind = F.explode(F.array(*[F.struct(F.lit(r["pack_id"]).cast("int").alias("pack_id"), F.lit(r["capacity_tokens"]).cast("long").alias("capacity")) for r in kinds]))
    items = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("size"), kind.alias("k")).select("doc_id", "size", "k.*")
    last = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)) - 1
    pieces = (
        items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last.cast("int"))))
        .withColumn("first_token", F.col("piece_no") * F.col("capacity"))
        .withColumn("n_tokens", F.least(F.col("capacity"), F.col("size") - F.col("first_token")))
    )
    # a piece that fills its container needs no packing; the others are dealt to groups of about ``group_items`` pieces, counted for each capacity
    full = pieces.where("n_tokens = capacity")
    rest = materialize(pieces.where("n_tokens < capacity").select("pack_id", "capacity", "doc_id", "piece_no", "first_token", "n_tokens"), "pieces")
    counts = {r["pack_id"]: r["n"] for r in rest.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, -(-n // group_items))])[F.col("pack_id")] if counts else F.lit(1)
    # repeated rows must not all fall into one group, so their row number takes part in the deal
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece_no", F.monotonically_increasing_id()), groups))
    packed = dealt.select("pack_id", "grp", "capacity", "doc_id", "piece_no", "first_token", "n_tokens").groupBy("pack_id", "grp").applyInPandas(_pack_group, schema)
    # containers of full pieces are numbered below zero
    own = F.lit(-1).cast("long") - F.monotonically_increasing_id()
    return packed.unionByName(full.select("pack_id", own.alias("container_id"), "doc_id", "piece_no", "first_token", "n_tokens"))


def pack_documents(docs: DataFrame, packs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`pack` of the texts of ``docs``; each text is tokenized once, whatever the number of capacities."""
    return pack(materialize(token_counts(docs, folder, vocabulary), "sizes"), packs)


def fill(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """How well the containers are filled: ``pack_id, containers, items, tokens, filled`` (share of the space, 6 decimals)."""
    used = packed.groupBy("pack_id").agg(F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return used.join(packs.select("pack_id", "capacity_tokens"), "pack_id").select(
        "pack_id", "containers", "items", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled")
    )
