"""Changes between full snapshots (general problem 3) and the single-diff operators of a watchlist.

Rows are range-partitioned and sorted by (profile, file_path, snapshot_no, newest delivery first).  One streaming pass
over each range then walks the sorted entries of consecutive snapshots side by side, the way two sorted lists are
merged with two pointers: entries of the same key meet next to each other, a key that stands in only one of two
consecutive snapshots was added or removed, a key in both is compared column by column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _same(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Equality where null equals null."""
    return ((a.isna() & b.isna()) | (a == b).fillna(False)).to_numpy(dtype=bool)


def _merge_range(batches: Iterator[pd.DataFrame], compare: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Two-pointer merge over one sorted range; an unfinished key is carried into the next batch."""
    carry: pd.DataFrame | None = None

    def emit(rows: pd.DataFrame) -> pd.DataFrame:
        # the newest delivery of an entry comes first; the others are older copies
        key = ["_g", "_k", "_no"]
        rows = rows[~rows.duplicated(key)]
        rows = rows[rows["_there"].to_numpy(dtype=bool)].reset_index(drop=True)
        g, k, no = rows["_g"].to_numpy(), rows["_k"].to_numpy(), rows["_no"].to_numpy()
        meets = np.zeros(len(rows), dtype=bool)  # the row before is the same key in the snapshot before
        meets[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1]) & (no[:-1] == rows["_before"].to_numpy()[1:])
        left = np.zeros(len(rows), dtype=bool)  # the row after is the same key in the snapshot after
        left[:-1] = meets[1:]
        differs = np.zeros(len(rows), dtype=bool)
        prev = rows.shift(1)
        for c in compare:
            differs |= ~_same(rows[c], prev[c])
        added = ~meets & rows["_later"].to_numpy(dtype=bool)
        gone = ~left & rows["_sooner"].to_numpy(dtype=bool)
        kinds = ((added, no, "added"), (meets & differs, no, "changed"), (gone, rows["_after"].to_numpy(), "removed"))
        return pd.DataFrame(
            {
                "_g": np.concatenate([g[m] for m, _, _ in kinds]), "_no": np.concatenate([n[m] for m, n, _ in kinds]),
                "_k": np.concatenate([k[m] for m, _, _ in kinds]), "diff": np.repeat(np.array([w for _, _, w in kinds], dtype=object), [m.sum() for m, _, _ in kinds]),
            }
        )

    for batch in batches:
        rows = batch if carry is None or carry.empty else pd.concat([carry, batch], ignore_index=True)
        if rows.empty:
            continue
        last = rows.iloc[-1]
        open_key = ((rows["_g"] == last["_g"]) & (rows["_k"] == last["_k"])).to_numpy()
        carry = rows[open_key]
        # of the open key only the newest copy of each snapshot is needed, so the carry stays as small as the snapshots
        carry = carry[~carry.duplicated(["_g", "_k", "_no"])]
        yield emit(rows[~open_key])
    if carry is not None and not carry.empty:
        yield emit(carry)


def _plain(name: str, kind: str):
    """A column whose text is equal where its values are: 0.0 and -0.0 are one value."""
    return F.col(name) + F.lit(0).cast(kind) if kind in ("double", "float") else F.col(name)


def snapshot_changes(
    rows: DataFrame,
    group: str = "profile",
    number: str = "snapshot_no",
    key: str = "file_path",
    delivered: str = "delivered_at",
    compare: Sequence[str] = ("size", "mtime"),
    marker: str | None = "diff",
) -> DataFrame:
    """Added, removed and changed keys of each snapshot against the group's latest earlier snapshot.

    Output: ``group, number, key, diff``.  Defined cases: of several rows for one entry the latest ``delivered`` holds
    (null counts as oldest; of equal times the one with the greater compared values, then a row that is no removal);
    a row whose ``marker`` is ``removed`` says that the key isn't there; a null marker means nothing.  Null equals null
    when columns are compared.  Rows without group, number or key belong to no snapshot and are left out.  A group's
    first snapshot has no changes, one snapshot or an empty table gives no rows.  A snapshot exists when any row names
    it.  Columns not named here are ignored, whatever they are called.
    """
    there = F.coalesce(F.col(marker) != F.lit("removed"), F.lit(True)) if marker else F.lit(True)
    base = rows.select(
        F.col(group).alias("_g"), F.col(number).cast("int").alias("_no"), F.col(key).alias("_k"),
        F.col(delivered).alias("_at"), there.alias("_there"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(compare)],
    ).where(F.col("_g").isNotNull() & F.col("_no").isNotNull() & F.col("_k").isNotNull())
    order = Window.partitionBy("_g").orderBy("_no")
    calendar = (
        base.groupBy("_g", "_no").agg(F.count(F.lit(1)).alias("_n"))
        .select("_g", "_no", F.lag("_no").over(order).alias("_before"), F.lead("_no").over(order).alias("_after"))
        # whether there is a snapshot before and after; a group's first snapshot meets itself as the one before, its last as the one after
        .select("_g", "_no", F.coalesce("_before", "_no").alias("_before"), F.coalesce("_after", "_no").alias("_after"), F.col("_before").isNotNull().alias("_later"), F.col("_after").isNotNull().alias("_sooner"))
    )
    values, types = [f"_v{i}" for i in range(len(compare))], dict(base.dtypes)
    laid = (
        base.join(calendar, ["_g", "_no"])
        .repartitionByRange(F.col("_g"), F.col("_k"))
        .sortWithinPartitions("_g", "_k", "_no", F.col("_at").desc_nulls_last(), *[F.col(v).desc_nulls_last() for v in values], F.col("_there").desc())
        .select("_g", "_k", "_no", "_before", "_after", "_later", "_sooner", "_there", *[_plain(v, types[v]).cast("string").alias(v) for v in values])
    )
    schema = f"_g {types['_g']}, _no int, _k {types['_k']}, diff string"
    found = laid.mapInPandas(lambda batches: _merge_range(batches, values), schema)
    return found.select(F.col("_g").alias(group), F.col("_no").alias(number), F.col("_k").alias(key), "diff")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "file_path", compare: Sequence[str] = ("size", "mtime")) -> DataFrame:
    """Watchlist diff of two snapshots: every path with ``None``, ``added``, ``changed`` or ``removed``.

    A sort-merge full outer join on the key.  Compared columns use null-safe equality; an empty side makes everything
    added or removed; keys are taken as unique in each side (repeated rows give repeated results).
    """
    a = old.select(F.col(key).alias("_k"), F.lit(True).alias("_old"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(compare)])
    b = new.select(F.col(key).alias("_k"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_n{i}") for i, c in enumerate(compare)])
    same = F.lit(True)
    for i in range(len(compare)):
        same = same & F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}"))
    diff = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "None").otherwise("changed")
    )
    return a.join(b, "_k", "full_outer").select(
        F.col("_k").alias(key), diff.alias("diff"), *[F.coalesce(f"_n{i}", f"_o{i}").alias(c) for i, c in enumerate(compare)]
    )


def consecutive_diffs(rows: DataFrame, group: str = "profile", number: str = "snapshot_no", key: str = "file_path", compare: Sequence[str] = ("size", "mtime")) -> DataFrame:
    """:func:`snapshot_diff` of every snapshot of every group with the group's snapshot before: ``group, number, key, diff``.

    rows: one row for each entry (no repeated ones).  A group's first snapshot is compared with nothing and left out.
    """
    calendar = rows.groupBy(group, number).agg(F.count(F.lit(1)).alias("_n")).withColumn("_to", F.lead(number).over(Window.partitionBy(group).orderBy(number)))
    first = calendar.groupBy(group).agg(F.min(number).alias("_first"))
    place = lambda no: F.struct(F.col(group).alias("g"), F.col(no).alias("n"), F.col(key).alias("k")).alias("_key")
    old = rows.join(calendar.where("_to IS NOT NULL"), [group, number]).select(place("_to"), *compare)
    new = rows.join(first, group).where(F.col(number) > F.col("_first")).select(place(number), *compare)
    return snapshot_diff(old, new, "_key", compare).select(F.col("_key.g").alias(group), F.col("_key.n").alias(number), F.col("_key.k").alias(key), "diff")


def diff_counts(diff: DataFrame) -> DataFrame:
    """Rows per diff state (added, changed, removed, None)."""
    return diff.groupBy("diff").agg(F.count(F.lit(1)).alias("n"))


def resolve_diff(tracked: DataFrame, committed: DataFrame, key: str = "file_path") -> DataFrame:
    """Mark committed paths as resolved: removed rows leave the snapshot, others get the state ``None``."""
    done = committed.select(key).distinct().withColumn("_done", F.lit(True))
    joined = tracked.join(done, key, "left")
    return (
        joined.where(~(F.col("_done").isNotNull() & (F.col("diff") == "removed")))
        .withColumn("diff", F.when(F.col("_done").isNotNull(), F.lit("None")).otherwise(F.col("diff")))
        .drop("_done")
    )

