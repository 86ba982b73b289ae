"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources weigh as given, share `budget` together, and stop at `max_epochs` times
their own size; what a full source leaves is shared again by weight (water filling,
solved exactly from the sorted ratios of cap to weight).

Selection: a source first takes every document as often as its target holds whole passes. The rest of
its budget is fitted by length: documents are counted by exact length, and from the longest length down
each gives the same share of its words, rounded so that what one length is over or under goes to the next
shorter one. A bounded-knapsack dynamic programme then fits the last `FITTED` documents anew, so that the sum
comes as near to the budget as it can. Which documents of a length are taken follows from a
seeded hash of their id, so reruns agree.

Distributed work: lengths are counted with map-side partial sums; the budget fitting sees one row per
(source, length), never per document; the seeded ranks are taken inside small hash
buckets of a (source, length) group, so a length shared by a third of all rows is
spread over many tasks.

Defined results: null text has length 0; documents of length 0 are taken once per whole pass and never change a sum; a
null source is a source of its own, last in order; repeated rows are documents of their own (equal
rank ties take interchangeable counts); an empty table gives an empty result; a zero total gives zero
targets; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import prepare, stored

#: Documents of one (source, length) group that one seeded bucket holds on average.
BUCKET_ROWS = 200
#: Shortest documents of the even share that the dynamic programme may choose anew, besides those not taken.
FITTED = 32


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget_share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """Per source (column `source`, `source_size`): `source_no` (order by code point, null last), `weight`, `target`.

    One row per source comes in. With ratio r = cap / weight, sources fill up in order of r:
    the water level is (budget - caps of the full sources) / (weights of the others).
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    numbered = (sizes.withColumn("source_no", F.row_number().over(order)).withColumn("weight", w)
                .withColumn("cap", (F.col("source_size") * max_epochs).cast("double")))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    whole = Window.partitionBy()
    filled = numbered.select(
        "*", F.sum(F.col("source_size")).over(whole).alias("total"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("below"),
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight"))
    level = (F.col("total") * F.lit(float(budget_share)) - F.col("below")) / F.col("open_weight")
    # the first source that stays open at its own level fixes the level of all that follow
    open_level = F.min(F.when(level * F.col("weight") <= F.col("cap"),
                              F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), level.alias("level"))))
    found = filled.select("*", open_level.over(whole).getField("level").alias("level"))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return found.select("source", "source_no", "source_size", "weight", target.alias("target"))


def even_share(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents of each length so that, from the longest down, the words taken keep to the same share of the words."""
    lengths, counts = lengths.tolist(), counts.tolist()
    total, seen, taken = sum(s * n for s, n in zip(lengths, counts)), 0, 0
    take = [n * budget // total for n in counts]  # stays for documents without a word
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size, n = lengths[k], counts[k]
        if size:
            seen += size * n
            take[k] = min(max((2 * (budget * seen - taken * total) + total * size) // (2 * total * size), 0), n)
            taken += size * take[k]
    return np.array(take, dtype=np.int64)


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the lengths sum to `budget`, or as near as can be.

    Every length first gives the same share. The shortest `FITTED` of these documents, and more while the sum is above the
    budget, are given back, and bounded-knapsack dynamic programming over them, and then over the other documents left from the
    shortest up, finds the reachable sum nearest to the gap; it ends once the gap itself is reached. Reachable sums are the bits of an integer; each length's copies are split in powers of two.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    take = even_share(lengths, counts, budget)
    gap, spare, given = budget - int((take * lengths).sum()), FITTED, np.zeros(len(lengths), dtype=np.int64)
    if gap == 0:
        return take
    upward = np.argsort(lengths, kind="stable")
    for k in upward:
        size = int(lengths[k])
        given[k] = min(int(take[k]), max(spare, -(gap // size) if gap < 0 else 0)) if size else 0
        gap += int(given[k]) * size
        spare = max(spare - int(given[k]), 0)
        if not spare and gap >= 0:
            break
    take -= given
    if gap <= 0:
        return take
    bits, items, seen = 1, [], [1]
    mask = (1 << (2 * gap + 1)) - 1
    for k, left in [(k, given[k]) for k in upward if given[k]] + [(k, counts[k] - take[k] - given[k]) for k in upward]:
        size, part = int(lengths[k]), 1
        if size == 0 or size > 2 * gap:
            continue
        if bits >> gap & 1:
            break
        left = min(int(left), 2 * gap // size)
        while left > 0:
            n = min(part, left)
            grown = (bits | bits << (n * size)) & mask
            if grown != bits:
                bits = grown
                items.append((k, n, size))
                seen.append(bits)
            left -= n
            part *= 2
    below = (bits & ((1 << (gap + 1)) - 1)).bit_length() - 1
    above_bits = bits >> (gap + 1)
    best = below
    if above_bits:
        above = gap + 1 + ((above_bits & -above_bits).bit_length() - 1)
        if above - gap < gap - below:
            best = above
    for i in range(len(items) - 1, -1, -1):
        if not seen[i] >> best & 1:
            k, n, size = items[i]
            take[k] += n
            best -= n * size
    return take


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size", kind="stable").reset_index(drop=True)
    target, size = float(frame["target"].iloc[0]), int(frame["source_size"].iloc[0])
    passes = int(target // size) if size else 0
    rest = int(round(target)) - passes * size
    more = fit_counts(frame["size"].to_numpy(), frame["n"].to_numpy(), rest)
    return pd.DataFrame({"source_no": frame["source_no"], "size": frame["size"], "n": frame["n"],
                         "passes": passes, "extra": more})


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget_share: float = 1.5,
                  max_epochs: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source") -> DataFrame:
    """One decision per row of `docs`: id, `source`, `size`, `source_size`, `target`, `copies` (0 to `max_epochs`).

    The texts are read once, for their lengths; everything after works on (id, source, size, seeded hash).
    """
    prepare(docs.sparkSession)
    base = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("seeded")), "mix-lengths")
    counted = base.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(sizes, weights, budget_share, max_epochs), "mix-targets")
    same_source = counted["source"].eqNullSafe(targets["source"])
    fitted = (counted.join(targets, same_source)
              .select("source_no", "size", "n", "source_size", "target")
              .groupBy("source_no").applyInPandas(_fit, "source_no int, size long, n long, passes long, extra long"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(BUCKET_ROWS)))
    plan = stored(fitted.join(targets, "source_no").select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", "passes",
        "extra", buckets.alias("buckets")), "mix-plan")
    rows = base.join(plan, base["source"].eqNullSafe(plan["p_source"]) & (base["size"] == plan["p_size"]))
    rows = rows.withColumn("bucket", F.pmod(F.col("seeded"), F.col("buckets")))
    held = (rows.groupBy("p_source", "p_size", "bucket").agg(F.count("*").alias("held"), F.max("extra").alias("all_extra"))
            .withColumn("before", F.sum("held").over(
                Window.partitionBy("p_source", "p_size").orderBy("bucket")) - F.col("held"))
            .select(F.col("p_source").alias("h_source"), F.col("p_size").alias("h_size"),
                    F.col("bucket").alias("h_bucket"),
                    F.least(F.greatest(F.col("all_extra") - F.col("before"), F.lit(0)), F.col("held")).alias("share")))
    rank = F.row_number().over(Window.partitionBy("p_source", "p_size", "bucket").orderBy("seeded", "id"))
    ranked = rows.withColumn("rank", rank)
    out = ranked.join(held, ranked["p_source"].eqNullSafe(held["h_source"]) & (ranked["p_size"] == held["h_size"])
                      & (ranked["bucket"] == held["h_bucket"]))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target",
                      (F.col("passes") + (F.col("rank") <= F.col("share")).cast("long")).alias("copies"))
