"""Best rollup vendor for each legacy vendor record, without pairing groups.

The score of a candidate depends only on which of id, name and department
agree, so the best candidate per key combination is prepared first (one row per
key) and each record makes six unique-key lookups instead of meeting every
candidate of its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S

# Points for an equal id, name and department; accepted from 3.
ID_POINTS, NAME_POINTS, DEPT_POINTS = 4, 3, 1

_LOOKUPS = [("id", "name", "dept"), ("id", "name"), ("id", "dept"), ("name", "dept"), ("id",), ("name",)]
_POINTS = {"id": ID_POINTS, "name": NAME_POINTS, "dept": DEPT_POINTS}


def best_match(records: DataFrame, vendors: DataFrame) -> DataFrame:
    """``records`` with score, matched dept and vendor (null below 3 points).

    Ties go to the first candidate by department, ordered dollars, vendor key.
    """
    candidates = vendors.select(
        "season",
        S.nonblank("vendor_id").alias("k_id"),
        S.nonblank(S.norm_name("vendor_name")).alias("k_name"),
        S.nonblank(S.norm_name("dept_id")).alias("k_dept"),
        F.struct(
            "dept_id", (-F.col("ordered")).alias("neg_ordered"), "vendor_key", "vendor_id",
            "vendor_name", *[F.col(m).alias(f"new_{m}") for m in ("ordered", "received", "sold")],
        ).alias("cand"),
    )
    out = records.withColumns(
        {
            "k_id": S.nonblank("vendor_id"),
            "k_name": S.nonblank(S.norm_name("vendor_name")),
            "k_dept": S.nonblank(S.norm_name("dept_name")),
        }
    )
    hits = []
    for fields in _LOOKUPS:
        keys = [f"k_{f}" for f in fields]
        alias = "c_" + "_".join(fields)
        best = candidates.groupBy("season", *keys).agg(F.min("cand").alias(alias))
        out = out.join(best, ["season", *keys], "left")
        points = sum(_POINTS[f] for f in fields)
        hit = F.when(
            F.col(alias).isNotNull(),
            F.struct(F.lit(-points).alias("neg"), F.col(alias).alias("cand")),
        )
        hits.append(hit)
    best_hit = F.array_min(F.array_compact(F.array(*hits)))
    columns = [c for c in records.columns]
    return out.withColumn("_hit", best_hit).select(
        *columns,
        (-F.col("_hit.neg")).alias("score"),
        F.col("_hit.cand.dept_id").alias("match_dept_id"),
        F.col("_hit.cand.vendor_key").alias("match_vendor_key"),
        F.col("_hit.cand.vendor_id").alias("match_vendor_id"),
        F.col("_hit.cand.vendor_name").alias("match_vendor_name"),
        *[F.col(f"_hit.cand.new_{m}").alias(f"new_{m}") for m in ("ordered", "received", "sold")],
    )
