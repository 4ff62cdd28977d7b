"""Fault injection and row-set edits: derived values, null spikes, IN-updates,
IN-deletes and the generated demo mart.

``exact_share`` picks exactly ``round(share * n)`` rows in a repeatable
pseudo-random order (md5 of the key, ties by key) without sorting the table
and without a global LIMIT (which would pull the chosen rows through one
task).  It finds the cut-off key with a few bounded histogram passes over
md5 hex prefixes and then selects with a plain filter.
"""

from __future__ import annotations

import datetime as _dt
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference's demo scripts.
DERIVED_EMAIL_SEPARATOR = (" ", ".")
DERIVED_EMAIL_DOMAIN = "@jaffleshop.com"
GENERATED_EMAIL_DOMAIN = "@example.com"
GENERATED_NULL_SHARE = 0.4

_PREFIX = 4  # hex chars per histogram level -> at most 65536 buckets per pass


def derive_email(df: DataFrame, email_col: str, name_col: str) -> DataFrame:
    """Fill a NULL e-mail from the name: lower(replace(name,' ','.')) || domain."""
    derived = F.concat(
        F.lower(F.replace(F.col(name_col), F.lit(DERIVED_EMAIL_SEPARATOR[0]), F.lit(DERIVED_EMAIL_SEPARATOR[1]))),
        F.lit(DERIVED_EMAIL_DOMAIN))
    return df.withColumn(email_col, F.when(F.col(email_col).isNull(), derived).otherwise(F.col(email_col)))


def share_count(n: int, share: float) -> int:
    """round(n * share), half away from zero, in exact decimal arithmetic."""
    return int((Decimal(n) * Decimal(str(share))).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def _order_key(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def exact_share_predicate(df: DataFrame, key: str, share: float) -> Column:
    """Column predicate true for the first round(share*n) rows in md5(key), key order.

    Rows tied on the key are chosen together, as ``key IN (... LIMIT k)`` does.
    Each pass groups one md5 prefix level into at most 65536 counts, so the
    driver never sees more than that many numbers whatever the table size.
    """
    base = df.select(F.col(key).alias("_k"), _order_key(key).alias("_h")).filter(F.col("_k").isNotNull())

    def histogram(prefix: str):
        level = min(32, len(prefix) + _PREFIX)
        part = base.filter(F.col("_h").startswith(prefix)) if prefix else base
        return (part.groupBy(F.substring("_h", 1, level).alias("p"))
                .agg(F.count("*").alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
                .orderBy("p").collect())

    counts = histogram("")
    n = sum(r["n"] for r in counts)          # the first pass also gives the row count
    k = share_count(n, share)
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return F.col(key).isNotNull()
    prefix, need = "", k
    while len(prefix) < 32:
        if prefix:
            counts = histogram(prefix)
        cum = 0
        for row in counts:
            if cum + row["n"] >= need:
                need -= cum
                # a bucket holding a single md5 value ends the search early
                prefix = row["lo"] if row["lo"] == row["hi"] else row["p"]
                break
            cum += row["n"]
    # prefix is the md5 of the cut-off row; tie-break by key among equal md5s
    ids = base.filter(F.col("_h") == prefix).groupBy("_k").count().orderBy("_k").collect()
    cum, last = 0, ids[-1]["_k"]
    for row in ids:
        cum += row["count"]
        if cum >= need:
            last = row["_k"]
            break
    h = _order_key(key)
    return F.col(key).isNotNull() & ((h < F.lit(prefix)) | ((h == F.lit(prefix)) & (F.col(key) <= F.lit(last))))


def null_spike(df: DataFrame, key: str, col: str, share: float = GENERATED_NULL_SHARE) -> DataFrame:
    """Set ``col`` to NULL on exactly round(share*n) rows chosen by md5 order of ``key``."""
    chosen = exact_share_predicate(df, key, share)
    return df.withColumn(col, F.when(chosen, F.lit(None).cast(df.schema[col].dataType)).otherwise(F.col(col)))


def update_in(df: DataFrame, key: str, ids: DataFrame, id_col: str, assignments: dict) -> DataFrame:
    """``UPDATE df SET col = value WHERE key IN (SELECT id_col FROM ids)``.

    The id set is de-duplicated (partial aggregation before its shuffle) and
    left-joined as a flag, so each row keeps its multiplicity.
    """
    flags = ids.select(F.col(id_col).alias("_in_key")).filter(F.col("_in_key").isNotNull()).distinct() \
        .withColumn("_in_hit", F.lit(True))
    j = df.join(flags, df[key] == flags["_in_key"], "left")
    hit = F.coalesce(F.col("_in_hit"), F.lit(False))
    out = j
    for c, v in assignments.items():
        val = v if isinstance(v, Column) else F.lit(v)
        out = out.withColumn(c, F.when(hit, val.cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return out.select(*df.columns)


def delete_in(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """``DELETE FROM df WHERE key IN (SELECT id_col FROM ids)``: keep the rest.

    A NULL key is never IN anything, so such rows stay (anti join keeps them).
    """
    right = ids.select(F.col(id_col).alias("_del_key")).distinct()
    return df.join(right, df[key] == right["_del_key"], "left_anti")


def generate_customers(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Demo mart rows for each id: dates, counts, spend, 40 % NULL e-mails.

    The reference draws ``random()``; here each value is a repeatable integer
    hash of the id so two engines produce the same rows.
    """
    i = F.col(id_col).cast("bigint")
    d1 = F.lit(_dt.date(2024, 1, 1))
    d2 = F.lit(_dt.date(2024, 3, 1))
    return ids.select(
        i.alias("customer_id"),
        F.concat(F.lit("Customer "), i.cast("string")).alias("customer_name"),
        F.date_add(d1, ((i * 7919 + 13) % 91).cast("int")).alias("first_order_date"),
        F.date_add(d2, ((i * 104729 + 7) % 31).cast("int")).alias("most_recent_order_date"),
        ((i * 31 + 3) % 11 + 1).cast("int").alias("number_of_orders"),
        ((F.lit(5000) + (i * 7907 + 11) % 100001).cast("decimal(20,0)") / F.lit(100)).cast("decimal(10,2)")
        .alias("lifetime_spend"),
        F.when((i * 37 + 11) % 100 < int(GENERATED_NULL_SHARE * 100), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("customer"), i.cast("string"), F.lit(GENERATED_EMAIL_DOMAIN)))
        .alias("customer_email"),
    )
