"""Layered tables: raw -> staging -> mart.

Staging steps are projections.  Mart steps join and roll up.  The customer
roll-up aggregates orders *before* the join so that the big side shuffles one
partial row per (customer, map task) instead of every order, and so that a
customer holding a large share of all orders collapses map-side instead of
landing in one reducer.  ``COUNT(DISTINCT order_id)`` is computed as a
two-level aggregate (first by (customer, order), then by customer) for the
same reason: Spark's single-distinct plan would otherwise shuffle every
distinct order of a hot customer to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeeper.functions.money import TOTAL, cents_to_amount, day


def stage_customers(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))


def stage_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("order_id"),
        F.col("store_id").alias("location_id"),
        F.col("customer").alias("customer_id"),
        F.col("subtotal").alias("subtotal_cents"),
        F.col("tax_paid").alias("tax_paid_cents"),
        F.col("order_total").alias("order_total_cents"),
        cents_to_amount("subtotal").alias("subtotal"),
        cents_to_amount("tax_paid").alias("tax_paid"),
        cents_to_amount("order_total").alias("order_total"),
        day("ordered_at").alias("ordered_at"),
    )


def stage_order_items(raw: DataFrame) -> DataFrame:
    return raw.select("id", "order_id", "sku")


def stage_products(raw: DataFrame) -> DataFrame:
    return raw.select(
        "sku", "name", "type",
        F.col("price").alias("price_cents"),
        cents_to_amount("price").alias("price"),
        "description",
    )


def stage_supplies(raw: DataFrame) -> DataFrame:
    return raw.select(
        "id", "name",
        F.col("cost").alias("cost_cents"),
        cents_to_amount("cost").alias("cost"),
        "perishable", "sku",
    )


def stage_locations(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("location_id"),
        F.col("name").alias("location_name"),
        day("opened_at").alias("opened_at"),
        F.col("tax_rate").cast("decimal(5,4)").alias("tax_rate"),
    )


def mart_orders(stg_orders: DataFrame) -> DataFrame:
    return stg_orders.select(
        "order_id", "customer_id", "location_id",
        F.col("ordered_at").alias("order_date"),
        "subtotal", "tax_paid", "order_total",
    )


def mart_products(stg_products: DataFrame) -> DataFrame:
    return stg_products.select("sku", "name", "type", "price", "description")


def mart_locations(stg_locations: DataFrame) -> DataFrame:
    return stg_locations.select("location_id", "location_name", "opened_at", "tax_rate")


def mart_supplies(stg_supplies: DataFrame) -> DataFrame:
    return stg_supplies.select("id", "name", "cost", "perishable", "sku")


def mart_order_items(stg_items: DataFrame, stg_products: DataFrame) -> DataFrame:
    """Enrich items with product name and price (inner join: unknown skus drop).

    Products are a dimension; AQE turns the join into a broadcast at run time
    when the measured product side is under the broadcast threshold and keeps
    a sort-merge join otherwise, so no unchecked broadcast hint is given.
    """
    p = stg_products.select("sku", F.col("name").alias("product_name"), "price")
    return stg_items.join(p, "sku", "inner").select("id", "order_id", "sku", "product_name", "price")


def _order_rollup(stg_orders: DataFrame) -> DataFrame:
    per_order = (stg_orders
                 .groupBy("customer_id", "order_id")
                 .agg(F.min("ordered_at").alias("first_at"),
                      F.max("ordered_at").alias("last_at"),
                      F.sum("order_total").alias("spend")))
    return (per_order
            .groupBy("customer_id")
            .agg(F.min("first_at").alias("first_order_date"),
                 F.max("last_at").alias("most_recent_order_date"),
                 F.count("order_id").alias("number_of_orders"),
                 F.sum("spend").alias("lifetime_spend")))


def mart_customers(stg_orders: DataFrame, stg_customers: DataFrame,
                   email: DataFrame | None = None) -> DataFrame:
    """MIN/MAX order date, COUNT(DISTINCT order), SUM(order_total) per customer.

    Inner join semantics: customers without orders (and orders without a
    customer) drop out.  The final group by (customer_id, customer_name[,
    email]) reproduces join-then-group results even if a customer id appears
    twice on the customer side (sums add up per joined copy, the distinct
    order count does not).  ``email`` is the staging table joined a second
    time by id (the reference's self-join), yielding ``customer_email``.
    """
    agg = _order_rollup(stg_orders)
    c = stg_customers.select("customer_id", "customer_name")
    joined = agg.join(c, "customer_id", "inner")
    keys = ["customer_id", "customer_name"]
    if email is not None:
        s = email.select("customer_id", "customer_email")
        joined = joined.join(s, "customer_id", "inner")
        keys.append("customer_email")
    out = (joined.groupBy(*keys)
           .agg(F.min("first_order_date").alias("first_order_date"),
                F.max("most_recent_order_date").alias("most_recent_order_date"),
                F.max("number_of_orders").alias("number_of_orders"),
                F.sum("lifetime_spend").cast(TOTAL).alias("lifetime_spend")))
    cols = ["customer_id", "customer_name", "first_order_date", "most_recent_order_date",
            "number_of_orders", "lifetime_spend"] + (["customer_email"] if email is not None else [])
    return out.select(*cols)
