"""Views over customer orders (customers, stores, products, orders, order_items) and over a
sales history (sales, costs, times, products)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.operators.lists import truncated_list
from lakemill.operators.relational import row_count, with_group_values

C = F.col
REVIEWS = "reviews array<struct<rating:int,review:string>>"


def amount():
    return C("quantity") * C("unit_price")


def customer_order_products(t, limit: int = 4000) -> DataFrame:
    """Orders with their customer, total, and product names in line order."""
    lines = t.order_items.select("order_id", "line_item_id", "product_id").join(
        t.products.select("product_id", "product_name"), "product_id"
    )
    listed = truncated_list(lines, ["order_id"], "product_name", ["line_item_id"], limit)
    totals = t.order_items.groupBy("order_id").agg(F.sum(amount()).alias("order_total"))
    return (
        t.orders.join(listed, "order_id")
        .join(totals, "order_id")
        .join(t.customers, "customer_id")
        .select(
            "order_id", "order_tms", "order_status", "customer_id", "email_address", "full_name",
            "order_total", "items",
        )
    )


def store_orders(t) -> DataFrame:
    """Orders and sales per store, per store and status, per status, and in total.

    An order has one store and one status, so order counts of coarser sets add up.
    """
    per_order = t.order_items.groupBy("order_id").agg(F.sum(amount()).alias("sales"))
    finest = (
        t.orders.join(per_order, "order_id")
        .groupBy("store_id", "order_status")
        .agg(row_count().alias("n"), F.sum("sales").alias("sales"))
        .join(t.stores, "store_id")
        .select(
            "store_name",
            F.coalesce("web_address", "physical_address").alias("address"),
            "latitude", "longitude", "order_status", "n", "sales",
        )
    )
    store = "store_name, address, latitude, longitude"
    return t.orders.sparkSession.sql(
        "SELECT CASE grouping(store_name) * 2 + grouping(order_status) WHEN 1 THEN 'STORE TOTAL'"
        " WHEN 2 THEN 'STATUS TOTAL' WHEN 3 THEN 'GRAND TOTAL' END AS total, store_name, address,"
        " latitude, longitude, order_status, sum(n) AS order_count, sum(sales) AS total_sales"
        f" FROM {{finest}} GROUP BY GROUPING SETS (({store}), ({store}, order_status),"
        " (order_status), ())",
        finest=finest,
    )


def product_reviews(t) -> DataFrame:
    """One row per review with the product's mean rating. A product whose document has no
    reviews keeps one empty row; a product without a document gives none."""
    document = C("product_details").cast("string")
    opened = (
        t.products.filter(C("product_details").isNotNull())
        .select("product_name", F.explode_outer(F.from_json(document, REVIEWS)["reviews"]).alias("r"))
        .select("product_name", "r.rating", "r.review")
    )
    mean = F.round(F.avg("rating"), 2).alias("avg_rating")
    return with_group_values(opened, ["product_name"], mean)


def product_orders(t) -> DataFrame:
    """Sales and number of lines per product and order status, for orders with a customer."""
    placed = t.orders.join(t.customers.select("customer_id"), "customer_id", "left_semi")
    per_product = (
        t.order_items.join(placed.select("order_id", "order_status"), "order_id")
        .groupBy("product_id", "order_status")
        .agg(F.sum(amount()).alias("s"), row_count().alias("n"))
    )
    return (
        per_product.join(t.products.select("product_id", "product_name"), "product_id")
        .groupBy("product_name", "order_status")
        .agg(F.sum("s").alias("total_sales"), F.sum("n").alias("order_count"))
    )


COST_KEYS = ["prod_id", "time_id", "channel_id", "promo_id"]


def profits(t) -> DataFrame:
    """Sales with their cost; sales without one drop out."""
    return t.sales.join(t.costs.select(*COST_KEYS, "unit_cost", "unit_price"), COST_KEYS).select(
        "channel_id", "cust_id", "prod_id", "promo_id", "time_id", "unit_cost", "unit_price",
        "amount_sold", "quantity_sold", (C("unit_cost") * C("quantity_sold")).alias("total_cost"),
    )


def cal_month_sales(t) -> DataFrame:
    per_day = t.sales.groupBy("time_id").agg(F.sum("amount_sold").alias("s"))
    return (
        per_day.join(t.times.select("time_id", "calendar_month_desc"), "time_id")
        .groupBy("calendar_month_desc")
        .agg(F.sum("s").alias("dollars"))
    )


def fweek_subcat_sales(t) -> DataFrame:
    keys = ["time_id", "prod_id", "channel_id", "promo_id"]
    sums = t.sales.groupBy(*keys).agg(F.sum("amount_sold").alias("s"))
    return (
        sums.join(t.times.select("time_id", "week_ending_day"), "time_id")
        .join(t.products.select("prod_id", "prod_subcategory"), "prod_id")
        .groupBy("week_ending_day", "prod_subcategory", "channel_id", "promo_id")
        .agg(F.sum("s").alias("dollars"))
    )
