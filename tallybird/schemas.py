"""Table schemas: raw text inputs, typed star schema, and its declared keys."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATIO = T.DecimalType(5, 3)
PERCENT = T.DecimalType(4, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


L, I, D, S, DT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType()

# What a raw file must contain. Dates arrive as yyyy-MM-dd text.
RAW = {
    "customers": _struct(
        customer_id=L, customer_name=S, age=I, gender=S, city=S, signup_date=S, customer_segment=S
    ),
    "products": _struct(
        product_id=L, category=S, brand=S, cost=D, selling_price=D, inventory=I
    ),
    "orders": _struct(
        order_id=L, customer_id=L, product_id=L, order_date=S, quantity=I, price=D,
        discount=D, payment_method=S, delivery_time=I, status=S,
    ),
    "reviews": _struct(
        review_id=L, customer_id=L, order_id=L, rating=I, review_text=S, review_date=S
    ),
    "marketing": _struct(
        campaign_id=L, customer_id=L, campaign=S, spend=D, clicks=I, conversion=I
    ),
}

# What the star schema stores after cleaning.
STAR = {
    "customers": _struct(
        customer_id=L, customer_name=S, age=I, gender=S, city=S, signup_date=DT,
        customer_segment=S, tenure_days=I,
    ),
    "products": _struct(
        product_id=L, category=S, brand=S, cost=MONEY, selling_price=MONEY, inventory=I,
        profit_margin=MONEY, margin_pct=RATIO,
    ),
    "orders": _struct(
        order_id=L, customer_id=L, product_id=L, order_date=DT, quantity=I, price=MONEY,
        discount=PERCENT, payment_method=S, delivery_time=I, status=S, revenue=MONEY,
    ),
    "reviews": _struct(
        review_id=L, customer_id=L, order_id=L, rating=I, review_text=S, review_date=DT
    ),
    "marketing_campaigns": _struct(
        campaign_id=L, customer_id=L, campaign=S, spend=MONEY, clicks=I, conversion=I
    ),
}

# Dimensions before the facts that refer to them.
LOAD_ORDER = ["customers", "products", "orders", "reviews", "marketing"]
STAR_NAME = {"marketing": "marketing_campaigns"}

PRIMARY_KEY = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "reviews": "review_id",
    "marketing": "campaign_id",
}

# (child, column, parent)
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers"),
    ("orders", "product_id", "products"),
    ("reviews", "customer_id", "customers"),
    ("reviews", "order_id", "orders"),
    ("marketing", "customer_id", "customers"),
]


def star_name(table: str) -> str:
    return STAR_NAME.get(table, table)
