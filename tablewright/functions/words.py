"""Words in column names that hint at what a column holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name parts of metric, category and date columns, and thresholds.
METRIC_WORDS = (
    "revenue", "sales", "amount", "price", "cost", "spend",
    "orders", "quantity", "users", "count", "profit", "margin",
)
CATEGORY_WORDS = (
    "country", "region", "channel", "campaign", "product",
    "status", "segment", "category", "type", "tier",
)
DATE_WORDS = ("date", "time", "created_at", "updated_at", "timestamp", "created", "updated", "at")
# Without the parts that also occur inside status, category or nation.
STRICT_DATE_WORDS = ("date", "time", "created_at", "updated_at", "timestamp")

REVENUE_WORDS = ("revenue", "sales", "amount", "price", "total")
ORDER_WORDS = ("order",)
USER_WORDS = ("user", "customer", "client")
CHANNEL_WORDS = ("channel", "campaign", "source", "medium")

CATEGORICAL_MAX_UNIQUE = 15
CATEGORICAL_MAX_SHARE = 0.05
HIGH_CARDINALITY = 50
TEXT_SHARE = 0.70
ID_UNIQUE_PERCENT = 90.0
MIXED_SHARE = 0.1
HIGH_DUPLICATE_PERCENT = 10.0


def name_has(name: Column, words: tuple[str, ...]) -> Column:
    """True where the lower-cased name contains one of the words."""
    low = F.lower(name)
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return hit


def title_of(name: Column) -> Column:
    """order_count -> Order Count."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
