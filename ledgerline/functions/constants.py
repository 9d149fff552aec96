"""Lookup values of the retail model.

Of GENDERS, AGE_GROUPS and PARENT_CATEGORIES only the number of labels matters: the
source tables have none, so they are dealt by key.
"""

GENDERS = ["female", "male", "nonbinary", "unstated"]

AGE_GROUPS = ["under 20", "20 to 34", "35 to 49", "50 to 64", "65 to 79", "80 and over"]

PARENT_CATEGORIES = [
    "Devices", "Apparel", "Household", "Leisure", "Learning", "Children", "Care", "Groceries", "Transport", "Animals",
]

# FIXED VALUES from here on, kept verbatim and in their natural order. Keys count from 1:
# subcategories by size, payment methods, shipping types with delivery days, tier labels of
# quartiles 1..4, recommendation weights, affinity and stock scores, days, cards.

SUBCATEGORIES = ["Entry", "Mid-range", "Premium", "Luxury", "Budget", "Professional"]

PAYMENT_METHODS = [
    "Credit Card", "Debit Card", "PayPal", "Cash on Delivery",
    "Bank Transfer", "Wallet", "Buy Now Pay Later", "Crypto",
]

SHIPPING_TYPES = [
    ("Standard", 7), ("Express", 3), ("Same Day", 1),
    ("Economy", 14), ("Overnight", 1), ("Pickup", 1),
]

SPENDING_TIERS = ["low spender", "mid spender", "high spender", "top spender (vip)"]

REC_WEIGHTS = {
    "co_purchase": 0.3,
    "recency": 0.2,
    "category": 0.1,
    "profit": 0.1,
    "stock": 0.1,
    "association": 0.0,
}
CATEGORY_AFFINITY = {"same_subcategory": 1.0, "same_brand": 0.7, "other": 0.3}
STOCK_LOW_THRESHOLD = 50
STOCK_SCORES = {"out": 0.0, "low": 0.5, "ok": 1.0}
RECENCY_DAYS = 30
TOP_K = 4
