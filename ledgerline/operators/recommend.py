"""Co-purchase recommendation scoring: the top companion products per item.

Plan shape:

1. ``baskets``: one row per (order, product) with its line count and recent
   line count - a partial aggregate, so repeated lines collapse map-side.
   What the scores need of a product is attached here, on the fact-sized
   basket, instead of joining the much larger pair table twice afterwards.
   Margins and order counts are aggregates, so they are written once as one
   table per product and joined from there: both sides of that join are then
   plain shuffles, which AQE can split for a hot product.
2. self-join on order_id keeping each unordered pair once (a < b); both
   sides carry the same columns, so the basket is computed and shuffled once
   (a reused exchange) and AQE can split an order that holds a huge share of
   lines. One aggregation per unordered pair computes the scores asked for, in
   both directions, which are then emitted as (a, b) and (b, a). The scoring
   query's all-products x all-products tables are only ever read through
   co-purchased pairs, so they are evaluated on those pairs only.
3. the unordered pair table and the per-product maxima are written once and
   joined by product_a. The top-k writes only pairs that can reach the k-th place
   (fewer than k partners with equal counts are ahead) and spreads every product's partners over
   ``SPREAD`` groups: the maxima are joined per (product, group), a first
   top-k runs per group and a final one over its few survivors, so no task
   ranks a hot product's whole partner list.

Scores are ranked as they are; rounding is for the output columns only.
Products without a dimension row have no score and rank last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.constants import (
    CATEGORY_AFFINITY,
    REC_WEIGHTS,
    RECENCY_DAYS,
    STOCK_LOW_THRESHOLD,
    STOCK_SCORES,
    TOP_K,
)
from ledgerline.functions.exprs import dbl
from ledgerline.model import Star
from ledgerline.operators import lookup
from ledgerline.plans.group_totals import group_totals, with_group_totals
from ledgerline.plans.joins import as_of_col, dim, join_dim
from ledgerline.plans.materialize import stage, still_there

SCORE_DP = 6  # decimals shown
MARGIN_UNIT = 12  # decimals kept of a line's margin, so that sums of margins are exact
STEP = 1e-9  # scores nearer than this are not told apart before the final ranking
SPREAD = 16  # groups that a product's partners are ranked in first


def _margin(lines: DataFrame, *keys: str) -> DataFrame:
    """Mean of profit / NULLIF(net, 0) over the lines of each key, as ``margin``.

    A line's margin is cut to 12 decimals by long division in 64-bit integers (six
    decimals a step, so no step overflows) and summed exactly, so the mean does
    not depend on the order of the lines.
    """
    half = 10 ** (MARGIN_UNIT // 2)
    p, n = (F.abs((F.col(c) * 100).cast("long")) for c in ("profit_amount", "net_amount"))
    sign = F.signum(F.col("profit_amount")) * F.signum(F.col("net_amount"))
    rows = lines.select(*keys, p.alias("p"), F.nullif(n, F.lit(0)).alias("d"), F.when(sign < 0, -1).otherwise(1).alias("sign"))
    rows = rows.select(*keys, "d", "sign", F.expr("p div d").alias("whole"), F.expr(f"p % d * {half}").alias("r"))
    rows = rows.select(*keys, "sign", "whole", F.expr(f"r div d * {half} + r % d * {half} div d").alias("decimals"))
    sums = rows.groupBy(*keys).agg(
        F.sum((F.col("sign") * F.col("whole")).cast("decimal(18,0)")).alias("w"),
        F.sum((F.col("sign") * F.col("decimals")).cast("decimal(18,0)")).alias("f"), F.count("whole").alias("c"))
    total = F.col("w").cast("decimal(25,0)") * F.lit(half * half).cast("decimal(13,0)") + F.col("f")
    mean = dbl(total) / F.nullif(dbl("c"), F.lit(0.0)) / F.lit(float(half * half))
    return sums.select(*keys, mean.alias("margin"))


def product_profit(star: Star) -> DataFrame:
    """AVG(profit / NULLIF(net, 0)) per product: the mean of line margins."""
    return _margin(star.fact_order_line, "product_key").select(
        "product_key", F.round("margin", SCORE_DP).alias("profit_score"))


def _weighted(w: dict[str, float]) -> Column:
    """0.3 co + 0.2 recency + 0.1 category + 0.1 profit + 0.1 stock (by default),
    over normalised pair rows; missing recency or profit count as 0."""
    return (F.lit(w["co_purchase"]) * F.col("co_norm")
            + F.lit(w["recency"]) * F.coalesce(F.col("rec_norm"), F.lit(0.0))
            + F.lit(w["category"]) * F.col("category_score")
            + F.lit(w["profit"]) * F.coalesce(F.col("profit_score"), F.lit(0.0))
            + F.lit(w["stock"]) * F.col("stock_score"))


def stock_score_of(stock: Column) -> Column:
    return (F.when(stock == 0, F.lit(STOCK_SCORES["out"]))
            .when(stock < STOCK_LOW_THRESHOLD, F.lit(STOCK_SCORES["low"]))
            .otherwise(F.lit(STOCK_SCORES["ok"])))


def category_score_of(sub_a: Column, sub_b: Column, brand_a: Column, brand_b: Column) -> Column:
    return (F.when(sub_a == sub_b, F.lit(CATEGORY_AFFINITY["same_subcategory"]))
            .when(brand_a == brand_b, F.lit(CATEGORY_AFFINITY["same_brand"]))
            .otherwise(F.lit(CATEGORY_AFFINITY["other"])))


def _dated_lines(star: Star, days: int, lines: DataFrame | None = None) -> DataFrame:
    """(order_id, product_key, recent): recent is 1 within ``days`` of the as-of date, else 0."""
    lines = join_dim((star.fact_order_line if lines is None else lines).select("order_id", "product_key", "date_key"),
                     star, "dim_date", "date_key", "full_date")
    recent = (F.col("full_date") >= F.date_sub(as_of_col(star), days)).cast("long")
    return lines.select("order_id", "product_key", recent.alias("recent"))


def _basket_of(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id", "product_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("recent").alias("n_recent"))


def baskets(star: Star, days: int = RECENCY_DAYS) -> list[DataFrame]:
    """(order_id, product_key, n, n_recent): lines per product per order and
    how many of them fall within ``days`` of the as-of date.

    Where the fact is clustered by order there are up to two tables: the orders
    in buckets, which need no exchange, and the very large ones, which are shuffled.
    """
    parts = [star.fact_order_line]
    if star.clustered is not None:
        parts = [p for p in (star.clustered.orders, star.clustered.large) if p is not None]
    return [_basket_of(_dated_lines(star, days, lines)) for lines in parts]


#: What pair tables can hold; each is computed only where asked for.
PAIR_SCORES = ("co", "rec", "orders", "category", "stock", "profit", "n_orders")
FULL = ("co", "rec", "category", "stock", "profit")


def _product_table(star: Star, want: tuple[str, ...]) -> DataFrame | None:
    """Per product what the wanted scores need; attributes stay NULL without a dimension row.

    Aggregates (margin, order count) are written out with the attributes as one
    row per product; plain attributes are read from the dimension.
    """
    columns = []
    if "category" in want:
        columns += ["subcategory", "brand"]
    if "stock" in want:
        columns += ["stock_quantity"]
    attrs = dim(star, "dim_product", "product_key", *columns).withColumn("has_dim", F.lit(True)) if columns else None
    sums = None
    if "profit" in want:
        sums = _margin(star.fact_order_line, "product_key").withColumnRenamed("margin", "profit_score")
    if "n_orders" in want:
        per_order = star.fact_order_line.select("order_id", "product_key").distinct()
        counts = per_order.groupBy("product_key").agg(F.count(F.lit(1)).alias("n_orders"))
        sums = counts if sums is None else sums.join(counts, "product_key", "full")
    if sums is None:
        return attrs
    # where dim() does not broadcast the attributes, the planner must not do so by the size of their compressed files
    return stage(sums if attrs is None else sums.hint("merge").join(attrs, "product_key", "left"), "products")


def unordered_pairs(star: Star, days: int = RECENCY_DAYS, want: tuple[str, ...] = FULL) -> DataFrame:
    """One row per co-purchased unordered pair (p1 < p2) holding the wanted scores
    of both directions (see :func:`pair_scores`); half the size of the
    directed table, so this is the form that gets written when staged."""
    products = _product_table(star, want)
    unused = {"order_id"} | ({"n_recent"} if "rec" not in want else set())

    def paired(side: DataFrame) -> DataFrame:
        if products is not None:
            side = side.join(products, "product_key", "left")
        cols = [c for c in side.columns if c not in unused]
        lo = side.select("order_id", *[F.col(c).alias(f"{c}_1") for c in cols])
        hi = side.select("order_id", *[F.col(c).alias(f"{c}_2") for c in cols])
        return lo.join(hi, "order_id").where(F.col("product_key_1") < F.col("product_key_2"))

    pairs = reduce(DataFrame.unionByName, [paired(side) for side in baskets(star, days)])

    def c(name: str, i: int) -> Column:
        return F.col(f"{name}_{i}")

    aggs = []
    if "co" in want:
        aggs.append(F.sum(c("n", 1) * c("n", 2)).alias("co"))
    if "rec" in want:
        aggs += [F.sum(c("n_recent", 1) * c("n", 2)).alias("rec_12"), F.sum(c("n_recent", 2) * c("n", 1)).alias("rec_21")]
    if "orders" in want:
        aggs.append(F.count(F.lit(1)).alias("orders_ab"))
    # attributes are functions of one product, so max() just carries them
    if "category" in want:
        both = c("has_dim", 1).isNotNull() & c("has_dim", 2).isNotNull()
        cat = category_score_of(c("subcategory", 1), c("subcategory", 2), c("brand", 1), c("brand", 2))
        aggs.append(F.max(F.when(both, cat)).alias("cat"))
    for i in (1, 2):
        if "stock" in want:
            stock = F.when(c("has_dim", i).isNotNull(), stock_score_of(c("stock_quantity", i)))
            aggs.append(F.max(stock).alias(f"stock_{i}"))
        if "profit" in want:
            aggs.append(F.max(c("profit_score", i)).alias(f"profit_{i}"))
        if "n_orders" in want:
            aggs.append(F.max(c("n_orders", i)).alias(f"orders_{i}"))
    keys = (F.col("product_key_1").alias("p1"), F.col("product_key_2").alias("p2"))
    return pairs.groupBy(*keys).agg(*aggs) if aggs else pairs.select(*keys).distinct()


#: directed column -> unordered column, by the numbers of the two products
_DIRECTED = {
    "co_purchase_score": "co", "recency_score": "rec_{a}{b}", "orders_ab": "orders_ab", "category_score": "cat",
    "stock_score": "stock_{b}", "profit_score": "profit_{b}", "orders_a": "orders_{a}", "orders_b": "orders_{b}",
}


def directed(unordered: DataFrame) -> DataFrame:
    """Both directions (a, b) and (b, a) of each unordered pair; b-side
    attributes (stock, profit, order count) follow the direction."""
    have = set(unordered.columns)

    def direction(a: int, b: int) -> Column:
        named = {name: source.format(a=a, b=b) for name, source in _DIRECTED.items()}
        scores = [F.col(s).alias(n) for n, s in named.items() if s in have]
        return F.struct(F.col(f"p{a}").alias("product_a"), F.col(f"p{b}").alias("product_b"), *scores)

    return unordered.select(F.explode(F.array(direction(1, 2), direction(2, 1))).alias("r")).select("r.*")


def pair_scores(star: Star, days: int = RECENCY_DAYS, want: tuple[str, ...] = FULL) -> DataFrame:
    """The wanted raw pair scores in one pass over co-purchased (product_a, product_b):

    co_purchase_score (line pairs), recency_score (line pairs whose a-line is
    recent), orders_ab (orders holding both), category_score, stock_score and
    profit_score of b, and each side's order count. Products without a dimension
    row keep NULL attributes (the scoring query's left joins).

    Line-pair counts are symmetric, so the self-join keeps each unordered
    pair once (a < b) and both directions are emitted after aggregating. Both
    join sides then carry the same columns, Spark reuses one exchange for them
    (the basket is computed and shuffled once), and join output and pair
    aggregation are half the size of an ordered self-join.
    """
    return directed(unordered_pairs(star, days, want))


def co_purchase(star: Star) -> DataFrame:
    """(product_a, product_b, co_purchase_score): line pairs sharing an order."""
    return pair_scores(star, want=("co",))


def recency(star: Star, days: int = RECENCY_DAYS) -> DataFrame:
    """Line pairs whose first line is within ``days`` of the as-of date.

    Only orders with a recent line are basketed, and only baskets with one
    stand on the first side, so nothing is paired that the result leaves out.
    """
    lines = _dated_lines(star, days)
    orders = lines.where(F.col("recent") == 1).select("order_id").distinct()
    b = _basket_of(lines.join(orders, "order_id", "left_semi"))
    first = b.where(F.col("n_recent") > 0).select(
        "order_id", F.col("product_key").alias("product_a"), F.col("n_recent"))
    second = b.select("order_id", F.col("product_key").alias("product_b"), "n")
    pairs = first.join(second, "order_id").where(F.col("product_a") != F.col("product_b"))
    return pairs.groupBy("product_a", "product_b").agg(F.sum(F.col("n_recent") * F.col("n")).alias("recency_score"))


def category_affinity(star: Star) -> DataFrame:
    """1 same subcategory / 0.7 same brand / 0.3 otherwise, per co-purchased pair."""
    return pair_scores(star, want=("category",))


def profit_score(star: Star) -> DataFrame:
    """Profit score of product_b attached to each co-purchased pair."""
    return pair_scores(star, want=("profit",)).where(F.col("profit_score").isNotNull()).select(
        "product_a", "product_b", F.round("profit_score", SCORE_DP).alias("profit_score"))


def stock_score(star: Star) -> DataFrame:
    """0 when b is out of stock, 0.5 below 50 units, else 1, per co-purchased pair."""
    return pair_scores(star, want=("stock",))


def _norms() -> list[Column]:
    return [(dbl("co_purchase_score") / dbl("max_co")).alias("co_norm"),
            (dbl("recency_score") / F.nullif(dbl("max_rec"), F.lit(0.0))).alias("rec_norm")]


def _maxima(scores: DataFrame) -> list[Column]:
    """Aggregates max_co and max_rec of a pair table's scores."""
    shown = {"co_purchase_score": "max_co", "recency_score": "max_rec"}
    return [F.max(c).alias(m) for c, m in shown.items() if c in scores.columns]


def _with_maxima(scores: DataFrame) -> DataFrame:
    """A written pair table with each product's largest scores."""
    return with_group_totals(scores, ["product_a"], _maxima(scores), written=True, null_keys=False)


def co_purchase_norm(star: Star) -> DataFrame:
    """co_purchase_score / MAX(co_purchase_score) per product_a."""
    scores = directed(stage(unordered_pairs(star, want=("co",)), "pair-scores"))
    share = dbl("co_purchase_score") / dbl("max_co")
    return _with_maxima(scores).select(
        "product_a", "product_b", F.round(share, SCORE_DP).alias("score"))


def recency_norm(star: Star, days: int = RECENCY_DAYS) -> DataFrame:
    """recency_score / MAX(recency_score) per product_a, over recent pairs."""
    scores = stage(recency(star, days), "recent-pairs")
    share = dbl("recency_score") / F.nullif(dbl("max_rec"), F.lit(0.0))
    return _with_maxima(scores).select(
        "product_a", "product_b", F.round(share, SCORE_DP).alias("score"))


def _lift(star: Star) -> Column:
    """P(a and b) / (P(a) P(b)) over orders, of a pair with its order counts."""
    total = star.fact_order_line.select("order_id").distinct().agg(F.count(F.lit(1))).scalar()
    return (dbl("orders_ab") * dbl(total)) / (dbl("orders_a") * dbl("orders_b"))


def association(star: Star) -> DataFrame:
    """Lift of each co-purchased pair: P(a and b) / (P(a) P(b)) over orders."""
    scores = pair_scores(star, want=("orders", "n_orders"))
    return scores.select("product_a", "product_b", F.round(_lift(star), SCORE_DP).alias("lift"))


def _scored(star: Star, weights: dict[str, float] | None) -> tuple[Column, tuple[str, ...]]:
    """The weighted score over normalised pair rows, and the pair scores it needs."""
    w = dict(REC_WEIGHTS, **(weights or {}))
    if not w.get("association"):
        return _weighted(w), FULL
    return _weighted(w) + F.lit(w["association"]) * _lift(star), (*FULL, "orders", "n_orders")


def final_scores(star: Star, weights: dict[str, float] | None = None,
                 days: int = RECENCY_DAYS) -> DataFrame:
    """Weighted recommendation score of every co-purchased pair."""
    score, want = _scored(star, weights)
    scores = directed(stage(unordered_pairs(star, days, want), "pair-scores"))
    rows = _with_maxima(scores).select("*", *_norms())
    return rows.select("product_a", "product_b", F.round(score, SCORE_DP).alias("recommendation_score"))


def _contenders(scores: DataFrame, score: Column, k: int) -> DataFrame:
    """The pairs that can be among a product's ``k`` best, before its maxima are known.

    Partners with the same two counts get the same normalised counts, whatever the
    maxima turn out to be, so the rest of the score alone orders them: one that
    stands behind k others of its class is out. Every class keeps a row, hence the
    maxima of what is left are those of all pairs. The rest of the score is compared
    in steps of ``STEP`` and ties stay, since the full score may round differently;
    the steps' borders are set off from the round numbers that fixed scores add up
    to. Partners without a score rank last, by key.

    The limit holds in every task before the exchange (``WindowGroupLimit``), so a hot
    product sends k rows and ties per class and task.
    """
    rest = scores.select("*", F.lit(0.0).alias("co_norm"), F.lit(0.0).alias("rec_norm")).select(
        *scores.columns, F.floor(score / STEP + 0.37).alias("rest"))
    order = [F.col("rest").desc_nulls_last(), F.when(F.col("rest").isNull(), F.col("product_b"))]
    place = F.rank().over(Window.partitionBy("product_a", "co_purchase_score", "recency_score").orderBy(*order))
    return rest.select("*", place.alias("place")).where(F.col("place") <= k).select(*scores.columns)


def top_k(star: Star, k: int = TOP_K, weights: dict[str, float] | None = None,
          spread: int = SPREAD) -> DataFrame:
    """The ``k`` best companions per product by the unrounded score (ties broken
    by product_b).

    Pairs that cannot reach the k-th place are dropped before anything is written
    (:func:`_contenders`). A product's other partners are ranked in ``spread``
    groups first: the maxima stand once per group, so the join and the first
    ranking share the key (product, group), and the final ranking reads k rows
    per group. That join is always a merge: the planner sees the size of the written
    maxima, not their ``spread`` copies, and would send these through the driver. A
    product has at most as many partners as there are products, so a group is bounded
    by their number over ``spread``.
    """
    score, want = _scored(star, weights)
    scores = stage(_contenders(directed(unordered_pairs(star, want=want)), score, k), "contenders")
    maxima = group_totals(scores, ["product_a"], _maxima(scores)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    parted = scores.withColumn("part", F.pmod(F.xxhash64("product_b"), F.lit(spread)).cast("int"))
    rows = parted.join(maxima.hint("merge"), ["product_a", "part"]).select("*", *_norms())
    rows = rows.select("product_a", "part", "product_b", score.alias("raw"))
    order = [F.col("raw").desc(), F.col("product_b")]
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("product_a", "part").orderBy(*order)))
    final = first.where(F.col("rn") <= k).select(
        "product_a", "product_b", "raw",
        F.row_number().over(Window.partitionBy("product_a").orderBy(*order)).cast("long").alias("rn"))
    return final.where(F.col("rn") <= k).orderBy("product_a", "rn").select(
        "product_a", "product_b", F.round("raw", SCORE_DP).alias("recommendation_score"), "rn")


def _partners(star: Star, key: Column, days: int = RECENCY_DAYS) -> DataFrame:
    """Raw pair scores with product_a fixed to ``key``.

    The fact is cut to the product's orders before anything is aggregated, only
    the product's own lines pair with the rest of each order, and margins are
    averaged for the partners found.
    """
    own = star.fact_order_line.where(F.col("product_key") == key).select("order_id").distinct()
    b = _basket_of(_dated_lines(star, days).join(own, "order_id", "left_semi"))
    left = b.where(F.col("product_key") == key).select(
        "order_id", F.col("product_key").alias("product_a"), F.col("n").alias("n_a"), F.col("n_recent").alias("r_a"))
    right = b.select("order_id", F.col("product_key").alias("product_b"), F.col("n").alias("n_b"))
    pairs = left.join(right, "order_id").where(F.col("product_a") != F.col("product_b"))
    counted = stage(pairs.groupBy("product_a", "product_b").agg(
        F.sum(F.col("n_a") * F.col("n_b")).alias("co_purchase_score"),
        F.sum(F.col("r_a") * F.col("n_b")).alias("recency_score")), "partners")
    found = counted.select(F.col("product_b").alias("product_key"))
    return _described(star, key, counted, _margin(star.fact_order_line.join(found, "product_key", "left_semi"), "product_key"))


def _described(star: Star, key: Column, counted: DataFrame, margins: DataFrame) -> DataFrame:
    """Counted pairs of one product with the margin, category and stock scores of its partners."""
    margins = margins.select(F.col("product_key").alias("product_b"), F.col("margin").alias("profit_score"))
    columns = ("product_key", "subcategory", "brand", "stock_quantity")
    a = star.dim_product.where(F.col("product_key") == key).select(
        *[F.col(c).alias(f"{c}_a") for c in columns[:3]])  # one row
    other = dim(star, "dim_product", *columns).withColumnRenamed("product_key", "product_b")
    rows = (counted.join(margins, "product_b", "left").join(other, "product_b", "left")
            .join(a, F.col("product_a") == F.col("product_key_a"), "left"))
    known = F.col("stock_quantity").isNotNull()
    cat = category_score_of(F.col("subcategory_a"), F.col("subcategory"), F.col("brand_a"), F.col("brand"))
    return rows.select(
        "product_a", "product_b", "co_purchase_score", "recency_score", "profit_score",
        F.when(known & F.col("product_key_a").isNotNull(), cat).alias("category_score"),
        F.when(known, stock_score_of(F.col("stock_quantity"))).alias("stock_score"))


_INDEXES: list[tuple[Star, lookup.ProductIndex]] = []


def index_of(star: Star) -> lookup.ProductIndex:
    """The product index of a star, written on its first use and anew if its files are gone."""
    for kept in [kept for kept in _INDEXES if kept[0] is star]:
        if still_there(kept[1].orders, kept[1].large, kept[1].products):
            return kept[1]
        _INDEXES[:] = [other for other in _INDEXES if other is not kept]
    index = lookup.build(star, _margin(star.fact_order_line, "product_key"))
    _INDEXES.append((star, index))
    return index


def for_product(star: Star, product_key: int | Column, k: int = TOP_K, weights: dict[str, float] | None = None,
                index: lookup.ProductIndex | None = None) -> DataFrame:
    """Recommendation cards for one product: its top ``k`` companions with their
    details, the total score and its five parts (co-purchase and recency as
    shares of the product's best).

    With an ``index`` (:func:`index_of`) only the product's own rows are read;
    without one the fact is scanned, which is cheaper for a single card."""
    key = product_key if isinstance(product_key, Column) else F.lit(product_key)
    w = dict(REC_WEIGHTS, **(weights or {}))
    if index is None:
        found = _partners(star, key)
    else:
        counted = stage(lookup.partners(star, index, key, RECENCY_DAYS), "partners")
        found = _described(star, key, counted, index.products)
    pairs = stage(found, "pair-scores")
    best = pairs.groupBy("product_a").agg(
        F.max("co_purchase_score").alias("max_co"), F.max("recency_score").alias("max_rec"))
    # one product, so its maxima are one row and are broadcast
    rows = pairs.join(F.broadcast(best), "product_a").select("*", *_norms())
    scored = rows.select("product_a", "product_b", "co_norm", "rec_norm", "category_score", "profit_score",
                         "stock_score", _weighted(w).alias("raw"))
    rank = F.row_number().over(Window.partitionBy("product_a").orderBy(F.col("raw").desc(), "product_b"))
    top = scored.select("*", rank.cast("long").alias("rn")).where(F.col("rn") <= k)
    details = dim(star, "dim_product", "product_key", "product_id", "product_name", "brand",
                  "subcategory", "stock_quantity").withColumnRenamed("product_key", "product_b")
    return top.join(details, "product_b", "left").orderBy("rn").select(
        "product_a", "rn", "product_b", "product_id", "product_name", "brand", "subcategory",
        "stock_quantity", F.round("raw", SCORE_DP).alias("recommendation_score"),
        F.round("co_norm", SCORE_DP).alias("co_purchase_score"),
        F.round(F.coalesce("rec_norm", F.lit(0.0)), SCORE_DP).alias("recency_score"),
        "category_score", F.round("profit_score", SCORE_DP).alias("profit_score"), "stock_score")


def for_product_id(star: Star, product_id: str, k: int = TOP_K,
                   weights: dict[str, float] | None = None) -> DataFrame:
    """Recommendation cards for a product given by its business id (e.g.
    ``PROD000042``), as picked in the product dropdown."""
    key = star.dim_product.where(F.col("product_id") == F.lit(product_id)).agg(
        F.min("product_key")).scalar()
    return for_product(star, key, k, weights)


def best_seller(star: Star) -> Column:
    """Scalar subquery: the product on most order lines (smallest key on ties)."""
    counts = star.fact_order_line.groupBy("product_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("product_key", F.struct(-F.col("n"), F.col("product_key")))).scalar()
