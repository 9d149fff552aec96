"""Analysis operators: ``op(star, **params) -> DataFrame``, all lazy."""

from ledgerline.operators import customers, dq, kpis, products, ranking, recommend, timeseries

__all__ = ["customers", "dq", "kpis", "products", "ranking", "recommend", "timeseries"]
