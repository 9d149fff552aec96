"""ledgerline: retail star-schema analytics on Spark DataFrames.

Layers:

* ``sources``    conform raw tables into the star, load/save it, materialise it.
* ``operators``  KPIs, time series, ranking, customer, product and
                 recommendation queries, plus data-quality checks.
* ``functions``  shared column expressions and fixed lookup values.
* ``plans``      plan-level helpers: size-checked dimension joins and the
                 distributed global window.

Every operator has the shape ``op(star, **params) -> DataFrame``: lazy, no
collect, no Python UDF.
"""

from ledgerline.model import Star
from ledgerline.session import build_session, scratch_dir

__all__ = ["Star", "build_session", "scratch_dir"]
