"""Sources and sinks: conform raw tables, load/save the star, materialise it."""

from ledgerline.sources.conform import conform_star, dim_date_between
from ledgerline.sources.star_io import catalog_counts, load_star, save_star
from ledgerline.sources.warehouse import materialize_star, prepare_star, star_for

__all__ = [
    "catalog_counts",
    "conform_star",
    "dim_date_between",
    "load_star",
    "materialize_star",
    "prepare_star",
    "save_star",
    "star_for",
]
