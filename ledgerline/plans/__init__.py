"""Plan-level helpers: size-checked dimension joins, distributed global windows."""

from ledgerline.plans.global_window import global_window, percent_rank
from ledgerline.plans.joins import as_of_col, dim, join_dim

__all__ = ["as_of_col", "dim", "global_window", "join_dim", "percent_rank"]
