from tallyfold.functions.columns import UNITS, exact_units, month_start

__all__ = ["UNITS", "exact_units", "month_start"]
