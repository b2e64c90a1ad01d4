from tallyfold.operators.lines import monthly_lines
from tallyfold.operators.totals import TOTAL_UNITS, add_up, total_units

__all__ = ["TOTAL_UNITS", "add_up", "monthly_lines", "total_units"]
