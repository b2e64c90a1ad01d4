from tallyfold.streaming.units import drop_merged, merge_totals, start_units_stream, units_so_far

__all__ = ["drop_merged", "merge_totals", "start_units_stream", "units_so_far"]
