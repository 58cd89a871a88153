"""The tables behind quality-control plots; drawing them is left to any plotting library."""

from .operators.qc import box, describe, group_correlation, histogram, id_counts, intensity_box, intensity_histogram, missingness, plot_type, scatter, upset, var_box, var_counts, var_histogram

__all__ = ["box", "describe", "group_correlation", "histogram", "id_counts", "intensity_box", "intensity_histogram", "missingness", "plot_type", "scatter", "upset", "var_box", "var_counts", "var_histogram"]
