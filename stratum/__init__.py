"""Panel analytics for entity-by-date tables, written as PySpark DataFrame plans."""

from .frames import as_spark, get_backend, set_backend
from .functions.calendar import Offset, months, years
from .functions.newey_west import newey_west_se
from .functions.quantile import quantiles, trim, winsorize
from .operators.breakpoints import assign_portfolio, compute_breakpoints
from .operators.filters import filter_sorting_data
from .operators.lagging import add_lagged_columns, join_lagged_values
from .operators.portfolios import compute_long_short_returns, compute_portfolio_returns, implement_portfolio_sort
from .operators.regression import estimate_betas, estimate_fama_macbeth, estimate_model
from .operators.rolling import compute_rolling_value
from .operators.summary import create_summary_statistics
from .options import breakpoint_options, data_options, filter_options, portfolio_sort_options
from .plans.bonds import process_trace_data
from .plans.raw import load_raw
from .sources.catalog import available_french_datasets, list_supported_datasets, list_supported_indexes, list_supported_jkp_factors
from .sources.load import load_data

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("frames", "functions", "operators", "options", "plans", "sources")]
