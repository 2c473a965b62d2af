"""loadcast: climate series to building cooling-load forecasts, as Spark DataFrames.

Every public function takes and returns DataFrames keyed by ``location`` (and
``scenario``) and never relies on implicit row order.  Times are
``TIMESTAMP_NTZ`` columns that hold the local wall clock.
"""

__version__ = "0.1.0"
