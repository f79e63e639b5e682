from gaugeline.plans import checks_columns, checks_forecast, checks_samples, checks_series  # noqa: F401
from gaugeline.plans.registry import ORACLES, QUERIES  # noqa: F401
