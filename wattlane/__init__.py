"""wattlane: load-forecasting features, training and scoring as Spark plans."""

__version__ = "0.1.0"
