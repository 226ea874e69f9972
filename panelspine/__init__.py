"""Panel analytics on Spark: event records to place-by-season panels, forecasts and scores."""
