"""fleetcast: fleet-registration analytics and adoption forecasting on Spark DataFrames."""
