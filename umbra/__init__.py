"""Personal-data detection, pseudonymization and restoration on Spark DataFrames."""
