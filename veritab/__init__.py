"""veritab: consistency and reconciliation analytics as Spark DataFrames."""
