"""A bi-temporal Datalog engine over Spark DataFrames."""
