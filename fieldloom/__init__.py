"""fieldloom: Earth-observation and environmental analytics on Spark DataFrames."""
