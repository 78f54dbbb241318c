"""Evidence graphs on Spark: build, retrieve, trace and measure with DataFrames."""
