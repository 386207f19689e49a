"""partlens: component-data analytics planned as Spark DataFrames."""
