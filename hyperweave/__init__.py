"""Analytics over facts that can be members of other facts, as Spark DataFrames."""
