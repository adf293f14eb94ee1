"""Search indexes, mutations, sharding and metrics over DataFrames."""
