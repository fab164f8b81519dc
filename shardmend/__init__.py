"""shardmend: archive forensics and training-data operators as Spark DataFrames."""
