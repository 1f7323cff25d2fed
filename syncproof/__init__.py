"""Load, digest, diff, profile, monitor and alert tables as Spark DataFrames."""
