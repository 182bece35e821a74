"""Lodestone: grounded analytics over a release-versioned fact store, as Spark DataFrames."""
