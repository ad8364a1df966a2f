"""lingrove: language identification over large text collections, built on Spark DataFrames."""
