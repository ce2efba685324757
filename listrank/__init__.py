"""List-wise ranking evaluation on Spark DataFrames: exact tie handling, metrics, diagnostics and the tables around them."""
