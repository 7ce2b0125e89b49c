"""Every operator takes DataFrames and returns a lazy DataFrame."""
