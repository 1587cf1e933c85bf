"""Markup event analytics on Spark: typed, positioned events of XML, HTML, JSX and component templates as DataFrames."""
