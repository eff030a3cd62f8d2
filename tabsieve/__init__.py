"""tabsieve: privacy-minded cleaning and evaluation of tabular data on Spark."""
