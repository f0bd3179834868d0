"""lacuna: gap-aware panel time-series analytics on PySpark."""
