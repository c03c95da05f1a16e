"""webweft: relational analytics over crawled web data, on PySpark."""
