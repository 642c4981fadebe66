"""Column helpers where Spark's function and the wanted meaning differ."""
