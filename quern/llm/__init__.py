"""Training-data operators: thirteen corpus operators and the queries that apply them."""
