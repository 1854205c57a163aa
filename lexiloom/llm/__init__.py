"""Training-data operators: ten large-scale corpus operators and the queries over them."""
