"""Recursive-descent recognisers of the programming languages that problem 3 names, one module per family."""
