"""Training-data operators: every one takes DataFrames and returns a DataFrame.

Nothing else in the library imports this package.  ``queries`` registers one thin query for each operator.
"""
