"""Training-data operators.

Nothing else in the library imports this subpackage.  Every operator works on
DataFrames, keeps to bounded memory per task and reads nothing but its
arguments and the session.
"""
