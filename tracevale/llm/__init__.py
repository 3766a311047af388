"""Training-data operators: ten stand-alone DataFrame operators and their queries.

Nothing else in the library imports this subpackage.
"""
