"""The spreadsheet functions, one module for each category."""

from lattica.functions import aggregate, arrays, conditional, dates, financial, inspect, logical, lookup, maths, reference, text  # noqa: F401
