"""Operators: statistics, metrics, cleaning, binning, encoding, selection and scaling."""
