"""Relational and graph operators over DataFrames of program facts."""
