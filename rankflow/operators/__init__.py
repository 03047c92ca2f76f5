"""Operators over keyed arrays and run data; DataFrames in, DataFrames out."""
