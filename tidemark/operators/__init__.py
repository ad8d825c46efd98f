"""Operators over ordered series: DataFrame in, DataFrame out."""
