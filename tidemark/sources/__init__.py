"""Readers, and the market-shaped views of the star schema."""
