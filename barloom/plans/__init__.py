"""Whole jobs composed of the operators: panel, alphas, backtest, completeness, load, export."""
