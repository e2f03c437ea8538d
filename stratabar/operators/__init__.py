"""Operators on trades, bars and candles."""
