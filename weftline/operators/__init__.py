"""Core operators of weftline."""
