"""Core streaming of weftline."""
