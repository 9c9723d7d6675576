"""Core sources of weftline."""
