"""Core functions of weftline."""
