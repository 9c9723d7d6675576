"""Core plans of weftline."""
