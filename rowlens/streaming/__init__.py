"""Micro-batches compared with a snapshot."""
