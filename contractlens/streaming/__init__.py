"""Streaming of the contract toolkit."""
