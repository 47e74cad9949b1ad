"""Operators of the contract toolkit."""
