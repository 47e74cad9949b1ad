"""Sources of the contract toolkit."""
