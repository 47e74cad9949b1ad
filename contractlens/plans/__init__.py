"""Plans of the contract toolkit."""
