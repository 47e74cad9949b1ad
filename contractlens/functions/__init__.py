"""Functions of the contract toolkit."""
