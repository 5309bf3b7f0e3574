"""Column functions: text, urls, hashes, addresses, prices and matching."""
