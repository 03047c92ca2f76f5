"""Column functions: ratios, chunk arithmetic, labels, headers, payloads, ranges."""
