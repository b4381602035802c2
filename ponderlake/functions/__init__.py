"""Column functions: text, parsing, rewards, policy and statistics formulas."""
