"""Fixed values (word lists, patterns, rules, weights) and their DataFrame form."""
