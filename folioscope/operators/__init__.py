"""Relational operators: features, rules, classification, priorities, allocation."""
