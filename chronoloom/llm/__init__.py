"""Operators for language-model training data: entity linkage, packing, mixing and content scoring."""
