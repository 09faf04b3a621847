"""Jobs for language-model training data: cleaning, duplicates, search, sharding and packing."""
