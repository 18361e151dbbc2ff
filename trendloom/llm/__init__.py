"""Training-data operators: near duplicates, sharding, packing, scoring, cleaning and archives."""
