"""Training-data operators: splitting, linking, cleaning, tokenising, packing and measuring text."""
