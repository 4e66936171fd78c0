"""Column expressions of the engine: values, keys, texts of labels."""
