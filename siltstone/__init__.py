"""siltstone: versioned, ordered key-value tables expressed with the PySpark DataFrame API."""
