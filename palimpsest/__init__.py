"""Analytics over versioned key-value data, expressed as Spark DataFrame plans."""
