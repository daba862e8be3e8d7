"""Analytics over file inventories, written as plain Spark DataFrame functions."""
