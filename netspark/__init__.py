"""netspark: network-detection analytics as Spark DataFrame operators."""
