"""Column functions, shared by batch and streaming queries. NULL is the only missing value and stays NULL."""
