"""DataFrame -> DataFrame operators, one module per block of the inventory."""
