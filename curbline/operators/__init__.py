"""DataFrame -> DataFrame steps. All are lazy; none collects rows to the driver."""
