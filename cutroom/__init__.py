"""Analytics over catalogues of time-coded media and event data, as Spark DataFrame operators."""
