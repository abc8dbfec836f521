"""Jobs, and the queries bound to the driver's tables."""
