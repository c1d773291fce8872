"""Analytics over a media catalog and the activity of its community, on Spark."""
