"""papertrawl: document-intelligence analytics as ordinary Spark jobs."""
