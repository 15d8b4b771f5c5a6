"""folioscan: long-form text preparation and quality audit as Spark jobs."""
