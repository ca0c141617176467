"""adlens: marketplace listing analytics expressed as Spark jobs."""
