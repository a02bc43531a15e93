"""A searchable, incrementally maintained index over an append-only log of versioned records, on Spark."""
