"""Landing, schema evolution, publishing and table projections."""
