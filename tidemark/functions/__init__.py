"""Values, literals and scalar expressions."""
