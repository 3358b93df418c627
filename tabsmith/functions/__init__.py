"""Column-level building blocks (``Column -> Column``), all built-in expressions."""
