"""Plan building blocks: skew-proof ordered windows, nesting, containment joins, size checks."""
