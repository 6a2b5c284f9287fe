"""Column expressions: predicates, codes and projections."""
