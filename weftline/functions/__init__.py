"""Column-level building blocks: types, predicates, transforms, formulas, keys."""
