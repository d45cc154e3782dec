"""Column expressions: no joins, no shuffles, all of them inside whole-stage codegen."""
