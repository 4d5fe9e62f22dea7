"""Column functions: the recipe vocabulary (`scalar`), date parsing (`dates`), validations (`validate`)."""
