"""Jobs over metadata and job history, and the recipe runner."""
