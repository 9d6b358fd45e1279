"""Where documents and questions come from, and where collections are kept."""
