"""Where images and catalogs come from, and where pages go."""
