"""DataFrame → DataFrame operators (all products in one job)."""
