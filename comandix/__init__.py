"""Food-service operations analytics on Spark."""
