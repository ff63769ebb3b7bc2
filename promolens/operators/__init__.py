"""DataFrame to DataFrame operators; every point in time is a parameter."""
