"""NumPy kernels that run inside tasks."""
