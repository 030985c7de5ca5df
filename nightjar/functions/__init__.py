"""Column-level functions: addresses, text measures, condition compiler."""
