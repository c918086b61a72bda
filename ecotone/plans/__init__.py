"""The control plane: configurations, planned exports, registries, guards, diagnosis."""
