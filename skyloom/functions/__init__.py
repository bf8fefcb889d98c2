"""Transform models and unit names."""
