"""Multi-step plans: mosaics, bootstrap, stitching."""
