"""Layout of clusters and dimensions over a grid of workers."""
