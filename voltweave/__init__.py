"""Synthetic distribution-grid engine on Spark: homes, roads and substations in, one labelled network out."""
