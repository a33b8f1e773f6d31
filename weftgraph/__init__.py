"""weftgraph: code property graphs, slices and training-data preparation as Spark plans."""

__version__ = "0.1.0"
