"""panelforge: panel analytics on Spark DataFrames.

Entity x time panels are integrated from many sources, gap-filled by staged
rules, profiled, turned into features, modelled with ``pyspark.ml`` and
evaluated -- every step is a DataFrame transformation that Catalyst plans.
"""

from panelforge.spec import PanelSpec

__all__ = ["PanelSpec"]
__version__ = "0.1.0"
