"""reelspan: retrieval, ranking and evaluation of video keyframes on PySpark.

The core holds the retrieval engine and the general data operators; the
subpackage ``llm`` holds the operators for training data and is optional:
nothing in the core imports it.
"""

__version__ = "0.1.0"
