"""Pandas and Arrow UDFs over ``perrow``: built-ins cannot express these.

Those from iterator to iterator answer a batch in pieces, so that their size doesn't follow that of the batch.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import perrow

cloudpickle.register_pickle_by_value(perrow)

NODE = T.StructType([
    *[T.StructField(n, T.IntegerType()) for n in ("node_id", "parent_id", "depth", "last_id", "nth", "same")],
    T.StructField("tag", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
PLACE = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("parent_id", T.IntegerType())])

question_text = F.pandas_udf(perrow.question_text, T.StringType())
match_ratio = F.pandas_udf(perrow.match_ratio, T.DoubleType())
wrap_lines = F.arrow_udf(perrow.wrap_lines, T.ArrayType(T.StringType()))
html_node_table = F.udtf(perrow.NodeTable, returnType=NODE, useArrow=True)
html_nodes = F.arrow_udf(perrow.html_nodes, T.ArrayType(NODE))
dom_texts = F.arrow_udf(perrow.dom_texts, T.ArrayType(T.StringType()))
kept_ids = F.arrow_udf(perrow.kept_ids, T.ArrayType(T.IntegerType()))
preorder = F.arrow_udf(perrow.preorder, T.ArrayType(PLACE))
