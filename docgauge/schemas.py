"""Fixed output shapes, declared once."""

from pyspark.sql import types as T

ISSUE = T.StructType([
    T.StructField("field_name", T.StringType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    # the whole value that the description may show shortened
    T.StructField("value", T.StringType()),
])
ISSUES = T.ArrayType(ISSUE)

# one extracted value: its text and whether it counts as present
FIELD = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("truthy", T.BooleanType()),
])
FIELDS = T.MapType(T.StringType(), FIELD)
LINE_ITEM = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("fields", FIELDS),
])
LINE_ITEMS = T.ArrayType(LINE_ITEM)

# a semantic-score payload supplied from outside (one JSON object per document)
SEMANTIC_SCORES = T.StructType([
    T.StructField(n, T.DoubleType())
    for n in ("completeness", "accuracy", "consistency", "validity", "timeliness", "uniqueness")
])
SEMANTIC_PAYLOAD = T.StructType([
    T.StructField("document_type", T.StringType()),
    T.StructField("fields", T.VariantType()),
    T.StructField("semantic_evaluation", SEMANTIC_SCORES),
    T.StructField("metric_reasoning", T.MapType(T.StringType(), T.StringType())),
    T.StructField("executive_summary", T.StringType()),
    T.StructField("risk_summary", T.StringType()),
    T.StructField("recommendations", T.ArrayType(T.StringType())),
])
