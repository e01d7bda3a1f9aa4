"""XML as records: attributes, repeated and nested elements under a schema, broken rows kept apart.

An attribute ``a`` is the column ``_a``, the text of an element that has attributes
too is ``_VALUE``, a repeated element is an array. Rows are parsed one by one, so a
broken one spoils no other.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgauge.functions import text as X
from docgauge.functions import values as V

#: Column for the text of a row that is no XML.
BROKEN = "_broken"


def _with_broken(schema: T.StructType | str) -> T.StructType:
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])


def with_records(df: DataFrame, raw: str, schema: T.StructType | str) -> DataFrame:
    """Add ``record``, ``broken`` and ``text`` to rows that each hold one XML document.

    ``record`` follows the schema: what an element lacks is null, other elements are
    left out of it (not of the text). A row that cannot be parsed is ``broken``, has no
    record, and its text is taken as from a page, tags dropped. Null: no record, not
    broken, text empty; empty text is broken.
    """
    whole = _with_broken(schema)
    parsed = df.withColumn("_xml", F.from_xml(raw, whole.simpleString(), {"columnNameOfCorruptRecord": BROKEN}))
    broken = F.col(f"_xml.{BROKEN}").isNotNull()
    names = [f.name for f in whole.fields[:-1]]
    record = F.when(F.col("_xml").isNotNull() & ~broken, F.struct(*[F.col(f"_xml.`{n}`") for n in names]))
    text = F.when(broken, X.html_to_text(F.col(raw), drop_code=False)).otherwise(X.xml_to_text(F.col(raw)))
    return parsed.withColumns({"record": record, "broken": broken, "text": text}).drop("_xml")


def record_fields(record: str, schema: T.StructType | str) -> Column:
    """A record's columns as a field map for the evaluation.

    Attributes lose their mark unless an element has the same name; repeated and nested
    elements are given in JSON spelling; what is null is in no field.
    """
    fields = _with_broken(schema).fields[:-1]
    taken = {f.name for f in fields}
    pairs = []
    for f in fields:
        bare = f.name.removeprefix("_")
        value = F.col(f"{record}.`{f.name}`")
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        pairs += [F.lit(f.name if bare in taken else bare), F.to_json(value) if nested else value.cast("string")]
    return V.text_fields(F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))


def read_records(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Records of large files cut at the elements named ``row_tag``, and the cuts that are broken.

    Files are split between tasks at the end tags; every element is in one of the two
    results, as columns of the schema or as ``raw`` text. Elements of this name must not
    lie inside each other, nor may their end tag stand in a comment or CDATA. Of a file
    that ends inside an element, what is whole of that element is taken.
    """
    within = r"(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?"
    element = rf"(?s)<{row_tag}{within}/>|<{row_tag}{within}>.*\z"
    pieces = spark.read.text(path, lineSep=f"</{row_tag}>", recursiveFileLookup=True)
    rows = pieces.select(F.explode_outer(F.regexp_extract_all("value", F.lit(element), F.lit(0))).alias("raw")).where("raw IS NOT NULL")
    single = F.col("raw").rlike(rf"(?s)\A<{row_tag}{within}/>\z")
    rows = rows.select(F.when(single, F.col("raw")).otherwise(F.concat("raw", F.lit(f"</{row_tag}>"))).alias("raw"))
    parsed = with_records(rows, "raw", schema)
    return parsed.where(~F.col("broken")).select("record.*"), parsed.where("broken").select("raw")
