"""Fixed schemas; nothing is inferred from data."""

from pyspark.sql import types as T

STR, INT, DBL = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Sidecar fields read as text; `citations` and `cites_to` hold objects and plain strings mixed,
# so their elements stay text and are opened one by one.
SIDECAR = _struct(
    name=STR,
    decision_date=STR,
    docket_number=STR,
    first_page=STR,
    last_page=STR,
    court=STR,
    citations=T.ArrayType(STR),
    cites_to=T.ArrayType(STR),
)

CASE = _struct(
    case_id=STR,
    case_name=STR,
    source_folder=STR,
    year=STR,
    court=STR,
    case_text=STR,
    case_text_full_length=INT,
    verdict=STR,
    case_type=STR,
    sub_type=STR,
    num_citations=INT,
    legal_citations=STR,
    decision_date=STR,
    docket_number=STR,
    first_page=STR,
    last_page=STR,
)

REQUIRED_COLUMNS = (
    "case_id",
    "year",
    "court",
    "case_text",
    "verdict",
    "legal_citations",
    "case_type",
    "sub_type",
)

MASTER_METADATA = _struct(id=STR, name=STR, decision_date=STR, court=STR)

VECTOR = T.StructType(
    [
        T.StructField("id", STR),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("text", STR),
        T.StructField("metadata", T.MapType(STR, STR)),
    ]
)
